"""White space, numbers, JSON and addresses as the reference's language reads them."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space there; Spark's \s and trim know less of it.
SPACE = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
END = r"\z"  # "$" would also match before a last line end
EOF = "~rowguard-end-of-text~"


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def number_text(number: Column, floating: bool) -> Column:
    """A number as text: 5 for 5.0, 1e-7, 1e+21."""
    if not floating:
        return number.cast("string")
    raw, size = number.cast("double").cast("string"), F.abs(number.cast("double"))
    wide = lambda scale: F.regexp_replace(F.regexp_replace(raw.cast(f"decimal(38,{scale})").cast("string"), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), "E-", "e-"), r"E(\d)", "e+$1")
    return (
        F.when(F.isnan(number.cast("double")), "NaN")
        .when(number.cast("double") == float("inf"), "Infinity")
        .when(number.cast("double") == float("-inf"), "-Infinity")
        .when(size == 0, "0")
        .when(size >= 1e21, exponent)
        .when(size < 1e-6, exponent)
        .when(size < 1, wide(30))
        .otherwise(wide(16))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, and stands in the plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_array(text: Column) -> Column:
    """The text between brackets with a last element that only the writer knows: trailing garbage cannot pass."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{EOF}"]')))


def is_whole(parts: Column) -> Column:
    """Whether what `json_array` gave is one value and the mark."""
    return F.coalesce((F.try_variant_get(parts, "$[1]", "string") == EOF) & F.try_variant_get(parts, "$[2]", "variant").isNull(), F.lit(False))


def first_of(parts: Column) -> Column:
    return F.when(is_whole(parts), F.try_variant_get(parts, "$[0]", "variant"))


def json_value(text: Column) -> Column:
    """The text as VARIANT, null unless all of it is one JSON value."""
    return first_of(json_array(text))


#: How JSON begins: most text that is none does not, and Spark's parser is slow to refuse.
JSON_START = r"^[ \t\n\r]*(?:[\[{\"\-0-9]|true|false|null)"


def is_json(text: Column) -> Column:
    return F.when(text.rlike(JSON_START), let(json_array(text), is_whole)).otherwise(F.lit(False))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def ipv6_pattern() -> str:
    """All forms of an IPv6 address: full, shortened at one place, with a dotted end."""
    h = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{IPV4}"]
    for n in range(8):
        before = "" if n == 0 else h if n == 1 else f"(?:{h}:){{{n - 1}}}{h}"
        rest = 7 - n
        forms.append(f"{before}::" + (f"(?:(?:{h}:){{0,{rest - 1}}}{h})?" if rest > 0 else ""))
        if n <= 5:
            forms.append(f"{before}::(?:{h}:){{0,{5 - n}}}{IPV4}")
    return "|".join(forms)


# What these patterns let through has to be what validators elsewhere let through.

EMAIL = rf"^[^{SPACE}@]+@[^{SPACE}@]+\.[^{SPACE}@]+{END}"
PHONE = rf"^(\+?[1-9][0-9]{{0,3}})?[{SPACE}\-.]?(\(?[0-9]{{1,4}}\)?[{SPACE}\-.]?)?[0-9{SPACE}\-.()]{{6,}}{END}"
UUID = rf"^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[1-5][0-9a-fA-F]{{3}}-[89abAB][0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}{END}"
HEX_COLOR = rf"^#(?:[0-9a-fA-F]{{3}}|[0-9a-fA-F]{{4}}|[0-9a-fA-F]{{6}}|[0-9a-fA-F]{{8}}){END}"
ISO_DATE = rf"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:[T ]([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}})(\.[0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?{END}"


def base64_pattern(url_safe: bool = False, require_padding: bool = True) -> str:
    c = "[A-Za-z0-9_-]" if url_safe else "[A-Za-z0-9+/]"
    tail = f"(?:{c}{{2}}==|{c}{{3}}=|{c}{{4}})" if require_padding else f"(?:{c}{{2,4}}={{0,2}})?"
    return f"^(?:{c}{{4}})*{tail}{END}"


def is_url(text: Column) -> Column:
    """The URL standard's parser without a base.

    Control characters and blanks at the ends and tabs and line ends anywhere go first.
    Plain web addresses pass by one pattern, text without a colon fails without any.
    """
    return F.when(~text.contains(":"), F.lit(False)).when(text.rlike(PLAIN_URL), F.lit(True)).otherwise(_is_any_url(text))


#: http or https, names that end in letters, a short port, and anything printable after it.
PLAIN_URL = rf"^https?://(?![^/?#]*[xX][nN]--)(?:[A-Za-z0-9_-]{{1,63}}\.){{1,20}}[A-Za-z]{{2,20}}(?::[0-9]{{1,4}})?(?:[/?#][!-~]*)?{END}"


def _is_any_url(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    special = scheme.isin("http", "https", "ws", "wss", "ftp")
    authority = F.regexp_extract(F.regexp_replace(rest, r"^[/\\]*", ""), r"^([^/\\?#]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    bracketed = host_port.startswith("[")
    host = F.when(bracketed, F.regexp_extract(host_port, r"^\[([^\]]*)\](?::[0-9]*)?\z", 1)).otherwise(F.regexp_extract(host_port, r"^([^:]*)(?::[0-9]*)?\z", 1))
    odd = F.when(~bracketed & host.rlike(r"[^\x00-\x7F]|%|(?i)xn--"), F.coalesce(ascii_host(host), F.lit(""))).otherwise(host)
    special_ok = F.when(special, let(odd, lambda h: _host_and_port(h, host_port, bracketed)))
    slashes = rest.startswith("//")
    other_host = F.regexp_replace(F.regexp_extract(rest, r"^//([^/?#]*)", 1), r"^.*@", "")
    other_ok = ~slashes | (scheme == "file") | ((other_host == "") | other_host.rlike(r'^(?:[^\x00\x09\x0A\x0D #/:<>?@\[\\\]^|]*|\[[0-9A-Fa-f:.]+\])(?::[0-9]{0,5})?\z'))
    return F.when(scheme == "", F.lit(False)).when(special, special_ok).otherwise(other_ok)


def _host_and_port(host: Column, host_port: Column, bracketed: Column) -> Column:
    """Whether the host, in ASCII, and the port of a web address are some."""
    port = F.regexp_extract(host_port, r"(?:^|\]|[^:]):([0-9]*)\z", 1)
    port_ok = (port == "") | (F.regexp_replace(port, "^0+", "").rlike(r"^(?:|[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])\z"))
    last = F.regexp_extract(host, r"([^.]*)\.?\z", 1)
    numeric = last.rlike(r"^(?:[0-9]+|0[xX][0-9A-Fa-f]*)\z")
    numbers_ok = ~numeric | host.rlike(rf"^(?:{IPV4}|[0-9]{{1,9}}|0[xX][0-9A-Fa-f]{{0,8}}|(?:{_OCTET}\.){{1,2}}{_OCTET})\.?\z")
    plain = (host != "") & ~host.rlike(r'[\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7F]') & numbers_ok
    return F.when(bracketed, (host != "") & host.rlike(f"^(?:{ipv6_pattern()})" + END)).otherwise(plain) & port_ok


def _letter(codes: Column) -> Column:
    """Code points as text."""
    return F.array_join(F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")


def punycode(label: Column) -> Column:
    """What follows "xn--" in a label as the letters that it stands for, null where it stands for none.

    Fixed values: base 36, t from 1 to 26, skew 38, damp 700, first bias 72, first code point 128.
    """
    low = F.lower(label)
    plain = F.when(low.contains("-"), F.regexp_extract(low, r"^(.*)-[^-]*\z", 1)).otherwise("")
    rest = F.regexp_extract(low, r"([^-]*)\z", 1)
    start = F.struct(
        F.lit(128).cast("long").alias("n"), F.lit(0).cast("long").alias("i"), F.lit(72).cast("long").alias("bias"), F.lit(0).cast("long").alias("old"),
        F.lit(1).cast("long").alias("w"), F.lit(36).cast("long").alias("k"), F.when(plain == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(plain, ""), lambda c: F.ascii(c).cast("long"))).alias("out"),
        F.lit(True).alias("ok"),
    )

    def adapted(delta: Column, points: Column, first: Column) -> Column:
        halved = F.when(first, F.floor(delta / 700)).otherwise(F.floor(delta / 2))
        start = F.struct((halved + F.floor(halved / points)).alias("d"), F.lit(0).cast("long").alias("k"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda a, _: F.when(a["d"] > 455, F.struct(F.floor(a["d"] / 35).alias("d"), (a["k"] + 36).alias("k"))).otherwise(a))
        return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda _, a: a["k"] + F.floor(36 * a["d"] / (a["d"] + 38)))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        digit = F.when(code.between(97, 122), code - 97).when(code.between(48, 57), code - 22)
        i = a["i"] + digit * a["w"]
        t = F.when(a["k"] <= a["bias"], 1).when(a["k"] >= a["bias"] + 26, 26).otherwise(a["k"] - a["bias"])
        size = F.size(a["out"]) + 1
        at = i % size
        done = F.struct(
            (a["n"] + F.floor(i / size)).alias("n"), (at + 1).alias("i"), adapted(i - a["old"], size, a["old"] == 0).alias("bias"), (at + 1).alias("old"), F.lit(1).cast("long").alias("w"), F.lit(36).cast("long").alias("k"),
            F.concat(F.slice(a["out"], F.lit(1), at.cast("int")), F.array(a["n"] + F.floor(i / size)), F.slice(a["out"], at.cast("int") + 1, size)).alias("out"), (a["n"] + F.floor(i / size) <= 0x10FFFF).alias("ok"),
        )
        on = F.struct(a["n"], i.alias("i"), a["bias"], a["old"], (a["w"] * (36 - t)).alias("w"), (a["k"] + 36).alias("k"), a["out"], (a["w"] < 1 << 40).alias("ok"))
        return F.when(~a["ok"] | digit.isNull(), a.withField("ok", F.lit(False))).when(digit < t, done).otherwise(on)

    end = F.aggregate(F.split(rest, ""), start, step, lambda a: F.when(a["ok"] & (a["w"] == 1), a["out"]))
    return F.when((rest != "") & (F.length(rest) < 64), _letter(end))


def ascii_host(host: Column) -> Column:
    """A host as ASCII, null where it has no such form: percent signs decoded, letters mapped, labels as Punycode.

    Labels that are Punycode already have to stand for letters that stay as they are
    when they are mapped. The mapping is the JVM's (of IDNA 2003, letters assigned later let through).
    """
    decoded = F.when(host.contains("%"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    mapped = lambda label: F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), label, F.lit(1))

    def one(label: Column) -> Column:
        fine = lambda letters: letters.rlike(r"[^\x00-\x7F]") & (F.lower(letters) == letters) & mapped(letters).isNotNull()
        return F.when(F.lower(label).startswith("xn--"), F.when(let(punycode(F.substring(label, 5, 1 << 20)), fine), label)).when(label.rlike(r"^[\x00-\x7F]*\z"), label).otherwise(mapped(label))

    labels = F.transform(F.split(decoded, r"[.\x{3002}\x{FF0E}\x{FF61}]"), one)
    return F.when(~F.exists(labels, lambda x: x.isNull()), F.array_join(labels, "."))


def iso_timestamp(text: Column) -> Column:
    """The instant that an ISO date stands for, null where there is none; no offset is UTC.

    One pattern tells whether the text is one; then its parts lie at known places.
    """
    part = lambda start, n: F.substring(text, start, n)
    number = lambda c: c.try_cast("int")
    timed, rest = F.length(text) > 10, F.substring(text, 17, 1_000_000)
    has_seconds = rest.startswith(":")
    tail = F.when(has_seconds, F.substring(rest, 4, 1_000_000)).otherwise(rest)  # fraction and offset
    long, short = F.substring(tail, -6, 1).isin("+", "-"), F.substring(tail, -5, 1).isin("+", "-")
    size = F.when(tail.endswith("Z"), 1).when(long, 6).when(short, 5).otherwise(0)
    offset = F.when(long, F.substring(tail, -6, 6)).when(short, F.concat(F.substring(tail, -5, 3), F.lit(":"), F.substring(tail, -2, 2))).otherwise("+00:00")
    fraction = F.when(tail.startswith("."), F.substring(tail, F.lit(1), F.least(F.lit(4), F.length(tail) - size))).otherwise("")
    whole_seconds = F.when(has_seconds, F.substring(rest, 2, 2)).otherwise("0")
    hour, minute = [number(F.when(timed, part(at, 2)).otherwise("0")) for at in (12, 15)]
    hours, minutes = number(F.substring(offset, 2, 2)), number(F.substring(offset, 5, 2))
    fits = (hour < 24) & (minute < 60) & (number(whole_seconds) < 60) & (minutes < 60) & ((hours < 18) | (hours == 18) & (minutes == 0))
    seconds = F.concat(whole_seconds, fraction).try_cast("decimal(8,6)")
    made = F.try_make_timestamp(number(part(1, 4)), number(part(6, 2)), number(part(9, 2)), hour, minute, seconds, offset)
    return F.when(text.rlike(ISO_DATE), F.when(fits, made))


_WORD = "[A-Za-z0-9_]"
_LINE_END = r"\n\r\x{2028}\x{2029}"


def java_pattern(pattern: str, flags: str = "") -> str:
    """A regular expression of the reference's language as Java has it.

    White space, line ends, word edges, `[^]`, `[]`, `\\u{..}`, script names and literal
    brackets within classes mean there what they do not mean here.
    """
    out, i, inside, n = "", 0, False, len(pattern)
    many, every = "m" in flags, "s" in flags
    edge = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    simple = {"s": f"[{SPACE}]", "S": f"[^{SPACE}]", "b": edge, "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))", "0": r"\x00"}
    classed = {"s": SPACE, "S": f"[^{SPACE}]", "b": r"\x08", "0": r"\x00"}
    while i < n:
        c, rest = pattern[i], pattern[i:]
        if c == "\\" and i + 1 < n:
            kind = pattern[i + 1]
            wide = re.match(r"\\u\{([0-9A-Fa-f]+)\}", rest) if "u" in flags else None
            script = re.match(r"\\([pP])\{(?:Script|sc|Script_Extensions|scx)=(\w+)\}", rest) if "u" in flags else None
            if wide or script:
                out += rf"\x{{{wide[1]}}}" if wide else rf"\{script[1]}{{Is{script[2]}}}"
                i += len((wide or script)[0])
                continue
            known = (classed if inside else simple).get(kind)
            plain = kind.isalpha() and kind not in "dDwWtnrvfxuckpPsSbB"
            out += known if known is not None else r"\x0B" if kind == "v" else kind if plain or kind in "pP" and "u" not in flags else "\\" + kind
            i += 2
            continue
        if inside:
            inside = c != "]"
            out += "\\[" if c == "[" else "&\\" if rest.startswith("&&") else c
        elif rest.startswith("[^]"):
            out, i = out + r"[\s\S]", i + 2
        elif rest.startswith("[]"):
            out, i = out + "(?!)", i + 1
        elif c == "[":
            inside = True
            out += c
        elif c == ".":
            out += r"[\s\S]" if every else f"[^{_LINE_END}]"
        elif c == "^":
            out += f"(?:(?<![\\s\\S])|(?<=[{_LINE_END}]))" if many else c
        elif c == "$":
            out += f"(?=[{_LINE_END}]|{END})" if many else END
        elif c == "{" and not re.match(r"\{\d+(,\d*)?\}", rest):
            out += r"\{"
        else:
            out += c
        i += 1
    if "i" not in flags:
        return out
    # without u no letter beyond ASCII is the same as one of ASCII: not the Kelvin sign as k, nor the dotless i as i
    return ("(?i)" if "u" not in flags and pattern.isascii() and not re.search(r"\\[ux]", pattern) else "(?iu)") + out


def compiled(java: str) -> str:
    """The pattern, if Java takes it; ValueError otherwise. Without a running JVM it is only looked through for unbounded lookbehind."""
    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except (IllegalArgumentException, Py4JJavaError) as error:
            raise ValueError(f"no pattern for rows: {error}") from None
    elif re.search(r"\(\?<[=!](?:[^()\\]|\\.)*[*+]", java):
        raise ValueError("no pattern for rows: it looks behind without a bound")
    return java
