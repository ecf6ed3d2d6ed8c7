"""Validators: a Value in, a Check (ok, message, value) out.

`ok` is never null. The message is only worked out where a query asks for it
on rows that fail. Validators that take options return the validator.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .logic import Text, Truth, both, cases, column, either, joined, negated, said
from .registry import DEFAULT, TypeRegistry
from .values import Typed, Value


class Check:
    """Whether a value passes, what is said if not, and the value. A message given as a function is only built where it is asked for."""

    def __init__(self, ok: Truth, message: Text | Callable[[], Text], value: Value | Column):
        self.ok, self._message, self.value = ok, message, value

    @property
    def message(self) -> Text:
        self._message = said(self._message)
        return self._message

    def column(self) -> Column:
        """struct(ok, message), the message null where ok."""
        return F.struct(column(self.ok).alias("ok"), F.when(column(negated(self.ok)), column(self.message)).alias("message"))

    def value_column(self) -> Column:
        return self.value.column if isinstance(self.value, Value) else self.value


Validator = Callable[[Value], Check]

#: What each built-in type says of a value that is not of it; those with True add the value's typeof.
_SAYS: dict[str, tuple[str, bool]] = {
    "array": ("an array", True),
    "array_buffer": ("an ArrayBuffer", False),
    "bigint": ("a bigint", True),
    "boolean": ("a boolean", True),
    "data_view": ("a DataView", False),
    "date": ("a valid Date", False),
    "dom": ("a DOM element", True),
    "function": ("a function", True),
    "json": ("a valid JSON string", False),
    "map": ("a Map", False),
    "number": ("a number", True),
    "null": ("null", False),
    "object": ("a non-array object", True),
    "regex": ("a RegExp", False),
    "set": ("a Set", False),
    "string": ("a string", True),
    "symbol": ("a symbol", True),
    "typed_array": ("a TypedArray", False),
    "undefined": ("undefined", True),
}


def base_message(base: str, v: Value) -> Text:
    what, named = _SAYS[base]
    if not named:
        own = joined(v.text(), f" must be {what}.")
        return cases((v.is_base("string"), own), otherwise=is_type("string", v).message) if base == "json" else own
    kind = cases((v.is_base("array"), "array"), otherwise=v.typeof()) if base == "object" else v.typeof()
    return joined(v.text(), f" must be {what}, is ", kind)


def of_type(name: str, v: Value, registry: TypeRegistry = DEFAULT) -> Check:
    """One registered type, with the type's own message."""
    found = registry.resolve(name)
    if isinstance(found, str):
        return Check(v.is_base(found), lambda: base_message(found, v), v)
    return found(v)


def matches_type(types: str | list[str], v: Value, registry: TypeRegistry = DEFAULT) -> Truth:
    """Whether any of the types holds; no types: none. A name is looked up unless one before it holds anyway."""
    out: Truth = False
    for name in [types] if isinstance(types, str) else types:
        if out is True:
            break
        base = registry.predicate(name)
        out = either(out, v.is_base(base) if base else of_type(name, v, registry).ok)
    return out


def is_type(types: str | list[str], v: Value, registry: TypeRegistry = DEFAULT) -> Check:
    names = [types] if isinstance(types, str) else types
    found = [of_type(n, v, registry) for n in names]
    says = lambda: joined("None of the types matched for ", v.text(), ": ", *[p for c in found for p in (", ", c.message)][1:])
    return Check(either(*[c.ok for c in found]), says, v)


def type_check(types: str | list[str], registry: TypeRegistry = DEFAULT) -> Validator:
    return lambda v: is_type(types, v, registry)


def _guard(base: str) -> Validator:
    return lambda v: is_type(base, v)


as_string, as_number, as_boolean, as_array, as_object = map(_guard, ("string", "number", "boolean", "array", "object"))


def _then(first: Check, v: Value, test: Callable[[], Truth], message: Callable[[], Text], value: Value | Column | None = None) -> Check:
    """`test` where `first` holds, with its own message there."""
    if first.ok is False:
        return Check(False, lambda: first.message, v)
    ok = test()
    own = lambda: cases((negated(first.ok), first.message), otherwise=message())
    return Check(both(first.ok, ok if isinstance(ok, bool) else F.coalesce(ok, F.lit(False))), own, v if value is None else value)


def _string(says: str, test: Callable[[Column], Column]) -> Validator:
    return lambda v: _then(as_string(v), v, lambda: test(v.string()), lambda: joined(v.text(), says))


# Numbers. Of the tests below only those on floating columns name NaN: elsewhere they stay pushable to the scan.


def _number(says: Callable[[Value], Text] | str, test: Callable[[Value, Column], Truth]) -> Validator:
    def run(v: Value) -> Check:
        first = as_number(v)
        if first.ok is False:
            return Check(False, lambda: first.message, v)
        ok = test(v, v.number())
        own = lambda: cases((negated(first.ok), first.message), otherwise=joined(v.text(), says if isinstance(says, str) else says(v)))
        return Check(both(first.ok, ok if isinstance(v, Typed) and type(v) is Typed else column(F.coalesce(column(ok), F.lit(False)))), own, v)

    return run


def in_range(low: float, high: float) -> Validator:
    """Both ends are inside; NaN passes."""
    test = lambda v, c: (F.isnan(c) | c.between(low, high)) if v.floating() else c.between(low, high)
    return _number(lambda v: joined(f" must be between {low} and {high}, is ", v.text()), test)


def _integral(v: Value, c: Column) -> Truth:
    if isinstance(v, Typed) and isinstance(v.type, T.IntegralType):
        return True
    return (F.abs(c) < float("inf")) & (c == F.rint(c))


is_integer = _number(" must be an integer.", _integral)
is_positive_number = _number(" must be a positive number.", lambda v, c: c >= 0)
is_negative_number = _number(" must be a negative number.", lambda v, c: (c < 0) | F.isnan(c) if v.floating() else c < 0)
is_finite_number = _number(" must be a finite number.", lambda v, c: F.abs(c) < float("inf") if v.floating() else True)
is_safe_integer = _number(" must be a safe integer.", lambda v, c: both(_integral(v, c), c.between(-(2**53) + 1, 2**53 - 1)))


def _after_integer(says: str, test: Callable[[Column], Column]) -> Validator:
    return lambda v: _then(is_integer(v), v, lambda: test(v.number()), lambda: joined(v.text(), says))


is_positive_integer = _after_integer(" must be a positive integer.", lambda c: c >= 0)
is_negative_integer = _after_integer(" must be a positive integer.", lambda c: c < 0)  # the message is the reference's


# Strings.

is_email = _string(" must be a valid email address.", lambda s: s.rlike(tx.EMAIL))
is_url = _string(" must be a valid URL.", tx.is_url)
is_non_empty_string = _string(" must be a non-empty string.", lambda s: ~tx.is_blank(s))
is_uuid = _string(" must be a valid UUID.", lambda s: s.rlike(tx.UUID))
is_ipv4 = _string(" must be a valid IPv4 address.", lambda s: s.rlike(f"^{tx.IPV4}{tx.END}"))
is_ipv6 = _string(" must be a valid IPv6 address.", lambda s: s.rlike(f"^(?:{tx.ipv6_pattern()}){tx.END}"))
is_hex_color = _string(" must be a valid hex color.", lambda s: s.rlike(tx.HEX_COLOR))


def is_phone_number(v: Value) -> Check:
    first = as_string(v)
    if first.ok is False:
        return first
    s = v.string()
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    shaped = s.rlike(tx.PHONE) & s.rlike("[0-9+]")
    counted = digits.between(7, 15)
    plain = ~s.contains("..") & ~s.contains("--") & ~s.contains("  ")
    says = lambda: cases((negated(first.ok), first.message), (shaped & ~counted, joined(v.text(), " must be a valid phone number with 7-15 digits.")), otherwise=joined(v.text(), " must be a valid phone number."))
    return Check(both(first.ok, F.coalesce(shaped & counted & plain, F.lit(False))), says, v)


def matches(pattern: str, flags: str = "") -> Validator:
    """A pattern found anywhere in the string. Flags i, m, s, u; g and y, which keep state between calls, are refused.

    A pattern that Java has no form of, as one that looks behind without a bound, is refused here, not where rows are read.
    """
    if set(flags) - set("imsu"):
        raise ValueError(f"flags {flags!r}: only i, m, s and u have a meaning for rows")
    java = tx.compiled(tx.java_pattern(pattern, flags))
    return _string(f" must match /{pattern}/{flags}.", lambda s: s.rlike(java))


def is_iso_date(v: Value) -> Check:
    """The value of the check is the instant."""
    first = as_string(v)
    if first.ok is False:
        return first
    at = tx.iso_timestamp(v.string())
    return _then(first, v, lambda: at.isNotNull(), lambda: joined(v.text(), " must be a valid ISO 8601 date string."), at)


def is_base64(url_safe: bool = False, require_padding: bool = True) -> Validator:
    pattern = tx.base64_pattern(url_safe, require_padding)
    return _string(" must be a valid Base64 string.", lambda s: (s != "") & s.rlike(pattern))


# Containers and membership.


def array_of(types: str | list[str], registry: TypeRegistry = DEFAULT) -> Validator:
    """All elements are of the types; the message is that of the first that is not."""

    def run(v: Value) -> Check:
        first = as_array(v)
        if first.ok is False:
            return Check(False, lambda: first.message, v)
        wrong = v.each(lambda x, i: F.when(column(negated(matches_type(types, x, registry))), column(is_type(types, x, registry).message)))
        bad = F.filter(wrong, lambda m: m.isNotNull())
        return _then(first, v, lambda: F.size(bad) == 0, lambda: F.try_element_at(bad, F.lit(1)))

    return run


def is_non_empty_array(v: Value) -> Check:
    return _then(as_array(v), v, lambda: v.size() > 0, lambda: joined(v.text(), " must be a non-empty array."))


def one_of(values: list) -> Validator:
    """One of the values, of the same kind: no text is a number. NaN is NaN, None is null."""

    def run(v: Value) -> Check:
        shown = ", ".join("" if x is None else _shown(x) for x in values)
        tests: list[Truth] = [v.null()] if None in values else []
        for kind, kinds in (("string", str), ("boolean", bool), ("number", (int, float))):
            own = [x for x in values if isinstance(x, kinds) and (kind == "boolean" or not isinstance(x, bool))]
            is_kind = v.is_kind(kind) if own else False
            if is_kind is False:
                continue
            c = v.string() if kind == "string" else v.number() if kind == "number" else (v.column.cast("boolean") if isinstance(v, Typed) else F.try_variant_get(v.column, "$", "boolean"))
            nan = [x for x in own if x != x]
            isin = c.isin(*[x for x in own if x == x])
            tests.append(both(is_kind, F.coalesce(isin | F.isnan(c.cast("double")) if nan else isin, F.lit(False))))
        return Check(either(*tests), lambda: joined(v.text(), f" must be one of [{shown}], is ", v.text()), v)

    return run


def _shown(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    return str(int(x)) if isinstance(x, float) and x.is_integer() else "NaN" if x != x else str(x)


def has_length(least: int | None = None, most: int | None = None) -> Validator:
    """Of strings in units of UTF-16, and of arrays."""

    def run(v: Value) -> Check:
        string, array = v.is_kind("string"), v.is_kind("array")
        size = F.lit(None).cast("int")
        if string is not False:
            size = F.when(column(string), tx.utf16_length(v.string())).otherwise(size)
        if array is not False:
            size = F.when(column(array), v.size()).otherwise(size)
        short: Truth = False if least is None else F.coalesce(size < least, F.lit(False))
        long: Truth = False if most is None else F.coalesce(size > most, F.lit(False))
        kinds = either(string, array)
        says = lambda: cases(
            (negated(kinds), joined(v.text(), " must be a string or array, is ", v.kind_name())),
            (short, joined(f"length must be >= {least}, is ", size.cast("string"))),
            otherwise=joined(f"length must be <= {most}, is ", size.cast("string")),
        )
        return Check(both(kinds, negated(short), negated(long)), says, v)

    return run


def _emptiness(empty: bool) -> Validator:
    want, says = ("must be empty.", "must have no own keys.") if empty else ("must be non-empty.", "must have at least one own key.")

    def run(v: Value) -> Check:
        def sized(kind: str, test: Callable[[], Column]) -> tuple[Truth, Truth]:
            own = v.is_kind(kind)
            return own, False if own is False else both(own, F.coalesce(test() if empty else ~test(), F.lit(False)))

        string = sized("string", lambda: tx.is_blank(v.string()))
        rest = {k: sized(k, lambda: v.size() == 0) for k in ("array", "map", "set", "object")}
        names = {"array": "array", "map": "Map", "set": "Set"}
        message = lambda: cases(
            (string[0], f"string {want}"),
            *[(rest[k][0], f"{n} {want}") for k, n in names.items()],
            (rest["object"][0], f"object {says}"),
            otherwise=joined(v.text(), f" is not a container that can be checked for {'emptiness' if empty else 'non-emptiness'}."),
        )
        return Check(either(string[1], *[t for _, t in rest.values()]), message, v)

    return run


is_empty, is_non_empty = _emptiness(True), _emptiness(False)


def is_plain_object(v: Value) -> Check:
    """A struct or a JSON object; maps, dates and binaries are instances of classes, arrays too."""
    instance = either(v.is_nested(), v.is_kind("array"))
    says = lambda: cases((instance, joined(v.text(), " must be a plain object (no class instances).")), (v.null(), "null must be a plain object, is null"), otherwise=joined(v.text(), " must be a plain object, is ", v.typeof()))
    return Check(v.is_kind("object"), says, v)


def is_promise(v: Value) -> Check:
    """No data is a promise."""
    return Check(False, lambda: joined(v.text(), " must be a Promise."), v)


def is_instance_of(data_type: type[T.DataType]) -> Validator:
    """Not null and of a column type of this class."""

    def run(v: Value) -> Check:
        own = isinstance(v, Typed) and isinstance(v.type, data_type)
        return Check(v.column.isNotNull() if own else False, lambda: joined(v.text(), f" must be an instance of {data_type.__name__}."), v)

    return run


# Combinators.


def nullable(validator: Validator) -> Validator:
    def run(v: Value) -> Check:
        inner = validator(v)
        return Check(either(v.null(), inner.ok), lambda: inner.message, inner.value)

    return run


def optional(validator: Validator) -> Validator:
    def run(v: Value) -> Check:
        inner = validator(v)
        return Check(either(v.missing(), inner.ok), lambda: inner.message, inner.value)

    return run


def union_of(*validators: Validator) -> Validator:
    """The first that holds gives the value."""

    def run(v: Value) -> Check:
        found = [validator(v) for validator in validators]
        says = lambda: joined("Value did not match any union variant: ", *[p for c in found for p in (", ", c.message)][1:])
        value: Value | Column = v
        if any(not isinstance(c.value, Value) for c in found):
            value = F.lit(None)
            for c in reversed(found):
                value = F.when(column(c.ok), c.value_column()).otherwise(value)
        return Check(either(*[c.ok for c in found]), says, value)

    return run


def python_validator(function: Callable, says: str = "Value was not accepted.", whole: bool = False) -> Validator:
    """A Python function of a value as a validator: it returns or raises. Slower than columns; rows go there in Arrow batches.

    With `whole` it takes a Series of values and returns one of what is wrong with each, None where nothing is.
    """

    def one(x) -> str | None:
        try:
            function(None if x is None or x is pd.NA or x is pd.NaT else x)
        except Exception as error:
            return str(error) or says
        return None

    @F.pandas_udf("ok boolean, message string")
    def run(values: pd.Series) -> pd.DataFrame:
        message = pd.Series(function(values) if whole else [one(x) for x in values], dtype=object)
        return pd.DataFrame({"ok": message.isna().to_numpy(), "message": message.where(message.notna(), None).to_numpy()})

    def check(v: Value) -> Check:
        c = v.column if isinstance(v, Typed) else F.to_json(v.column)
        found = run(c)
        return Check(F.coalesce(found["ok"], F.lit(False)), found["message"], v)

    return check
