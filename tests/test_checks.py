"""Accept and reject tables of the validators, one DataFrame each."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowguard.functions import checks as c
from rowguard.functions.registry import BASES, TypeRegistry, UnknownTypeError
from rowguard.functions.values import kind_of, value
from rowguard.operators import frame as fr

STRINGS = [
    (c.is_email, ["test@example.com", "user.name@domain.co.uk", "simple@test.io"], ["invalid-email", "test@", "@domain.com", "test.domain.com", "", "a@b.c\n", "a b@c.d", None]),
    (c.is_url, ["https://example.com", "http://test.org", "https://www.google.com/search?q=test", "mailto:a@b", "http://[::1]/", "http://x:80/", "https://x.com/a|b", " http://a.b "],
     ["invalid-url", "", "http://", "http://x:99999/", "http://a b/", "http://[::1", "http://256.0.0.1/", None]),
    (c.is_phone_number, ["1234567890", "+1234567890", "(555) 123-4567", "+1 (555) 123-4567", "555.123.4567", "+39 06 1234567"],
     ["123", "123456789012345678", "12a4567890", "", "123..456.7890", "123--456-7890", "123  456  7890", "+0123456789", "++1234567890", None]),
    (c.is_non_empty_string, ["hello", "a", "   test   "], ["", "   ", " \t\u000b﻿", None]),
    (c.is_uuid, ["123e4567-e89b-42d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000"], ["not-a-uuid", "123e4567-e89b-62d3-a456-426614174000", "123e4567-e89b-42d3-a456-426614174000\n", None]),
    (c.is_ipv4, ["192.168.0.1", "0.0.0.0", "255.255.255.255"], ["256.0.0.1", "1.2.3", "01.2.3.4", "a.b.c.d", "1.2.3.4.5", "1.2.3.4\n", None]),
    (c.is_ipv6, ["2001:db8::1", "::1", "fe80::1ff:fe23:4567:890a", "::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::"], ["not-an-ip", "192.168.0.1", "1::2::3", "1:2:3:4:5:6:7:8:9", ":::", "::1]:80/[", "12345::", None]),
    (c.is_hex_color, ["#fff", "#FFFA", "#aabbcc", "#aabbccdd"], ["fff", "#xyz", "#12345", "#fff\n", None]),
    (c.is_iso_date, ["2024-01-15T10:30:00Z", "2024-01-15", "2024-01-15T10:30-05:30", "2024-01-15 10:30:00.123456+0100"], ["15/01/2024", "2024-13-01", "hello", "2024-02-30", "2024-01-15T24:00", "2024-01-15T10:30:60Z", "2024-01-15T10:30+19:00", "", None]),
    (c.is_base64(), ["aGVsbG8=", "YWJjZA==", "YWJj"], ["not base64!", "", "aGVsbG8", "aGVs_G8=", None]),
    (c.is_base64(url_safe=True), ["aGVsbG8_d29ybGQ="], ["aGVsbG8+d29ybGQ="]),
    (c.is_base64(require_padding=False), ["aGVsbG8", "ab=", "abcd=="], ["a", "abcde"]),
    (c.matches("^abc"), ["abcdef", "abc"], ["xyz", None]),
    (c.matches("b$"), ["ab"], ["ab\n"]),
    (c.matches("B[$]", "i"), ["ab$c"], ["ab"]),
    (c.has_length(1, 5), ["hi", "😀😀"], ["", "too long", "😀😀😀", None]),
    (c.is_empty, ["", "   "], ["a", None]),
    (c.is_non_empty, ["a"], ["", " ", None]),
    (c.one_of(["red", 1, True]), ["red"], ["yellow", "Red", "1", "true", None]),
    (c.one_of(["red", None]), ["red", None], ["x"]),
    (c.type_check("json"), ['{"key": "value"}', "[1, 2, 3]", '"test"', "42", " null "], ["{invalid json}", "undefined", "", "1 2", '{"a":1} x', "1,2", "[1,]", "NaN", "01", None]),
]


@pytest.mark.parametrize("case", range(len(STRINGS)))
def test_strings(spark, case):
    validator, good, bad = STRINGS[case]
    rows = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    got = rows.select("v", "want", fr.apply(rows, "v", validator).alias("c")).collect()
    assert [(r.v, r.c.ok) for r in got] == [(r.v, r.want) for r in got]
    assert all((r.c.message is None) == r.c.ok for r in got)
    number = spark.range(1)
    if case not in (19, 20):
        assert not number.select(fr.apply(number, "id", validator)["ok"]).first()[0]


NUMBERS = [
    (c.is_positive_integer, [1, 42, 1000, 0], [-1, 3.14]),
    (c.is_positive_number, [1, 3.14, 0.001, 0, math.nan, math.inf], [-1, -3.14]),
    (c.is_integer, [0, 42, -10, 5.0], [3.14, 0.1, math.nan, math.inf]),
    (c.is_negative_number, [-1, -3.14, -0.001, math.nan], [0, 1]),
    (c.is_negative_integer, [-1, -42, -1000], [0, 1, -3.14, math.nan]),
    (c.in_range(-10, 10), [5, 0, -10, 10, math.nan], [15, -10.5, math.inf]),
    (c.is_finite_number, [1, -2.5], [math.nan, math.inf, -math.inf]),
    (c.is_safe_integer, [42, 2**53 - 1], [float(2**53), 3.14, math.nan]),
    (c.one_of([1, math.nan]), [1, math.nan], [2]),
]


@pytest.mark.parametrize("case", range(len(NUMBERS)))
def test_numbers(spark, case):
    validator, good, bad = NUMBERS[case]
    rows = spark.createDataFrame([(float(v), True) for v in good] + [(float(v), False) for v in bad] + [(None, False)], "v double, want boolean")
    got = rows.select("v", "want", fr.apply(rows, "v", validator).alias("c")).collect()
    assert [r.c.ok for r in got] == [r.want for r in got]
    text = spark.createDataFrame([("42",)], "v string")
    assert not text.select(fr.apply(text, "v", validator)["ok"]).first()[0]
    payload = spark.createDataFrame([("42",), ('"42"',)], "j string").select(F.parse_json("j").alias("v"))
    ok = [r[0] for r in payload.select(fr.apply(payload, "v", validator)["ok"]).collect()]
    assert ok[1] is False


def test_long_edges(spark):
    rows = spark.createDataFrame([(2**53,), (-(2**53),), (2**53 - 1,), (-(2**63),)], "v long")
    assert [r[0] for r in rows.select(fr.apply(rows, "v", c.is_safe_integer)["ok"]).collect()] == [False, False, True, False]


def test_messages(spark):
    rows = spark.createDataFrame([(5.0, "x", [1, 2], None)], "n double, s string, a array<int>, z string")
    says = lambda name, v: rows.select(fr.apply(rows, name, v)["message"]).first()[0]
    assert says("n", c.in_range(6, 7)) == "5 must be between 6 and 7, is 5"
    assert says("n", c.is_negative_integer) == "5 must be a positive integer."
    assert says("s", c.as_number) == "None of the types matched for x: x must be a number, is string"
    assert says("a", c.as_object) == "None of the types matched for 1,2: 1,2 must be a non-array object, is array"
    assert says("n", c.type_check("json")) == "None of the types matched for 5: None of the types matched for 5: 5 must be a string, is number"
    assert says("s", c.one_of(["a", 1])) == "x must be one of [a, 1], is x"
    assert says("a", c.array_of("string")) == "None of the types matched for 1: 1 must be a string, is number"
    assert says("z", c.as_string) == "None of the types matched for null: null must be a string, is object"
    assert says("s", c.union_of(c.as_number, c.as_boolean)).startswith("Value did not match any union variant: None of")
    assert says("s", c.has_length(2)) == "length must be >= 2, is 1"
    assert says("n", c.is_empty) == "5 is not a container that can be checked for emptiness."
    assert says("s", c.is_promise) == "x must be a Promise."
    assert says("s", c.is_instance_of(T.LongType)) == "x must be an instance of LongType."


def test_number_text(spark):
    wanted = {5.0: "5", 1e-7: "1e-7", 1e21: "1e+21", 123456789.25: "123456789.25", 0.001: "0.001", -0.5: "-0.5", 1e20: "100000000000000000000", 1.5e22: "1.5e+22", 0.000001: "0.000001", math.nan: "NaN", -math.inf: "-Infinity", -0.0: "0"}
    rows = spark.createDataFrame([(k,) for k in wanted], "v double")
    assert [r[0] for r in rows.select(value(rows, "v").text()).collect()] == list(wanted.values())


def test_kinds_fold_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "a", None, b"x", {"k": 1})], "n int, s string, z string, b binary, m map<string,int>")
    assert value(rows, "n").is_base("string") is False
    assert value(rows, "m").is_base("object") is True
    assert value(rows, "gone").is_base("undefined") is True
    assert kind_of(T.DecimalType(20, 0)) == "bigint" and kind_of(T.DecimalType(20, 2)) == "number"
    tagged = rows.select(F.array("n").alias("a", metadata={"kind": "set"}))
    assert value(tagged, "a").kind == "set" and value(tagged, "a").is_base("array") is False
    assert value(rows, "s").is_base("symbol") is value(rows, "s").is_base("dom") is False


def test_containers(spark):
    rows = spark.createDataFrame([({}, [], (1,)), ({"a": 1}, [None], (2,))], "m map<string,int>, a array<int>, s struct<x:int>")
    ok = lambda name, v: [r[0] for r in rows.select(fr.apply(rows, name, v)["ok"]).collect()]
    assert ok("m", c.is_empty) == [True, False] == ok("a", c.is_empty)
    assert ok("m", c.is_non_empty) == [False, True] == ok("a", c.is_non_empty_array)
    assert ok("a", c.array_of("number")) == [True, False] and ok("a", c.array_of(["number", "null"])) == [True, True]
    assert ok("s", c.is_plain_object) == [True, True] and ok("m", c.is_plain_object) == [False, False]
    assert ok("s", c.is_empty) == [False, False]


def test_combinators(spark):
    rows = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "v double")
    ok = lambda v, name="v": [r[0] for r in rows.select(fr.apply(rows, name, v)["ok"]).collect()]
    assert ok(c.nullable(c.is_positive_number)) == [True, True, False]
    assert ok(c.optional(c.is_positive_number)) == [False, True, False]
    assert ok(c.optional(c.as_string), "gone") == [True] * 3
    assert ok(c.union_of(c.is_positive_number, c.type_check("null"))) == [True, True, False]
    text = spark.createDataFrame([("2024-01-15",), ("x",)], "v string")
    check = c.union_of(c.is_iso_date)(value(text, "v"))
    assert [r[0] is None for r in text.select(check.value_column()).collect()] == [False, True]


def test_python_validator(spark):
    def even(x):
        if x % 2:
            raise ValueError(f"{x} is odd")

    rows = spark.range(3)
    got = rows.select(fr.apply(rows, "id", c.python_validator(even)).alias("c")).collect()
    assert [(r.c.ok, r.c.message) for r in got] == [(True, None), (False, "1 is odd"), (True, None)]


def test_registry(spark):
    r = TypeRegistry()
    assert len(r.list_types()) == 49 == sum(map(len, BASES.values()))
    with pytest.raises(ValueError, match='Type "String" is already registered.'):
        r.register("String", c.as_string)
    r.register(" Positive ", c.is_positive_number)
    version = r.version
    assert "positive" in r.list_types() and '"positive"' in r.export_types()
    with pytest.warns(UserWarning, match="banana"):
        r.import_types('["positive", "banana"]')
    with pytest.raises(ValueError, match="Invalid type list"):
        r.import_types("{}")
    rows = spark.createDataFrame([(1.0,), (-1.0,)], "v double")
    assert [x[0] for x in rows.select(fr.is_(rows, "v", "POSITIVE", r)).collect()] == [True, False]
    r.unregister("positive")
    assert r.version > version
    with pytest.raises(ValueError, match="is not registered"):
        r.unregister("positive")
    with pytest.raises(UnknownTypeError, match="Unknown type: positive"):
        fr.is_(rows, "v", "positive", r)
    with pytest.raises(UnknownTypeError):
        fr.is_(rows, "v", "constructor")
    r.register("number", c.as_string, override=True)
    assert not rows.select(fr.is_(rows, "v", "number", r)).first()[0] and rows.select(fr.is_(rows, "v", "n", r)).first()[0]
    assert r.to_df(spark).count() == 49


@pytest.mark.parametrize(
    ("pattern", "flags", "hits", "misses"),
    [
        (r"^\s+$", "", [" ﻿", "  "], ["\u0085", "a"]), (r"a.b", "", ["a\u0085b", "axb"], ["a\nb", "a b"]), (r"a.b", "s", ["a\nb"], ["ab"]), (r"[^]x", "", ["\nx"], ["x"]),
        (r"[]", "", [], ["", "a"]), (r"\bcat\b", "", ["a cat!", "écat"], ["cats"]), (r"\Bat", "", ["cat"], ["at"]), (r"^b", "m", ["a\nb"], ["ab", "a\u0085b"]), (r"a$", "m", ["a\nb"], ["ab"]), (r"a$", "", ["a"], ["a\n"]),
        (r"\u{1F600}", "u", ["😀"], ["u"]), (r"\p{Script=Greek}", "u", ["α"], ["a"]), (r"[[]", "", ["["], ["]"]), (r"[a&&b]", "", ["&"], ["c"]), (r"É", "i", ["é"], ["e"]), (r"a{", "", ["a{"], ["a"]), (r"a{2}", "", ["aa"], ["a"]),
        (r"[\s,]", "", ["　", ","], ["x"]), (r"\S", "", ["x"], ["　"]), (r"\/", "", ["/"], ["x"]),
    ],
)
def test_patterns_mean_what_they_say(spark, pattern, flags, hits, misses):
    rows = spark.createDataFrame([(x,) for x in [*hits, *misses]], "v string")
    got = {r.v for r in rows.filter(fr.apply(rows, "v", c.matches(pattern, flags))["ok"]).collect()}
    assert got == set(hits)


def test_whole_series(spark):
    rows = spark.createDataFrame([(1,), (None,), (5,)], "v long")
    check = c.python_validator(lambda s: s.map(lambda x: None if x > 2 else "too low"), whole=True)
    assert [tuple(r[0]) for r in rows.select(fr.apply(rows, "v", check)).collect()] == [(False, "too low"), (False, "too low"), (True, None)]
