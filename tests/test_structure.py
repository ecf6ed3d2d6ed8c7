"""Golden error texts, the two dialects, carriers, plans."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowguard import Schema, TypeRegistry, UnknownTypeError, UnsupportedTypeError, expect, to_struct_type
from rowguard.functions import checks as c
from rowguard.operators import frame as fr
from rowguard.operators.guard import verified
from rowguard.functions.values import value


def errors(spark, schema, obj, **how):
    rows = spark.createDataFrame([(json.dumps(obj),)], "j string")
    return rows.select(fr.findings(rows, schema, source="j", carrier_kind="variant", **how).errors()).first()[0]


BOTH = [
    ({"a": "string"}, {}, ['Missing required key "a"']),
    ({"a": "string"}, {"a": None}, ['Expected "a" to be string, got null']),
    ({"a": "string?"}, {"a": None}, []),
    ({"a": "string?"}, {}, []),
    ({"a": "string|number"}, {"a": True}, ['Expected "a" to be one of [string, number], got boolean']),
    ({"a": " string | number "}, {"a": 1}, []),
    ({"a": "string||number"}, {"a": 1}, []),
    ({"a": ["number"]}, {"a": [1, "two", 3]}, ['Expected "a[1]" to be number, got string']),
    ({"a": ["number"]}, {"a": {}}, ['Expected "a" to be an array, got object']),
    ({"a": [{"n": "string"}]}, {"a": [{"n": "x"}, {}, 3]}, ['Missing required key "a[1].n"', 'Expected "a[2]" to be an object, got number']),
    ({"a": {"b": {"c": "number"}}}, {"a": {"b": {"c": "x"}}}, ['Expected "a.b.c" to be number, got string']),
    ({"a": {"b": "number"}}, {"a": [1]}, ['Expected "a" to be an object, got array']),
    ({"a": ""}, {"a": 1}, ['Empty type definition at "a"']),
    ({"a": "|"}, {"a": 1}, ['Invalid type definition "|" at "a"']),
    ({"a": []}, {"a": [1]}, ['Empty array schema definition at "a"']),
    ({"a": ["string", "number"]}, {"a": [1]}, ['Array schema must have exactly one element type definition at "a"']),
    ({"a": [123]}, {"a": [1]}, ['Array element type must be a string at "a"']),
    ({"a": [["string"]]}, {"a": [1]}, ['Array element type must be a string at "a"']),
    ({"a": 123}, {"a": 1}, ['Invalid schema definition at "a": expected string, array, or object, got number']),
    ({"a": None}, {"a": 1}, ['Invalid schema definition at "a": expected string, array, or object, got null']),
    ({"a": True}, {"a": 1}, ['Invalid schema definition at "a": expected string, array, or object, got boolean']),
    ({"a": "undefined"}, {}, ['Missing required key "a"']),
    ({"a.b": "number"}, {"a.b": 1}, []),
    ({'q"x': "number"}, {'q"x': "s"}, ['Expected "q"x" to be number, got string']),
    ({"a": c.is_positive_integer}, {"a": -1}, ['Validation failed at "a": -1 must be a positive integer.']),
    ({"a": c.optional(c.as_string)}, {}, []),
    ({"a": [c.is_hex_color]}, {"a": ["#fff", "x"]}, ['Validation failed at "a[1]": x must be a valid hex color.']),
]


@pytest.mark.parametrize("case", range(len(BOTH)))
def test_both_dialects(spark, case):
    schema, obj, want = BOTH[case]
    assert errors(spark, schema, obj) == want == errors(spark, schema, obj, dialect="parse")


APART = [
    ({"a": "banana"}, {"a": 1}, ['Expected "a" to be banana, got number'], ["Unknown type: banana"]),
    ({"a": "banana|number"}, {"a": 1}, [], ["Unknown type: banana"]),
    ({"a": "number|banana"}, {"a": 1}, [], []),
    ({"a": ["string?"]}, {"a": ["x", None]}, ['Expected "a[0]" to be string?, got string', 'Expected "a[1]" to be string?, got null'], []),
    ({"a": []}, {}, ['Missing required key "a"'], ['Empty array schema definition at "a"']),
    ({"a": "?"}, {}, [], ['Invalid type definition "?" at "a"']),
    ({"a": "?"}, {"a": 1}, ['Empty type definition at "a"'], ['Invalid type definition "?" at "a"']),
    ({"a": [123]}, {"a": 1}, ['Expected "a" to be an array, got number'], ['Array element type must be a string at "a"']),
    ({"a": "string? "}, {"a": "x"}, ['Expected "a" to be string?, got string'], ["Unknown type: string?"]),
]


@pytest.mark.parametrize("case", range(len(APART)))
def test_dialects_apart(spark, case):
    schema, obj, structure, parse = APART[case]
    assert errors(spark, schema, obj) == structure
    assert errors(spark, schema, obj, dialect="parse") == parse


def test_roots(spark):
    for obj, kind in (([1], "array"), (None, "null"), ("s", "string"), (5, "number"), (True, "boolean")):
        assert errors(spark, {"a": "string"}, obj) == [f"Invalid object: must be a non-null object, got {kind}"]
    assert errors(spark, [], {}) == ["Invalid schema: must be a non-null object"]


def test_strict(spark):
    schema = {"data": {"items": ["number"]}}
    assert errors(spark, schema, {"data": {"items": [1], "extra": 1}, "more": 2}, strict=True) == ['Unexpected key "data.extra" in strict mode', 'Unexpected key "more" in strict mode']
    with pytest.raises(ValueError):
        errors(spark, schema, {}, strict=True, dialect="parse")


def test_carriers_agree(spark):
    """A struct, a map, a row and JSON text of the same object have the same errors."""
    schema = {"id": "number", "name": "string", "tags": ["string"], "addr": {"zip": "string?", "city": "string"}, "gone": "number?"}
    objs = [
        {"id": 1, "name": "a", "tags": ["x"], "addr": {"zip": None, "city": "c"}},
        {"id": None, "name": None, "tags": None, "addr": None},
        {"id": 2, "name": "b", "tags": ["x", None], "addr": {"zip": "z", "city": None}},
    ]
    kind = "id long, name string, tags array<string>, addr struct<zip:string,city:string>"
    rows = spark.createDataFrame([(o["id"], o["name"], o["tags"], o["addr"]) for o in objs], kind)
    rows = rows.select("*", F.struct("*").alias("s"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    row = rows.select(fr.findings(rows, schema).errors().alias("e"))
    struct = rows.select(fr.findings(rows, schema, source="s").errors().alias("e"))
    text = rows.select(fr.findings(rows, schema, source="j", carrier_kind="variant").errors().alias("e"))
    got = [r.e for r in row.collect()]
    assert got == [r.e for r in struct.collect()] == [r.e for r in text.collect()]
    assert got[2] == ['Expected "tags[1]" to be string, got null', 'Expected "addr.city" to be string, got null'] and got[0] == []
    maps = spark.createDataFrame([({"a": 1},), ({"a": None},), ({"b": 1},), (None,)], "m map<string,int>")
    found = fr.findings(maps, {"a": "number"}, source="m", carrier_kind="map", strict=True)
    assert [r[0] for r in maps.select(found.errors()).collect()] == [
        [], ['Expected "a" to be number, got null'], ['Missing required key "a"', 'Unexpected key "b" in strict mode'], ["Invalid object: must be a non-null object, got null"],
    ]


def test_splits_and_reports(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "n int, s string")
    schema = Schema({"n": "number", "s": "string"})
    assert [r.is_valid for r in fr.with_validation(rows, schema).collect()] == [True, False, False]
    assert fr.valid_rows(rows, schema).count() == 1
    assert [r.errors for r in fr.invalid_rows(rows, schema).collect()] == [['Expected "n" to be number, got null'], ['Expected "s" to be string, got null']]
    assert fr.error_report(rows, schema).count() == 2
    assert rows.select(fr.check_structure(rows, schema).alias("c")).first().c.is_valid
    with pytest.raises(TypeError):
        schema["n"] = "string"


def test_parse(spark):
    rows = spark.createDataFrame([(1.0, "a"), (-1.0, "b")], "n double, s string")
    assert rows.select(fr.parse(rows, {"n": "number"}).alias("r")).collect()[0].r.n == 1.0
    assert [r[0] for r in rows.select(fr.parse(rows, ["string", "number"], source="s")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="must be a positive number"):
        rows.select(fr.parse(rows, c.is_positive_number, source="n")).collect()
    with pytest.raises(Exception, match="Validation failed"):
        rows.select(fr.parse(rows, {"gone": "number"})).collect()
    with pytest.raises(TypeError, match="Invalid first argument"):
        fr.parse(rows, 5)
    got = [r.p for r in rows.select(fr.safe_parse(rows, {"n": c.is_positive_number}).alias("p")).collect()]
    assert got[0].success and got[0].data.s == "a" and not got[1].success and got[1].data is None
    assert got[1].error == 'Validation failed:\n  - Validation failed at "n": -1 must be a positive number.'


def test_validate_is_flat(spark):
    rows = spark.createDataFrame([("a", None, [1])], "s string, z string, a array<int>")
    got = rows.select(fr.validate(rows, {"s": ["number", "boolean"], "z": "string", "a": "string", "u": "number"})).first()[0]
    assert got == ['Expected "s" to be of type number,boolean, got string', 'Expected "z" to be of type string, got object', 'Expected "a" to be of type string, got object', 'Expected "u" to be of type number, got undefined']
    with pytest.raises(UnknownTypeError):
        fr.validate(rows, {"s": "string?"})


def test_assert_counts(spark, caplog):
    rows = spark.createDataFrame([(1,), (None,)], "n int")
    watched, seen = fr.assert_type(rows, "n", "number")
    assert watched.count() == 2
    with caplog.at_level("WARNING"):
        assert fr.warn(seen, "n", "number") == 1
    assert "Expected number" in caplog.text
    with pytest.raises(UnknownTypeError):
        fr.assert_type(rows, "n", "banana")


def test_as_type(spark):
    rows = spark.createDataFrame([("a",), (None,)], "s string")
    some = rows.filter("s IS NOT NULL")
    assert some.select(fr.as_type(some, "s", "string")).first()[0] == "a"
    with pytest.raises(Exception, match="None of the types matched for null"):
        rows.select(fr.as_type(rows, "s", "string")).collect()
    assert [r[0] for r in rows.select(fr.is_(rows, "s", [])).collect()] == [False, False]


def test_guards(spark):
    rows = spark.createDataFrame([("a", 1, True, [1], {"k": 1})], "s string, n int, b boolean, a array<int>, m map<string,int>")
    got = rows.select(fr.is_string(rows, "s"), fr.is_number(rows, "n"), fr.is_boolean(rows, "b"), fr.is_array(rows, "a"), fr.is_object(rows, "m"), fr.is_object(rows, "a")).first()
    assert list(got) == [True] * 5 + [False]
    got = rows.select(fr.as_string(rows, "s"), fr.as_number(rows, "n"), fr.as_boolean(rows, "b"), fr.as_array(rows, "a"), fr.as_object(rows, "m")).first()
    assert list(got) == ["a", 1, True, [1], {"k": 1}]
    assert list(rows.select(*[fr.kind_name(rows, c) for c in "snbam"]).first()) == ["string", "number", "boolean", "array", "map"]


def test_expect(spark):
    rows = spark.createDataFrame([(2.0, 3.0, "x")], "a double, b double, s string")
    times = expect(lambda a, b: a * b, {"paramTypes": ["number", "number"], "returnType": "number"})
    assert rows.select(times(rows, "a", "b")).first()[0] == 6
    with pytest.raises(ValueError, match="Expected 2 arguments, but got 1"):
        times(rows, "a")
    with pytest.raises(TypeError, match="never"):
        times(rows, "a", "s")
    many = expect(lambda *xs: sum(xs[1:], xs[0]), {"paramTypes": "number", "returnType": ["string", "number"]})
    assert rows.select(many(rows, "a", "b", "b")).first()[0] == 8
    wrong = expect(lambda a: a.cast("string"), {"paramTypes": ["number"], "returnType": "number"})
    with pytest.raises(Exception, match="Return type mismatch"):
        rows.select(wrong(rows, "a")).collect()
    with pytest.raises(ValueError, match="Expected 2 types"):
        expect(lambda: None, {"paramTypes": []})
    with pytest.raises(ValueError, match="Expected paramType"):
        expect(lambda: None, {"paramTypes": [], "returnType": ""})
    with pytest.raises(TypeError, match="must be a function"):
        expect(5, {"paramTypes": [], "returnType": "void"})
    nulls = spark.createDataFrame([(None,)], "v string")
    assert nulls.select(verified(value(nulls, "v"), ["void"])).first()[0] is None
    with pytest.raises(Exception, match="Return type mismatch"):
        nulls.select(verified(value(nulls, "v"), [])).collect()


def test_to_struct_type():
    got = to_struct_type({"id": "number", "email": "string?", "tags": ["string"], "addr": {"zip": "string?"}, "any": "string|number", "n": "string|null", "big": "bi", "f": c.as_string, "x": "banana"})
    want = {"id": T.DoubleType(), "email": T.StringType(), "tags": T.ArrayType(T.StringType(), False), "addr": T.StructType([T.StructField("zip", T.StringType(), True)]), "any": T.VariantType(), "n": T.StringType(), "big": T.DecimalType(38, 0), "f": T.VariantType(), "x": T.VariantType()}
    assert {f.name: f.dataType for f in got} == want
    assert not got["id"].nullable and got["email"].nullable and got["n"].nullable
    with pytest.raises(UnsupportedTypeError):
        to_struct_type({"f": "symbol"})


def test_registry_changes_reach_compiled_schemas(spark):
    registry = TypeRegistry()
    rows = spark.createDataFrame([(1.0,)], "n double")
    how = {"registry": registry, "dialect": "parse"}
    assert rows.select(fr.findings(rows, {"n": "odd"}, **how).errors()).first()[0] == ["Unknown type: odd"]
    registry.register("odd", c.is_integer)
    assert rows.select(fr.findings(rows, {"n": "odd"}, **how).errors()).first()[0] == []


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    """Predicates reach the scan, columns are pruned, and no Python runs."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(fr.valid_rows(rows, {"l_linenumber": c.in_range(1, 3), "l_partkey": "number"}).select("l_partkey"))
    assert "GreaterThanOrEqual(l_linenumber,1)" in text and "LessThanOrEqual(l_linenumber,3)" in text
    assert "l_extendedprice" not in text
    text = plan(fr.with_validation(rows, {"l_linenumber": "number", "l_returnflag": "string"}))
    assert "Python" not in text and "Exchange" not in text


def test_streams(spark, sf_dir, tmp_path):
    from rowguard.streaming.validate import error_counts, split_to, validated

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    schema = {"value": "number", "event_type": "string"}
    split_to(stream(), schema, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert bad.count() == events.filter("value is null").count() and bad.count() + spark.read.parquet(str(tmp_path / "ok")).count() == events.count()
    q = validated(stream(), schema).writeStream.format("memory").queryName("flags").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("flags").filter("NOT is_valid").count() == bad.count()
    q = error_counts(stream(), schema, "ts", "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("count")).first()[0] == bad.count()


def test_json_source(spark, tmp_path):
    from rowguard.sources.json_text import read_json_lines, with_payload, write_split

    lines = ['{"k": 1}', '{"k": "x"}', "{broken", "", '{"k": 1} x']
    (tmp_path / "lines.json").write_text("\n".join(lines))
    rows = read_json_lines(spark, str(tmp_path / "lines.json"))
    assert [r.is_json for r in rows.orderBy(F.monotonically_increasing_id()).collect()] == [True, True, False, False, False]
    write_split(rows.drop("is_json"), {"k": "number"}, str(tmp_path / "ok"), str(tmp_path / "bad"), source="raw", carrier_kind="variant")
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 4
    assert with_payload(rows, "raw").columns == ["raw", "payload", "is_json"]


def test_registries_and_validators_that_are_gone(spark):
    """What was compiled for one is never taken for another that came later in its place."""
    rows = spark.createDataFrame([(1.5,)], "n double")
    for n in range(100):
        registry = TypeRegistry()
        registry.register("odd", c.is_integer if n % 2 else c.is_number if hasattr(c, "is_number") else c.as_number)
        found = fr.findings(rows, {"n": "odd"}, registry=registry).valid()
        assert ("rint" in str(found).lower()) == bool(n % 2)
        del registry
        low = float(n)
        found = fr.findings(rows, {"n": c.in_range(low, 1000)}).valid()
        assert str(low) in str(found)


def test_variants_are_taken_apart_once(spark):
    """Each field is got once and its kind once; no filter moves below."""
    rows = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}, "d": [1, "y"], "e": null}', 1), ("[1]", 2), ("nope", 3), (None, 4)], "j string, n int")
    schema = {"a": "number", "b": {"c": "string", "f": "number?"}, "d": ["number"], "e": "string|null"}
    found = fr.with_validation(rows, schema, source="j", carrier_kind="variant")
    assert found.columns == ["j", "n", "is_valid", "errors"]
    for frame in (found, found.filter("is_valid").select("n"), fr.valid_rows(rows, schema, source="j", carrier_kind="variant")):
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        assert text.count('$["') <= 7 and text.count("parseJson") <= 1 and text.count("schemaOfVariant") <= 9
    got = {r.n: r.errors for r in found.collect()}
    assert got == {1: ['Expected "d[1]" to be number, got string'], **{k: [f"Invalid object: must be a non-null object, got {t}"] for k, t in ((2, "array"), (3, "undefined"), (4, "undefined"))}}
    assert {r.n for r in fr.invalid_rows(rows, schema, source="j", carrier_kind="variant").collect()} == {1, 2, 3, 4}
    assert fr.check_structure(rows, schema, source="j", carrier_kind="variant") is not None


def test_one_of_table(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "n int, v string")
    for values, ok in ((["a", "a", "b"], {1}), (["a", None], {1, 2}), ([], set())):
        got = fr.one_of_table(rows, "v", spark.createDataFrame([(x,) for x in values], "w string")).collect()
        assert {r.n for r in got if r.ok} == ok and len(got) == 3
        assert all((r.message is None) == r.ok for r in got)
    assert [r.message for r in got if r.n == 3] == ["z must be one of 0 values, is z"]


def test_built_ins_first(spark):
    rows = spark.createDataFrame([("x",)], "v string")
    for first in (False, True):
        registry = TypeRegistry(builtins_first=first)
        registry.register("string", c.is_integer, override=True)
        assert rows.select(fr.is_(rows, "v", "string", registry)).first()[0] == first


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_parsed_once(spark):
    """However many entries a schema has, and in whichever front end."""
    rows = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}, "e": [1]}',), ("[]",), ("no",)], "j string")
    schema = {"a": "number", "b": {"c": "string", "d": "number?"}, "e": ["number"], "f": "string|null"}
    how = {"source": "j", "carrier_kind": "variant"}
    plans = [
        rows.select(fr.check_structure(rows, schema, **how)), rows.select(fr.safe_parse(rows, schema, **how)), rows.select(fr.parse(rows, schema, **how)),
        rows.select(fr.validate(rows, {"a": "number", "b": ["string", "object"]}, **how)), rows.select(fr.safe_parse(rows, ["number", "string"], **how)),
        fr.with_validation(rows, schema, **how), fr.valid_rows(rows, schema, **how), fr.with_validation(rows, schema, **how).filter("is_valid"),
    ]
    assert [plan_of(p).count("parseJson") for p in plans] == [1] * len(plans)
    assert plan_of(plans[0]).count("try_variant_get") <= 16
    found = rows.select(fr.check_structure(rows, schema, **how).alias("r")).select("r.*").collect()
    assert [r.errors for r in found] == [['Missing required key "f"'], ["Invalid object: must be a non-null object, got array"], ["Invalid object: must be a non-null object, got undefined"]]
    assert [r.errors for r in fr.with_validation(rows, schema, **how).collect()] == [r.errors for r in found]


def test_what_is_no_json_passes_nothing(spark):
    """Text that goes on after a value is no JSON, even where the first value would pass."""
    rows = spark.createDataFrame([('{"a": 1},{"b": 2}',), ('{"a": 1} x',), ('{"a": 1}',), ('{"A": 1}',), ('{"a.b": 1, "a": 2}',), (None,)], "j string")
    how = {"source": "j", "carrier_kind": "variant"}
    assert [r.j for r in fr.valid_rows(rows, {"a": "number"}, **how).collect()] == ['{"a": 1}', '{"a.b": 1, "a": 2}']
    assert [r.j for r in fr.valid_rows(rows, {"a": "number?", "A": "number?"}, **how).collect()] == ['{"a": 1}', '{"A": 1}', '{"a.b": 1, "a": 2}']
    odd = {'q"x': "number?", "b`c": {"d e": "number?"}}
    named = spark.createDataFrame([('{"q\\"x": 1, "b`c": {"d e": 2}}',), ('{"q\\"x": "s", "b`c": {}}',), ('{"b`c": {"d e": "s"}}',)], "j string")
    assert [r.errors for r in fr.with_validation(named, odd, **how).collect()] == [[], ['Expected "q"x" to be number, got string'], ['Expected "b`c.d e" to be number, got string']]
    assert [r.errors for r in fr.invalid_rows(rows, {}, **how).collect()] == [["Invalid object: must be a non-null object, got undefined"]] * 3


def test_only_what_a_schema_names_is_read(spark, tmp_path):
    """Of a shredded VARIANT, and nothing of the root where something has to be there."""
    rows = spark.range(50).select("id", F.parse_json(F.format_string('{"a": %d, "b": {"c": "x", "z": "%s"}, "e": [1], "big": "%s"}', "id", F.lit("y" * 50), F.lit("y" * 200))).alias("v"))
    rows.write.parquet(str(tmp_path / "v"))
    read = spark.read.parquet(str(tmp_path / "v"))
    schema = {"a": c.in_range(10, 20), "b": {"c": "string"}, "e": ["number"]}
    kept = fr.valid_rows(read, schema, source="v", carrier_kind="variant").select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    asked = plan[plan.index("ReadSchema"):]
    assert asked.count("variant") == 4 and "v:variant" not in asked  # a, b.c, e and its first element
    assert sorted(r.id for r in kept.collect()) == list(range(10, 21))
    other = spark.createDataFrame([(1, '{"a": 12, "b": [], "e": [1]}'), (2, "[1]"), (3, "null"), (4, None), (5, "{}")], "id long, j string").select("id", F.parse_json("j").alias("v"))
    both = read.unionByName(other)
    found = {r.id: r.errors for r in fr.invalid_rows(both.filter("id < 10"), schema, source="v", carrier_kind="variant").filter("id > 0").collect() if r.id in (1, 2, 3, 4, 5)}
    assert len(found) == 5
    assert [r.errors for r in fr.invalid_rows(other, schema, source="v", carrier_kind="variant").orderBy("id").collect()][1:4] == [[f"Invalid object: must be a non-null object, got {k}"] for k in ("array", "null", "undefined")]
