"""Membership in tables, typed results, schemas named by rows and recursive ones, guards of Python functions, streams, hosts, patterns."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowguard.functions import checks as c
from rowguard.functions.text import ascii_host, is_url, punycode
from rowguard.operators import frame as fr
from rowguard.operators import levels
from rowguard.operators.guard import expect_python
from rowguard.operators.levels import Ref, errors_by_schema, with_validation_by_schema
from rowguard.operators.lookup import in_table
from rowguard.operators.typed import parsed_rows, with_parsed
from rowguard.plans.nodes import Nodes
from rowguard.queries import QUERIES, said_of_words
from rowguard.streaming.validate import Assertions, BatchCount, asserted

TEXT = {"source": "j", "carrier_kind": "variant"}


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


# Membership in tables.


def test_in_table_of_json(spark):
    values = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, None)], "v long")
    words = spark.createDataFrame([("a",), ("b",)], "v string")
    rows = spark.createDataFrame(
        [(i, json.dumps(o) if o is not None else None) for i, o in enumerate([
            {"k": 1, "xs": ["a", "b", "a"]}, {"k": "1", "xs": []}, {"xs": "a"}, {"k": None, "xs": ["a", None, 5, "z"]}, {"k": 2.0, "xs": ["a"], "os": [{"n": 3}, {"n": 4}, {}]}, [1], None,
        ])], "id int, j string",
    )
    schema = {"k": in_table(values), "xs": [in_table(words, nullable=True)], "os": c.optional(c.as_array)}
    found = fr.with_validation(rows, schema, **TEXT)
    assert found.columns == ["id", "j", "is_valid", "errors"]
    says = lambda at, v: f"Validation failed at \"{at}\": {v} must be one of the table's values, is {v}"
    got = {r.id: (r.is_valid, r.errors) for r in found.collect()}
    assert got == {
        0: (True, []), 1: (False, [says("k", 1)]), 2: (False, [says("k", "undefined"), 'Expected "xs" to be an array, got string']), 3: (False, [says("k", "null"), says("xs[2]", 5), says("xs[3]", "z")]), 4: (True, []),
        5: (False, ["Invalid object: must be a non-null object, got array"]), 6: (False, ["Invalid object: must be a non-null object, got undefined"]),
    }
    nested = {"os": [{"n": in_table(values, optional=True)}]}
    assert {r.id: r.errors for r in fr.invalid_rows(rows, nested, **TEXT).filter("id = 4").collect()} == {4: [says("os[1].n", 4)]}
    assert sorted(r.id for r in fr.valid_rows(rows, {"k": in_table(values)}, **TEXT).collect()) == [0, 4]
    assert plan_of(found).count("parseJson") == 1 and " IN (1" not in plan_of(found)


def test_in_table_of_columns(spark):
    values = spark.range(100).select("id")
    kind = "n long, a array<long>, s struct<x: string>, row int"
    rows = spark.createDataFrame([(5, [1, 2], ("x",), 0), (500, [1, 300], None, 1), (None, None, ("y",), 2), (7, [], ("5",), 3), (5, [1, 2], ("x",), 0)], kind)
    schema = {"n": in_table(values, nullable=True), "a": [in_table(values)], "row": "number"}
    found = fr.with_validation(rows, schema, strict=False).orderBy("row").collect()
    assert [r.is_valid for r in found] == [True, True, False, False, True]
    assert found[2].errors == ["Validation failed at \"n\": 500 must be one of the table's values, is 500", "Validation failed at \"a[1]\": 300 must be one of the table's values, is 300"]
    assert found[3].errors == ['Expected "a" to be an array, got null']
    strict = fr.with_validation(rows, {"n": in_table(values, nullable=True)}, strict=True).filter("row = 0").first()
    assert strict.errors == [f'Unexpected key "{k}" in strict mode' for k in ("a", "s", "row")]
    assert fr.with_validation(rows, {"s": {"x": in_table(values)}}).filter("is_valid").count() == 0  # text is no number
    assert fr.with_validation(rows.limit(0), schema).count() == 0
    with pytest.raises(TypeError, match="a join"):
        fr.check_structure(rows, schema)
    with pytest.raises(ValueError):
        in_table(rows)


# Typed results.


def test_typed_results(spark):
    rows = spark.createDataFrame([(json.dumps(o),) for o in [
        {"a": 1, "b": {"c": "x", "d": None}, "e": [1, 2.5], "f": [{"g": True}], "h": {"any": [1]}},
        {"a": "1", "b": {"c": "x"}, "e": [], "f": [], "h": 1},
    ]] + [("no",), (None,)], "j string")
    schema = {"a": "number", "b": {"c": "string", "d": "number?"}, "e": ["number"], "f": [{"g": "boolean", "z": "string?"}], "h": c.as_object}
    found = with_parsed(rows, schema, **TEXT)
    assert found.schema["data"].dataType.simpleString() == "struct<a:double,b:struct<c:string,d:double>,e:array<double>,f:array<struct<g:boolean,z:string>>,h:variant>"
    got = found.collect()
    assert [r.is_valid for r in got] == [True, False, False, False] and [r.data is None for r in got] == [False, True, True, True]
    assert got[0].data.b.asDict() == {"c": "x", "d": None} and got[0].data.e == [1.0, 2.5] and got[0].data.f[0].asDict() == {"g": True, "z": None} and got[0].data.h.toJson() == '{"any":[1]}'
    assert got[1].errors == ['Expected "a" to be number, got string', 'Validation failed at "h": None of the types matched for 1: 1 must be a non-array object, is number']
    assert plan_of(found).count("parseJson") == 1
    assert parsed_rows(rows, {"a": "number"}, **TEXT).collect() == [(1.0,)]
    with pytest.raises(TypeError):
        with_parsed(rows.select(F.length("j").alias("n")), {"a": "number"}, source="n")


def test_what_numbers_lose(spark):
    texts = ["9007199254740993", "9007199254740992", "0.1", "-0.12345678901234567890", "1e400", "123456789012345678901234567890", "1.50", "-0"]
    rows = spark.createDataFrame([(i, f'{{"n": {t}, "xs": [1, {t}]}}') for i, t in enumerate(texts)], "id int, j string")
    found = {texts[r.id]: r.losses for r in with_parsed(rows, {"n": "number", "xs": ["number"]}, **TEXT).collect() if r.is_valid}
    lossy = {t for t, losses in found.items() if losses}
    assert lossy == {"9007199254740993", "-0.12345678901234567890", "123456789012345678901234567890"}
    assert found["9007199254740993"][0].startswith('Number at "n" is 9007199254740993, kept as 9.007199254740992E15') and 'at "xs[1]"' in found["9007199254740993"][1]
    exact = with_parsed(rows, {"n": "number", "xs": ["number"]}, exact=True, **TEXT).filter("is_valid")
    assert {str(r.data.n) for r in exact.filter("id = 0").collect()} == {"9007199254740993.000000000000000000"}
    assert [len(r.losses) for r in exact.filter("id = 5").collect()] == [2]


def test_typed_results_read_only_their_columns(spark, tmp_path):
    made = spark.range(20).select("id", F.parse_json(F.format_string('{"a": %d, "b": {"c": "x"}, "big": "%s"}', "id", F.lit("y" * 300))).alias("v"))
    made.write.parquet(str(tmp_path / "v"))
    found = parsed_rows(spark.read.parquet(str(tmp_path / "v")), {"a": "number", "b": {"c": "string"}}, source="v", carrier_kind="variant")
    plan = found.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "v:variant" not in plan and "big" not in plan
    assert sorted(r.a for r in found.collect()) == list(map(float, range(20)))


# Schemas named by rows, and recursive ones.


def test_each_row_names_its_schema(spark):
    schemas = {
        "a": {"x": "number", "y": ["string?"], "z": {"w": "json|null"}}, "b": {"x": "string?", "n": c.is_positive_number, "bad": 5, "who": "banana|number"},
        "c": {"os": [{"k": "boolean"}], "bb": [["string"]], "o": "object"},
    }
    objs = [
        ("a", {"x": 1, "y": ["s", None], "z": {"w": "[1]"}}), ("a", {"y": [1], "z": {"w": "no json"}}), ("a", {"x": None, "y": {}, "z": []}), ("b", {"x": None, "n": -1, "who": 1}), ("b", {"x": 1, "who": "s"}), ("b", []),
        ("c", {"os": [{"k": True}, {}, 1], "bb": [], "o": None}), ("c", {"os": [], "bb": 1, "o": [1]}), ("none", {}), (None, {}), ("a", None),
    ]
    rows = spark.createDataFrame([(i, n, json.dumps(o), "r") for i, (n, o) in enumerate(objs)], "id int, schema string, j string, row string")
    found = errors_by_schema(rows, schemas, by="schema", source="j", keep=["id"])
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.error)
    one = lambda name, obj: fr.findings(rows, schemas[name], dialect="parse", **TEXT)
    for name in schemas:
        errors = rows.filter(F.col("schema") == name).select("id", one(name, None).errors().alias("e")).collect()
        assert {r.id: r.e for r in errors} == {r.id: got.get(r.id, []) for r in errors}
    assert got[8] == ["Unknown schema: none"] and got[9] == ["Unknown schema: null"]
    whole = with_validation_by_schema(rows, schemas, by="schema", source="j")
    assert whole.columns == [*rows.columns, "is_valid", "errors"]
    assert {r.id: (r.is_valid, r.errors, r.row) for r in whole.collect()} == {i: (i not in got, got.get(i, []), "r") for i in range(len(objs))}


def test_the_plan_does_not_grow_with_schemas(spark):
    rows = spark.createDataFrame([("s1", '{"f1": 1}')], "schema string, j string")
    size = lambda n: len(plan_of(errors_by_schema(rows, {f"s{i}": {f"f{i}": "number", "deep": {"k": ["string"]}} for i in range(n)}, by="schema", source="j", keep=["schema"])))
    assert size(1000) < 1.2 * size(2)
    with pytest.raises(ValueError):
        Nodes({"a": {"x": Ref("gone")}})


def test_recursive_schemas(spark):
    def tree(depth):
        return {"n": "x" if depth % 2 else depth, "kids": [tree(depth - 1), tree(depth - 2)] if depth > 1 else [], "up": None}

    def by_hand(t, path=""):
        at = lambda k: f"{path}.{k}" if path else k
        out = [] if isinstance(t["n"], int) else [f'Expected "{at("n")}" to be number, got string']
        return out + [e for i, k in enumerate(t["kids"]) for e in by_hand(k, f"{at('kids')}[{i}]")]

    trees = [tree(d) for d in (0, 1, 5, 9)]
    rows = spark.createDataFrame([(i, "t", json.dumps(t)) for i, t in enumerate(trees)], "id int, schema string, j string")
    schemas = {"t": {"n": "number", "kids": [Ref("t")], "up": Ref("t", optional=True)}}
    found = with_validation_by_schema(rows, schemas, by="schema", source="j")
    assert {r.id: r.errors for r in found.collect()} == {i: by_hand(t) for i, t in enumerate(trees)}
    assert errors_by_schema(rows.limit(0), schemas, by="schema", source="j", keep=["id"]).count() == 0


def test_recursive_schemas_use_all_cores(spark, monkeypatch):
    """Of rows that lie in one partition too; and neither values nor their schemas' names are dealt out by what all have in common."""
    tasks, cut = [], levels.cut
    monkeypatch.setattr(levels, "cut", lambda frame: (tasks.append(frame.groupBy(F.spark_partition_id()).count().count()), cut(frame))[1])
    text = """concat(repeat('{"n": 1, "kids": [', CAST(id % 7 AS INT)), '{"n": "x", "kids": []}', repeat(']}', CAST(id % 7 AS INT)))"""
    rows = spark.range(0, 700, 1, 1).select("id", F.lit("t").alias("schema"), F.expr(text).alias("j"))
    found = errors_by_schema(rows, {"t": {"n": "number", "kids": [Ref("t")]}}, by="schema", source="j", keep=["id"])
    says = lambda n: f'Expected "{"kids[0]." * n}n" to be number, got string'
    assert {(r.id, r.place, r.error) for r in found.collect()} == {(i, 0, says(i % 7)) for i in range(700)}
    assert min(tasks[:-1]) >= spark.sparkContext.defaultParallelism
    flat = errors_by_schema(rows, {"t": {"n": "number", "kids": [{"n": "number"}]}}, by="schema", source="j", keep=["id"])
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(node" not in plan and "hashpartitioning(name" not in plan


def test_values_of_all_kinds_level_by_level(spark):
    """What is told by taking a value apart: empty ones, nulls and other kinds in the place of objects and arrays."""
    schemas = {"t": {"kids": [Ref("t")], "xs": ["number"], "up": Ref("t", optional=True)}}
    given = [{}, [], None, 5, "s", True]
    rows = spark.createDataFrame([(i, "t", json.dumps({"kids": [], "xs": [], "up": None} | {k: v})) for k in ("kids", "xs", "up") for i, v in enumerate(given)], "id int, schema string, j string").withColumn("id", F.monotonically_increasing_id())
    found = with_validation_by_schema(rows, schemas, by="schema", source="j")
    named = ["object", "array", "null", "number", "string", "boolean"]
    array = lambda key: [[] if n == "array" else [f'Expected "{key}" to be an array, got {n}'] for n in named]
    missing = ['Missing required key "up.kids"', 'Missing required key "up.xs"']
    up = [missing if n == "object" else [] if n == "null" else [f'Expected "up" to be an object, got {n}'] for n in named]
    assert [r.errors for r in sorted(found.collect(), key=lambda r: r.id)] == [*array("kids"), *array("xs"), *up]


def test_messages_on_words_are_not_shuffled(spark, sf_dir):
    """Words of a text go together, once; texts of one doc_id count as one, as the SQL has it, and empty words and texts as well."""
    texts = [(1, "a@b.co  a@b.co\n1.2.3.4 "), (1, "x a@b.co"), (2, ""), (3, None), (4, "1.2.3.4"), (5, " \n"), (None, "x"), (6, "a@b.co")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = said_of_words(docs, {"email": c.is_email, "ipv4": c.is_ipv4})
    md5 = lambda words, what: hashlib.md5("\n".join(sorted(f"{w} must be a valid {what}." for w in words)).encode()).hexdigest()
    want = {1: (["", "1.2.3.4", "x"], ["", "a@b.co", "x"]), 2: ([""], [""]), 4: (["1.2.3.4"], []), 5: ([""], [""]), None: (["x"], ["x"]), 6: ([], ["a@b.co"])}
    assert {r.doc_id: (r.email, r.ipv4) for r in found.collect()} == {k: (md5(e, "email address"), md5(i, "IPv4 address")) for k, (e, i) in want.items()}
    for name in ("str_messages", "str_email"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        below = plan[plan.index("Exchange hashpartitioning") :]
        assert ("Generate" in below) == (name == "str_email") and "must be" not in below


# Guards of Python functions.


def test_guarded_python_functions(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (4, "d")], "n int, s string")
    odd = {1: "text", 4: 2.5}
    guarded = expect_python(lambda n, s: odd.get(int(n), 1 / 0 if n == 3 else None), {"paramTypes": ["number", "string"], "returnType": ["number", "void"]}, "double", report=True)
    got = rows.select(guarded(rows, "n", "s").alias("r")).select("r.*").collect()
    assert [r.value for r in got] == [None, None, None, 2.5]
    assert got[0].error == "Return type mismatch: None of the types matched for text: text must be a number, is string, None of the types matched for text: text must be null"[: len(got[0].error)] or "text must be a number, is string" in got[0].error
    assert got[1].error == "None of the types matched for null: null must be a string, is object" and "must be a number" in got[2].error and got[3].error is None
    many = expect_python(lambda *xs: sum(map(len, xs)), {"paramTypes": "string", "returnType": "number"}, "int")
    fine = rows.filter("n IN (1, 4)").withColumn("t", F.lit("tt"))
    assert [r[0] for r in fine.select(many(fine, "s", "t", "t")).collect()] == [5, 5]
    with pytest.raises(Exception, match="must be a string"):
        rows.select(many(rows, "s")).collect()
    with pytest.raises(TypeError):
        expect_python(len, {"paramTypes": "string", "returnType": "number"}, "string")
    with pytest.raises(TypeError):
        many(rows, "n")
    with pytest.raises(ValueError):
        guarded(rows, "n")


# Streams.


def test_assertions_on_streams(spark, tmp_path):
    for i, values in enumerate(([1, 2, None], [None, None], [5])):
        spark.createDataFrame([(v,) for v in values], "n int").coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    told = Assertions(limit=0.5)
    spark.streams.addListener(told)
    try:
        stream = spark.readStream.schema("n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = asserted(stream, "n", "number", "n is a number").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if len(told.counts.get("n is a number", [])) >= 3:
                break
            told._changed.wait(0.1)
            told._changed.clear()
        assert sorted((b.rows, b.failed) for b in told.counts["n is a number"]) == [(1, 0), (2, 2), (3, 1)]
        assert told.exceeded == {"n is a number"} and isinstance(told.counts["n is a number"][0], BatchCount)
    finally:
        spark.streams.removeListener(told)
    endless = Assertions(limit=0.1)
    spark.streams.addListener(endless)
    try:
        rate = spark.readStream.format("rate").option("rowsPerSecond", 50).load().withColumn("s", F.lit(None).cast("string"))
        query = asserted(rate, "s", "string", "s is text").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).start()
        assert endless.stop_beyond(query) and not query.isActive
    finally:
        spark.streams.removeListener(endless)


# Hosts and patterns.

GOOD = [
    "http://bücher.de/", "https://日本語.jp", "http://ex%41mple.com/", "http://xn--bcher-kva.de/", "http://xn--fa-hia.de", "http://ＷＷＷ.Example.com", "http://😀.com", "http://faß.de", "http://a。b/", "http://xn--e28h.com",
    "http://１２７.0.0.1/", "http://xn--wgbh1c/", "http://münchen:8080/x", "http://xn--maana-pta.com", "http://user@bücher.de/", "non-special://bücher/", "http://a..bücher.de/", "http://bücher.de./",
]
BAD = ["http://xn--/", "http://xn--a/", "http://a％b/", "http://a%zz/", "http://xn--bücher.de", "http://�.com", "http://１２７.0.0.300/", "http://a%20b/", "http://xn--0/x", "http://­/", "http://xn--99999999/", "http://bü cher.de/", "http://bücher.de:99999/"]


def test_international_hosts(spark):
    rows = spark.createDataFrame([(u, True) for u in GOOD] + [(u, False) for u in BAD], "u string, good boolean")
    assert [r.u for r in rows.filter(is_url(F.col("u")) != F.col("good")).collect()] == []
    letters = ["bücher", "mañana", "مصر", "правда", "他们为什么不说中文", "ü", "a-ü-b", "中a文b", "💩x"]
    made = spark.createDataFrame([(w, w.encode("punycode").decode()) for w in letters], "w string, p string")
    assert [(r.w, r.got) for r in made.select("w", punycode(F.col("p")).alias("got")).collect()] == [(w, w) for w in letters]
    assert [r[0] for r in made.select(ascii_host(F.concat("w", F.lit(".org"))).alias("h")).limit(2).collect()] == ["xn--bcher-kva.org", "xn--maana-pta.org"]


PATTERNS = [
    ("(?<=a+)b", "", "aab", True), ("(?<!a{1,3})b", "", "ab", False), ("(?<=\\$)\\d", "", "$5", True), ("k", "i", "K", False), ("k", "iu", "K", True), ("s", "i", "ſ", False), ("I", "i", "ı", False), ("É", "i", "é", True),
    ("^[a-z]+$", "i", "ABC", True), ("(?<=^|,)x", "", "a,x", True), ("\\u{1F600}", "u", "😀", True), ("(?<n>a)\\k<n>", "", "aa", True),
]


@pytest.mark.parametrize("case", range(len(PATTERNS)))
def test_patterns(spark, case):
    """They are taken as they are meant, or refused when the plan is built; none fails when rows are read."""
    pattern, flags, text, want = PATTERNS[case]
    rows = spark.createDataFrame([(text,)], "s string")
    try:
        check = c.matches(pattern, flags)
    except ValueError:
        assert "(?<" in pattern
        return
    assert rows.select(fr.apply(rows, "s", check)["ok"]).first()[0] is want


def test_patterns_that_are_none(spark):
    for pattern in ("[", "(", "(?<=(a|b)*c)*d", "a{2,1}"):
        with pytest.raises(ValueError):
            c.matches(pattern)
