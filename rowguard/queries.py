"""The registered queries, one for each kind of operation, and their SQL.

The test tables are clean, so queries soil them with expressions that Spark
and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks as c
from .functions.registry import BASES, TypeRegistry
from .functions.text import json_value
from .functions.values import value
from .operators import frame as fr
from .operators.levels import Ref, errors_by_schema
from .operators.lookup import in_table
from .operators.typed import with_parsed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def checked(frame: DataFrame, keys: list[str], source: str, validator: c.Validator) -> DataFrame:
    """keys, ok, message of a validator on a column."""
    found = fr.apply(frame, source, validator)
    return frame.select(*keys, found["ok"].alias("ok"), found["message"].alias("message"))


#: A double as the messages write it, in SQL, for numbers of everyday size.
_TEXT = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"


def judged(keys: str, source: str, ok: str, message: str, origin: str) -> str:
    return f"SELECT {keys}, ({ok}) AS ok, CASE WHEN NOT ({ok}) THEN {message} END AS message FROM (SELECT {keys}, {source} AS v FROM {origin})"


# Types of values.

_JSON = """CASE event_id % 9 WHEN 0 THEN '"text"' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"a": 1}' WHEN 3 THEN 'true' WHEN 4 THEN 'null'
    WHEN 5 THEN '1.5' WHEN 6 THEN '42' WHEN 7 THEN '"[1]"' ELSE props END"""
_KIND = "json_type(v)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_value(F.expr(_JSON)).alias("v"))


_IS = {
    "string": f"{_KIND} = 'VARCHAR'", "array": f"{_KIND} = 'ARRAY'", "object": f"{_KIND} IN ('OBJECT', 'NULL')", "boolean": f"{_KIND} = 'BOOLEAN'",
    "null": f"{_KIND} = 'NULL'", "number": f"{_KIND} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')", "json": f"{_KIND} = 'VARCHAR' AND json_valid(v ->> '$')",
}


@query("SELECT event_id, " + ", ".join(f"{_IS.get(b, 'false')} AS is_{b}" for b in BASES) + f" FROM (SELECT event_id, CAST({_JSON} AS JSON) AS v FROM events)")
def type_is_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every base type on values of every kind."""
    return fr.with_types(_values(spark, sf_dir), "v", {f"is_{b}": b for b in BASES}).drop("v")


@query("""SELECT c_custkey, typeof(c_custkey) IN ('INTEGER', 'BIGINT') AS is_number, typeof(big) LIKE 'DECIMAL%' AND big IS NOT NULL AS is_bigint, typeof(c_name) = 'VARCHAR' AND c_name IS NOT NULL AS name_is_string,
      typeof(c_name) IN ('INTEGER', 'BIGINT', 'DOUBLE') AS name_is_number, none IS NULL AS none_is_null, none IS NULL AS none_is_object, typeof(day) = 'DATE' AS day_is_date, typeof(list) LIKE '%[]' AS list_is_array, c_custkey IS NOT NULL AS missing
    FROM (SELECT c_custkey, c_name, CAST(c_custkey AS DECIMAL(20, 0)) AS big, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS none, DATE '2024-01-01' AS day, [c_name] AS list FROM customer)""")
def type_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on typed columns, where most answers are known in the plan."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_custkey").cast("decimal(20,0)").alias("big"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("none"),
        F.make_date(F.lit(2024), F.lit(1), F.lit(1)).alias("day"), F.array("c_name").alias("list"),
    )
    is_ = lambda name, t, as_: fr.is_(rows, name, t).alias(as_)
    return rows.select(
        "c_custkey", is_("c_custkey", "n", "is_number"), is_("big", "bint", "is_bigint"), is_("c_name", " Str ", "name_is_string"), is_("c_name", "num", "name_is_number"),
        is_("none", "null", "none_is_null"), is_("none", "obj", "none_is_object"), is_("day", "dt", "day_is_date"), is_("list", "arr", "list_is_array"), is_("nothing", "undef", "missing"),
    )


@query(f"SELECT event_id, {_IS['number']} OR {_IS['string']} AS ok, false AS none FROM (SELECT event_id, CAST({_JSON} AS JSON) AS v FROM events)")
def is_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, sf_dir)
    return rows.select("event_id", fr.is_(rows, "v", ["number", "string"]).alias("ok"), fr.is_(rows, "v", []).alias("none"))


_V_TEXT = "CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN '1,2' WHEN 'OBJECT' THEN '[object Object]' ELSE v ->> '$' END"
_V_TYPEOF = "CASE WHEN json_type(v) IN ('NULL', 'ARRAY', 'OBJECT') THEN 'object' WHEN json_type(v) = 'VARCHAR' THEN 'string' WHEN json_type(v) = 'BOOLEAN' THEN 'boolean' ELSE 'number' END"


@query(f"""SELECT event_id, ok, CASE WHEN NOT ok THEN 'None of the types matched for ' || t || ': ' || t || ' must be a string, is ' || o || ', ' || t || ' must be an array, is ' || o END AS message
    FROM (SELECT event_id, {_V_TEXT} AS t, {_V_TYPEOF} AS o, json_type(v) IN ('VARCHAR', 'ARRAY') AS ok FROM (SELECT event_id, CAST({_JSON} AS JSON) AS v FROM events))""")
def is_type_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(_values(spark, sf_dir), ["event_id"], "v", c.type_check(["string", "array"]))


#: What each base type says of a value that is not of it, in SQL; the object's text asks for arrays too.
_SAID = {
    "array": "an array, is ", "array_buffer": "an ArrayBuffer.", "bigint": "a bigint, is ", "boolean": "a boolean, is ", "data_view": "a DataView.", "date": "a valid Date.", "dom": "a DOM element, is ",
    "function": "a function, is ", "map": "a Map.", "number": "a number, is ", "null": "null.", "object": "a non-array object, is ", "regex": "a RegExp.", "set": "a Set.", "string": "a string, is ",
    "symbol": "a symbol, is ", "typed_array": "a TypedArray.", "undefined": "undefined, is ",
}


def _says_sql(base: str) -> str:
    if base == "json":
        return "CASE WHEN json_type(v) = 'VARCHAR' THEN t || ' must be a valid JSON string.' ELSE 'None of the types matched for ' || t || ': ' || t || ' must be a string, is ' || o END"
    kind = "" if _SAID[base].endswith(".") else " || CASE WHEN json_type(v) = 'ARRAY' THEN 'array' ELSE o END" if base == "object" else " || o"
    return f"t || ' must be {_SAID[base]}'{kind}"


@query("SELECT event_id, " + ", ".join(f"CASE WHEN NOT ({_IS.get(b, 'false')}) THEN {_says_sql(b)} END AS says_{b}" for b in BASES) + f" FROM (SELECT event_id, v, {_V_TEXT} AS t, {_V_TYPEOF} AS o FROM (SELECT event_id, CAST({_JSON} AS JSON) AS v FROM events))")
def checker_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own message of every base type's checker on values of every kind."""
    rows = _values(spark, sf_dir)
    return rows.select("event_id", *[fr.apply(rows, "v", lambda v, b=b: c.of_type(b, v))["message"].alias(f"says_{b}") for b in BASES])


@query("SELECT c_custkey, c_name AS s, c_acctbal AS n, c_acctbal > 0 AS b, c_name || '|' || c_mktsegment AS a, c_nationkey AS o FROM customer")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as_string and the like, on values that pass: they come back as they are."""
    rows = table(spark, sf_dir, "customer").select("*", (F.col("c_acctbal") > 0).alias("b"), F.array("c_name", "c_mktsegment").alias("a"), F.struct("c_nationkey").alias("o"))
    own = [fr.as_string(rows, "c_name").alias("s"), fr.as_number(rows, "c_acctbal").alias("n"), fr.as_boolean(rows, "b").alias("b"), F.array_join(fr.as_array(rows, "a"), "|").alias("a"), fr.as_object(rows, "o")["c_nationkey"].alias("o")]
    return rows.select("c_custkey", *own)


_GUARDS = {"string": "a string", "number": "a number", "boolean": "a boolean", "array": "an array", "object": "a non-array object"}


@query("SELECT event_id, " + ", ".join(
    f"CASE WHEN NOT ({_IS[b]}) THEN 'None of the types matched for ' || t || ': ' || t || ' must be {what}, is ' || " + ("CASE WHEN json_type(v) = 'ARRAY' THEN 'array' ELSE o END" if b == "object" else "o") + f" END AS not_{b}" for b, what in _GUARDS.items()
) + f" FROM (SELECT event_id, v, {_V_TEXT} AS t, {_V_TYPEOF} AS o FROM (SELECT event_id, CAST({_JSON} AS JSON) AS v FROM events))")
def guard_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What as_string and the like would fail with, on values of every kind."""
    rows = _values(spark, sf_dir)
    checks = {"string": c.as_string, "number": c.as_number, "boolean": c.as_boolean, "array": c.as_array, "object": c.as_object}
    return rows.select("event_id", *[fr.apply(rows, "v", check)["message"].alias(f"not_{b}") for b, check in checks.items()])


@query("""SELECT c_custkey, n IS NOT NULL AS is_instance, CASE WHEN n IS NULL THEN 'null must be an instance of StringType.' END AS instance_message, false AS is_promise, coalesce(n, 'null') || ' must be a Promise.' AS promise_message
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS n FROM customer)""")
def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("n"))
    one, other = fr.apply(rows, "n", c.is_instance_of(T.StringType)), fr.apply(rows, "n", c.is_promise)
    return rows.select("c_custkey", one["ok"].alias("is_instance"), one["message"].alias("instance_message"), other["ok"].alias("is_promise"), other["message"].alias("promise_message"))


@query("SELECT count(*) FILTER (WHERE c_acctbal < 0) AS failed, count(*) AS rows FROM customer")
def assert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `assert_type` counts while the rows are counted: nothing fails."""
    registry = TypeRegistry()
    registry.register("positive", c.is_positive_number)
    rows, seen = fr.assert_type(table(spark, sf_dir, "customer"), "c_acctbal", "positive", registry)
    n = rows.count()
    return spark.createDataFrame([(seen.get["failed"], n)], "failed long, rows long")


_REGISTERED = ", ".join(f"('{a}', '{b}')" for b, own in BASES.items() for a in own if b != "dom") + ", ('even', NULL)"


@query(f"""SELECT name, base, CASE WHEN name = 'even' THEN (SELECT count(*) FROM customer WHERE c_acctbal % 2 = 0) WHEN base = 'number' THEN (SELECT count(*) FROM customer) ELSE 0 END AS balances,
      CASE WHEN base IN ('string') THEN (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) WHEN base IN ('null') THEN (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0)
        WHEN base = 'object' THEN (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) ELSE 0 END AS names
    FROM (VALUES {_REGISTERED}) AS t(name, base)""")
def registry_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types after some are removed, one is added and the list has gone out and in as JSON, and how many customers' balances and names are of each."""
    registry = TypeRegistry()
    for name in ("dom", " DomEl ", "domelement"):
        registry.unregister(name)
    registry.register("Even", lambda v: c.Check(F.coalesce(v.number() % 2 == 0, F.lit(False)) if v.is_kind("number") is not False else False, "must be even", v))
    registry.import_types(registry.export_types())
    rows = table(spark, sf_dir, "customer").select("c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"))
    types = registry.list_types()
    each = lambda column: [F.count_if(fr.is_(rows, column, t, registry)).alias(f"{column}{i}") for i, t in enumerate(types)]
    counts = rows.agg(*each("c_acctbal"), *each("name"))
    found = F.explode(F.array(*[F.struct(F.lit(t).alias("name"), F.lit(b if isinstance(b := registry.resolve(t), str) else None).cast("string").alias("base"), F.col(f"c_acctbal{i}").alias("balances"), F.col(f"name{i}").alias("names")) for i, t in enumerate(types)]))
    return counts.select(found.alias("one")).select("one.*")


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events")
def return_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that is a number or, as "void" allows, nothing."""
    from .operators.guard import verified

    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return rows.select("event_id", verified(value(rows, "v"), ["number", "void"]).alias("v"))


def _no_tenths(x) -> None:
    if x is None or x != round(x):
        raise ValueError(f"{x} has tenths")


@query("SELECT l_orderkey, l_linenumber, q = round(q) AS ok, CASE WHEN q <> round(q) THEN CAST(q AS VARCHAR) || ' has tenths' END AS message FROM (SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN l_linenumber = 2 THEN 0.5 ELSE 0 END AS q FROM lineitem)")
def python_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validator that is a Python function."""
    rows = table(spark, sf_dir, "lineitem").select(*_LINE, (F.col("l_quantity") + F.when(F.col("l_linenumber") == 2, 0.5).otherwise(0.0)).alias("q"))
    return checked(rows, _LINE, "q", c.python_validator(_no_tenths))


# Numbers.

_QUANTITY = "CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 4 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 5 THEN l_quantity + 0.5 ELSE l_quantity END"
_LINE = ["l_orderkey", "l_linenumber"]
_SHOWN = f"CASE WHEN isnan(v) THEN 'NaN' WHEN isinf(v) THEN CASE WHEN v > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE {_TEXT.format('v')} END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_LINE, F.expr(_QUANTITY).alias("v"))


def _numbers(name: str, validator: c.Validator, ok: str, says: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checked(_lines(spark, sf_dir), _LINE, "v", validator)

    run.__name__ = name
    query(judged("l_orderkey, l_linenumber", _QUANTITY, ok, f"{_SHOWN} || {says}", "lineitem"))(run)


_numbers("num_in_range", c.in_range(5, 40), "isnan(v) OR v BETWEEN 5 AND 40", f"' must be between 5 and 40, is ' || {_SHOWN}")
_numbers("num_integer", c.is_integer, "isfinite(v) AND v = round(v)", "' must be an integer.'")
_numbers("num_safe_integer", c.is_safe_integer, "isfinite(v) AND v = round(v) AND abs(v) <= 9007199254740991", "' must be a safe integer.'")
_numbers("num_finite", c.is_finite_number, "isfinite(v)", "' must be a finite number.'")

_BALANCE = "CASE WHEN c_custkey % 10 = 0 THEN 0.0 WHEN c_custkey % 2 = 0 THEN round(c_acctbal) - 2000 ELSE c_acctbal - 2000.25 END"


def _balances(name: str, validator: c.Validator, ok: str, says: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"CAST({_BALANCE} AS DOUBLE)").alias("v"))
        return checked(rows, ["c_custkey"], "v", validator)

    run.__name__ = name
    query(judged("c_custkey", f"CAST({_BALANCE} AS DOUBLE)", ok, f"{_TEXT.format('v')} || {says}", "customer"))(run)


_balances("num_positive", c.is_positive_number, "v >= 0", "' must be a positive number.'")
_balances("num_negative", c.is_negative_number, "v < 0", "' must be a negative number.'")
_balances("num_positive_integer", c.is_positive_integer, "v = round(v) AND v >= 0", "CASE WHEN v = round(v) THEN ' must be a positive integer.' ELSE ' must be an integer.' END")
_balances("num_negative_integer", c.is_negative_integer, "v = round(v) AND v < 0", "CASE WHEN v = round(v) THEN ' must be a positive integer.' ELSE ' must be an integer.' END")


@query("SELECT count(*) AS rows, sum(l_extendedprice) AS price FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber BETWEEN 1 AND 3")
def pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows by a predicate that reaches the scan."""
    rows = table(spark, sf_dir, "lineitem")
    kept = fr.valid_rows(rows.filter("l_quantity BETWEEN 10 AND 20"), {"l_linenumber": c.in_range(1, 3), "l_extendedprice": "number"})
    return kept.agg(F.count("*").alias("rows"), F.sum("l_extendedprice").alias("price"))


# Strings.


def _split(text: str | Column) -> Column:
    return F.split(text, " |\n")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(_split("text"))).alias("v")).distinct()


def _on_tokens(name: str, validator: c.Validator, ok: str) -> None:
    """The words of all documents that pass."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _tokens(spark, sf_dir)
        return rows.filter(fr.apply(rows, "v", validator)["ok"])

    run.__name__ = name
    query(f"SELECT DISTINCT doc_id, v FROM (SELECT doc_id, unnest(regexp_split_to_array(text, ' |\\n')) AS v FROM documents) WHERE {ok}")(run)


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_SQL = rf"regexp_full_match(v, '{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}')"
_on_tokens("str_email", c.is_email, r"regexp_full_match(v, '[^\s@]+@[^\s@]+\.[^\s@]+')")
_on_tokens("str_ipv4", c.is_ipv4, _IPV4_SQL)
_on_tokens(
    "str_phone",
    c.is_phone_number,
    r"regexp_full_match(v, '(\+?[1-9][0-9]{0,3})?[\s\-.]?(\(?[0-9]{1,4}\)?[\s\-.]?)?[0-9\s\-.()]{6,}') AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND NOT contains(v, '..') AND NOT contains(v, '--')",
)


_PHONE_SHAPE = r"regexp_full_match(v, '(\+?[1-9][0-9]{0,3})?[\s\-.]?(\(?[0-9]{1,4}\)?[\s\-.]?)?[0-9\s\-.()]{6,}')"
_DIGITS = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
_PHONE_OK = f"({_PHONE_SHAPE} AND {_DIGITS} BETWEEN 7 AND 15 AND NOT contains(v, '..') AND NOT contains(v, '--'))"
_SAID_OF_ALL = "md5(coalesce(string_agg({0}, chr(10) ORDER BY {0}), ''))"


@query(rf"""SELECT doc_id, {_SAID_OF_ALL.format('email')} AS email, {_SAID_OF_ALL.format('ipv4')} AS ipv4, {_SAID_OF_ALL.format('phone')} AS phone FROM (
      SELECT doc_id, CASE WHEN NOT regexp_full_match(v, '[^\s@]+@[^\s@]+\.[^\s@]+') THEN v || ' must be a valid email address.' END AS email, CASE WHEN NOT {_IPV4_SQL} THEN v || ' must be a valid IPv4 address.' END AS ipv4,
        CASE WHEN NOT {_PHONE_OK} THEN CASE WHEN {_PHONE_SHAPE} AND regexp_matches(v, '[0-9+]') AND NOT {_DIGITS} BETWEEN 7 AND 15 THEN v || ' must be a valid phone number with 7-15 digits.' ELSE v || ' must be a valid phone number.' END END AS phone
      FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, ' |\n')) AS v FROM documents)) GROUP BY doc_id""")
def str_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is said of the words of each document that are no address or number."""
    return said_of_words(table(spark, sf_dir, "documents"), {"email": c.is_email, "ipv4": c.is_ipv4, "phone": c.is_phone_number})


def said_of_words(docs: DataFrame, validators: dict[str, c.Validator]) -> DataFrame:
    """doc_id and, for each validator, the digest of its messages on the distinct words of all texts of this doc_id.

    The words of a text are shuffled once, as lines of one string, half the size of an array. Messages,
    many times as large, stay in the row.
    """
    words = docs.filter("text IS NOT NULL").select("doc_id", F.array_join(F.array_distinct(_split("text")), "\n").alias("words"))
    rows = words.groupBy("doc_id").agg(F.array_distinct(_split(F.array_join(F.collect_list("words"), "\n"))).alias("words"))
    says = {n: value(rows, "words").each(lambda v, _, check=check: check(v).column()["message"]) for n, check in validators.items()}
    return rows.select("doc_id", *[F.md5(F.array_join(F.sort_array(own), "\n")).alias(n) for n, own in says.items()])


def _on_events(name: str, source: str, validator: c.Validator, ok: str, says: str | None = None) -> None:
    """Strings made from the numbers of events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select("event_id", F.expr(source.replace("VARCHAR", "STRING")).alias("v"))
        return checked(rows, ["event_id"], "v", validator)

    run.__name__ = name
    query(judged("event_id", source, ok, f"v || '{says}'" if says else "NULL", "events"))(run)


_ID = "CAST(event_id AS VARCHAR)"
_HEX = f"lpad({_ID}, 8, '0')"
_on_events("str_nonempty", f"CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN concat(chr(9), chr(160), chr(10)) ELSE {_ID} END", c.is_non_empty_string, "event_id % 4 > 1", " must be a non-empty string.")
_on_events("str_matches", f"concat('ab', {_ID}, CASE WHEN event_id % 5 = 0 THEN chr(10) ELSE '' END)", c.matches("^AB[0-9]+7$", "i"), "regexp_matches(v, '^ab[0-9]+7$')", " must match /^AB[0-9]+7$/i.")
_on_events("str_uuid", f"concat({_HEX}, '-00ab-', CAST(event_id % 7 AS VARCHAR), 'abc-', CASE WHEN event_id % 3 = 0 THEN 'C' ELSE '9' END, '00a-0123456789Ab')", c.is_uuid, "event_id % 7 BETWEEN 1 AND 5 AND event_id % 3 <> 0", " must be a valid UUID.")
_on_events("str_hex", f"concat('#', substr('{'0aF' * 4}', 1, CAST(event_id % 10 AS INT)))", c.is_hex_color, "event_id % 10 IN (3, 4, 6, 8)", " must be a valid hex color.")
_on_events("str_ipv6", f"CASE event_id % 6 WHEN 0 THEN concat('::', {_ID}) WHEN 1 THEN concat('2001:db8::', {_ID}) WHEN 2 THEN '1:2:3:4:5:6:7:8' WHEN 3 THEN concat('::ffff:10.0.0.', CAST(event_id % 300 AS VARCHAR)) WHEN 4 THEN '1::2::3' ELSE {_ID} END", c.is_ipv6, "CASE event_id % 6 WHEN 0 THEN event_id < 10000 WHEN 1 THEN event_id < 10000 WHEN 2 THEN true WHEN 3 THEN event_id % 300 < 256 ELSE false END", " must be a valid IPv6 address.")
_on_events("str_base64", f"CASE event_id % 5 WHEN 0 THEN 'aGVsbG8=' WHEN 1 THEN 'YWJjZA==' WHEN 2 THEN 'aGVsbG8' WHEN 3 THEN {_HEX} ELSE 'a_-b' END", c.is_base64(), "event_id % 5 IN (0, 1) OR event_id % 5 = 3 AND event_id < 100000000", " must be a valid Base64 string.")
_on_events("str_url", f"CASE event_id % 8 WHEN 0 THEN concat('https://h', {_ID}, '.org/a?b#c') WHEN 1 THEN concat('http://h.org:', {_ID}, '00') WHEN 2 THEN concat('h.org/', {_ID}) WHEN 3 THEN 'http://' WHEN 4 THEN concat('mailto:u', {_ID}, '@h.org') WHEN 5 THEN 'http://a b.org/' WHEN 6 THEN 'http://[::1]:80/x' ELSE concat('ftp://10.0.0.', CAST(event_id % 400 AS VARCHAR)) END", c.is_url, "CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN event_id * 100 <= 65535 WHEN 4 THEN true WHEN 6 THEN true WHEN 7 THEN event_id % 400 < 256 ELSE false END", " must be a valid URL.")


_URL = "CASE page_id % 4 WHEN 0 THEN replace(url, '://', ':///') WHEN 1 THEN replace(url, '://', '') WHEN 2 THEN replace(url, '.example', ' example') ELSE url END"


@query(judged("page_id", _URL, "v LIKE '%:/%' AND v NOT LIKE '% %'", "v || ' must be a valid URL.'", "pages"))
def str_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urls of pages: with a slash too many, without a scheme, with a blank in the host, and as they are."""
    return checked(table(spark, sf_dir, "pages").select("page_id", F.expr(_URL).alias("v")), ["page_id"], "v", c.is_url)


_DATE = "concat('20', lpad(CAST(event_id % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST(event_id % 14 AS VARCHAR), 2, '0'), '-', lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0'), CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'T10:30:00Z' ELSE 'T10:30:15.25+01:00' END)"


@query(f"""SELECT event_id, event_id % 14 BETWEEN 1 AND 12 AS ok, CAST(CASE WHEN event_id % 14 BETWEEN 1 AND 12 THEN
    epoch_ms(make_timestamp(2000 + event_id % 100, event_id % 14, event_id % 28 + 1, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 9 END, CASE event_id % 3 WHEN 0 THEN 0 ELSE 30 END, CASE event_id % 3 WHEN 2 THEN 15.25 ELSE 0 END)) ELSE -1 END AS BIGINT) AS at_ms
    FROM (SELECT event_id, {_DATE} AS v FROM events)""")
def str_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_DATE.replace("VARCHAR", "STRING")).alias("v"))
    check = c.is_iso_date(value(rows, "v"))
    return rows.select("event_id", check.column()["ok"].alias("ok"), F.coalesce(F.unix_millis(check.value_column()), F.lit(-1)).alias("at_ms"))


# Containers.

_LIST = "CASE WHEN event_id % 5 = 0 THEN '[]' WHEN event_id % 5 = 1 THEN '[1, \"two\", 3]' WHEN event_id % 5 = 2 THEN '{}' WHEN event_id % 5 = 3 THEN '\"  \"' ELSE '[1, 2]' END"


def _on_lists(name: str, validator: c.Validator, ok: str, says: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select("event_id", json_value(F.expr(_LIST)).alias("v"))
        return checked(rows, ["event_id"], "v", validator)

    run.__name__ = name
    query(f"SELECT event_id, ok, CASE WHEN NOT ok THEN {says} END AS message FROM (SELECT event_id, event_id % 5 AS k, {ok} AS ok FROM events)")(run)


_NO_ARRAY = "'None of the types matched for ' || CASE k WHEN 2 THEN '[object Object]' ELSE '  ' END || ': ' || CASE k WHEN 2 THEN '[object Object]' ELSE '  ' END || ' must be an array, is ' || CASE k WHEN 2 THEN 'object' ELSE 'string' END"
_on_lists("arr_of", c.array_of("number"), "event_id % 5 IN (0, 4)", f"CASE WHEN k = 1 THEN 'None of the types matched for two: two must be a number, is string' ELSE {_NO_ARRAY} END")
_on_lists("arr_nonempty", c.is_non_empty_array, "event_id % 5 IN (1, 4)", f"CASE WHEN k = 0 THEN ' must be a non-empty array.' ELSE {_NO_ARRAY} END")
_on_lists("len_bounds", c.has_length(1, 2), "event_id % 5 IN (3, 4)", "CASE k WHEN 0 THEN 'length must be >= 1, is 0' WHEN 1 THEN 'length must be <= 2, is 3' ELSE '[object Object] must be a string or array, is object' END")
_on_lists("is_empty", c.is_empty, "event_id % 5 IN (0, 2, 3)", "'array must be empty.'")
_on_lists("is_nonempty", c.is_non_empty, "event_id % 5 IN (1, 4)", "CASE k WHEN 0 THEN 'array must be non-empty.' WHEN 2 THEN 'object must have at least one own key.' ELSE 'string must be non-empty.' END")
_on_lists("is_plain_object", c.is_plain_object, "event_id % 5 = 2", "CASE k WHEN 0 THEN ' must be a plain object (no class instances).' WHEN 1 THEN '1,two,3 must be a plain object (no class instances).' WHEN 4 THEN '1,2 must be a plain object (no class instances).' ELSE '   must be a plain object, is string' END")


@query("SELECT vec_id, len(embedding) > 0 AS filled, len(embedding) BETWEEN 1 AND 16 AS short, true AS numbers FROM embeddings")
def arr_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    ok = lambda check: fr.apply(rows, "embedding", check)["ok"]
    return rows.select("vec_id", ok(c.is_non_empty_array).alias("filled"), ok(c.has_length(1, 16)).alias("short"), ok(c.array_of("number")).alias("numbers"))


@query("SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS ok, CASE WHEN NOT o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority || ' must be one of [1-URGENT, 2-HIGH, 3], is ' || o_orderpriority END AS message FROM orders")
def one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderpriority", c.one_of(["1-URGENT", "2-HIGH", 3]))


_BROKEN = "CASE WHEN event_id % 6 = 0 THEN concat(props, ' x') WHEN event_id % 6 = 1 THEN '{k: 1}' WHEN event_id % 6 = 2 THEN '' WHEN event_id % 6 = 3 THEN '01' WHEN event_id % 6 = 4 THEN '  \"s\" ' ELSE props END"
_on_events("json_valid_strict", _BROKEN, c.type_check("json"), "json_valid(v)")
ORACLE_SQL["json_valid_strict"] = judged("event_id", _BROKEN, "json_valid(v)", "'None of the types matched for ' || v || ': ' || v || ' must be a valid JSON string.'", "events")


@query("""SELECT o_orderkey, v IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS ok,
      CASE WHEN v NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN v || ' must be one of ' || (SELECT count(*) FROM customer WHERE c_acctbal > 0) || ' values, is ' || v END AS message
    FROM (SELECT o_orderkey, o_custkey AS v FROM orders)""")
def one_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a table's values, by a join."""
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    return fr.one_of_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", known).select("o_orderkey", "ok", "message")


_OWNED = """concat('{"owner": {"id": ', o_custkey, '}, "parts": [', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(o_custkey % 97, ', ', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN ', "x", null' ELSE '' END) END, '], "by": "', o_orderpriority, '"}')"""
_NOT_KNOWN = " || ' must be one of the table''s values, is ' || "


@query(f"""WITH j AS (SELECT o_orderkey, CAST({_OWNED} AS JSON) AS v FROM orders), found AS (
      SELECT o_orderkey, 0 AS rule, 0 AS i, 'owner.id' AS path, v -> '$.owner.id' AS x FROM j
      UNION ALL SELECT o_orderkey, 1, i, 'parts[' || i || ']', x FROM (SELECT o_orderkey, unnest(range(CAST(json_array_length(v, '$.parts') AS BIGINT))) AS i, unnest(json_extract(v, '$.parts[*]')) AS x FROM j)
      UNION ALL SELECT o_orderkey, 2, 0, 'by', v -> '$.by' FROM j)
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY rule, i) - 1 AS place, 'Validation failed at "' || path || '": ' || t {_NOT_KNOWN} t AS error
    FROM (SELECT *, coalesce(x ->> '$', 'null') AS t, CASE WHEN json_type(x) NOT IN ('VARCHAR', 'NULL') THEN CAST(x AS BIGINT) END AS n FROM found)
    WHERE CASE rule WHEN 0 THEN n NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) WHEN 1 THEN json_type(x) <> 'NULL' AND (n IS NULL OR n NOT IN (SELECT p_partkey FROM part)) ELSE t NOT IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 450000) END""")
def in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys within nested objects and arrays that have to be in other tables, and words that have to be in this one."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_OWNED).alias("payload"))
    customers, parts = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"), table(spark, sf_dir, "part").select("p_partkey")
    words = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select("o_orderpriority")
    schema = {"owner": {"id": in_table(customers)}, "parts": [in_table(parts, nullable=True)], "by": in_table(words)}
    found = fr.errors_in(rows, schema, source="payload", carrier_kind="variant")
    return found.select("o_orderkey", F.col("place").cast("long").alias("place"), "error")


# Combinators.


@query("""SELECT event_id, k IS NULL OR k >= 50 AS ok, CASE WHEN NOT (k IS NULL OR k >= 50) THEN k || ' must be between 50 and 100, is ' || k END AS message
    FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(props ->> '$.k' AS BIGINT) END AS k FROM events)""")
def comb_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that some objects do not have."""
    rows = table(spark, sf_dir, "events").select("event_id", json_value(F.expr("CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END")).alias("v"))
    return checked(rows, ["event_id"], "v.k", c.optional(c.in_range(50, 100)))


@query("SELECT event_id, n IS NULL OR n >= 50 AS nullable, CASE WHEN n IS NULL OR n >= 50 THEN n END AS kept FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS n FROM events)")
def comb_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("n"))
    check = c.nullable(c.in_range(50, 1e12))(value(rows, "n"))
    ok = check.column()["ok"]
    return rows.select("event_id", ok.alias("nullable"), F.when(ok, check.value_column()).alias("kept"))


@query(f"""SELECT event_id, ok, CASE WHEN NOT ok THEN 'Value did not match any union variant: None of the types matched for ' || t || ': ' || t || ' must be a number, is ' || o || ', None of the types matched for ' || t || ': ' || t || ' must be a string, is ' || o END AS message
    FROM (SELECT event_id, {_V_TEXT} AS t, {_V_TYPEOF} AS o, {_IS['number']} OR {_IS['string']} AS ok FROM (SELECT event_id, CAST({_JSON} AS JSON) AS v FROM events))""")
def comb_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(_values(spark, sf_dir), ["event_id"], "v", c.union_of(c.as_number, c.as_string))


# Structures.

_SOILED = """CASE WHEN event_id % 7 = 0 THEN '{"k": "bad"}' WHEN event_id % 7 = 1 THEN '{}' WHEN event_id % 7 = 2 THEN '{"k": null}' WHEN event_id % 7 = 3 THEN '[1]' ELSE props END"""


def _payloads(spark: SparkSession, sf_dir: str, text: str = _SOILED) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(text.replace("VARCHAR", "STRING")).alias("payload"))


def _errors(rows: DataFrame, schema, **how) -> DataFrame:
    found = fr.errors_in(rows, schema, source="payload", carrier_kind="variant", **how)
    return found.select("event_id", F.col("place").cast("long").alias("place"), "error")


@query(f"""SELECT event_id, CAST(0 AS BIGINT) AS place, CASE WHEN json_type(v) <> 'OBJECT' THEN 'Invalid object: must be a non-null object, got array'
      WHEN json_type(v, '$.k') IS NULL THEN 'Missing required key "k"' WHEN json_type(v, '$.k') = 'NULL' THEN 'Expected "k" to be number, got null'
      ELSE 'Expected "k" to be number, got string' END AS error
    FROM (SELECT event_id, CAST({_SOILED} AS JSON) AS v FROM events) WHERE event_id % 7 < 4""")
def structure_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads against {"k": "number"}: each error with its row."""
    return _errors(_payloads(spark, sf_dir), {"k": "number"})


#: Kinds of JSON values as messages name them.
_NAMED = "CASE {0} WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
_TYPE_OF = lambda path: f"json_type(v, '$.{path}')"


_NESTED = """CASE event_id % 6 WHEN 0 THEN '{"user": {"name": "n", "age": 3}, "ok": true}' WHEN 1 THEN '{"user": {"age": "x"}, "ok": 1}' WHEN 2 THEN '{"user": [], "ok": null}'
    WHEN 3 THEN '{"ok": false}' WHEN 4 THEN '{"user": {"name": null, "age": null}, "ok": true}' ELSE '{"user": null}' END"""
_NESTED_SCHEMA = {"user": {"name": "string", "age": "number?"}, "ok": "boolean|null"}


def _table_of(errors: dict[int, list[str]], modulus: int) -> str:
    """SQL of the rows (event_id, place, error) that each remainder of event_id has."""
    rows = ", ".join(f"({k}, {i}, '{e}')" for k, own in errors.items() for i, e in enumerate(own))
    return f"SELECT event_id, CAST(place AS BIGINT) AS place, error FROM events JOIN (VALUES {rows}) AS e(k, place, error) ON event_id % {modulus} = k"


@query(f"""WITH j AS (SELECT event_id, v, {_TYPE_OF('user')} AS u, {_TYPE_OF('user.name')} AS n, {_TYPE_OF('user.age')} AS a, {_TYPE_OF('ok')} AS ok FROM (SELECT event_id, CAST({_NESTED} AS JSON) AS v FROM events)), found AS (
      SELECT event_id, 1 AS rule, CASE WHEN u IS NULL THEN 'Missing required key "user"' WHEN u <> 'OBJECT' THEN 'Expected "user" to be an object, got ' || {_NAMED.format('u')} END AS error FROM j
      UNION ALL SELECT event_id, 2, CASE WHEN n IS NULL THEN 'Missing required key "user.name"' WHEN n <> 'VARCHAR' THEN 'Expected "user.name" to be string, got ' || {_NAMED.format('n')} END FROM j WHERE u = 'OBJECT'
      UNION ALL SELECT event_id, 3, CASE WHEN {_NAMED.format('a')} <> 'number' THEN 'Expected "user.age" to be number, got ' || {_NAMED.format('a')} END FROM j WHERE u = 'OBJECT' AND coalesce(a, 'NULL') <> 'NULL'
      UNION ALL SELECT event_id, 4, CASE WHEN ok IS NULL THEN 'Missing required key "ok"' WHEN ok NOT IN ('BOOLEAN', 'NULL') THEN 'Expected "ok" to be one of [boolean, null], got ' || {_NAMED.format('ok')} END FROM j)
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY rule) - 1 AS place, error FROM found WHERE error IS NOT NULL""")
def structure_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(_payloads(spark, sf_dir, _NESTED), _NESTED_SCHEMA)


_ARRAYS = """CASE event_id % 5 WHEN 0 THEN '{"xs": [1, "two", 3, null], "os": [{"n": "a"}, {}, 5]}' WHEN 1 THEN '{"xs": [], "os": []}' WHEN 2 THEN '{"xs": {}, "os": "o"}' WHEN 3 THEN '{}' ELSE '{"xs": [1.5], "os": [{"n": "a"}]}' END"""
_ELEMENTS = "unnest(range(CAST(json_array_length(v, '$.{0}') AS BIGINT))) AS i, json_type(unnest(json_extract(v, '$.{0}[*]'))) AS x, json_type(unnest(json_extract(v, '$.{0}[*]')), '$.n') AS n"


@query(f"""WITH j AS (SELECT event_id, v, {_TYPE_OF('xs')} AS xs, {_TYPE_OF('os')} AS os FROM (SELECT event_id, CAST({_ARRAYS} AS JSON) AS v FROM events)), found AS (
      SELECT event_id, 1 AS rule, 0 AS i, CASE WHEN xs IS NULL THEN 'Missing required key "xs"' WHEN xs <> 'ARRAY' THEN 'Expected "xs" to be an array, got ' || {_NAMED.format('xs')} END AS error FROM j
      UNION ALL SELECT event_id, 1, i, CASE WHEN {_NAMED.format('x')} <> 'number' THEN 'Expected "xs[' || i || ']" to be number, got ' || {_NAMED.format('x')} END FROM (SELECT event_id, {_ELEMENTS.format('xs')} FROM j WHERE xs = 'ARRAY')
      UNION ALL SELECT event_id, 2, 0, CASE WHEN os IS NULL THEN 'Missing required key "os"' WHEN os <> 'ARRAY' THEN 'Expected "os" to be an array, got ' || {_NAMED.format('os')} END FROM j
      UNION ALL SELECT event_id, 2, i, CASE WHEN x <> 'OBJECT' THEN 'Expected "os[' || i || ']" to be an object, got ' || {_NAMED.format('x')} WHEN n IS NULL THEN 'Missing required key "os[' || i || '].n"' WHEN n <> 'VARCHAR' THEN 'Expected "os[' || i || '].n" to be string, got ' || {_NAMED.format('n')} END
        FROM (SELECT event_id, {_ELEMENTS.format('os')} FROM j WHERE os = 'ARRAY'))
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY rule, i) - 1 AS place, error FROM found WHERE error IS NOT NULL""")
def structure_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(_payloads(spark, sf_dir, _ARRAYS), {"xs": ["number"], "os": [{"n": "string"}]})


_EVENT = """concat('{"id": ', event_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE concat(', "type": ', CASE WHEN user_id % 7 = 0 THEN '17' ELSE concat('"', event_type, '"') END) END,
    ', "value": ', CASE WHEN value < 20 THEN 'null' WHEN value < 60 THEN concat('"', event_type, '"') ELSE '2.5' END, ', "props": ', CASE WHEN event_type = 'error' THEN '[]' WHEN event_type = 'click' THEN '{}' ELSE props END,
    ', "tags": [', CASE WHEN value > 100 THEN '"a", ' WHEN value > 50 THEN 'true, ' ELSE '' END, CASE WHEN user_id % 2 = 0 THEN '"b"' ELSE 'null' END, ']}')"""
_EVENT_SCHEMA = {"id": "number", "type": "string", "value": "number|null", "props": {"k": "number"}, "tags": ["string"]}


@query(f"""WITH j AS (SELECT event_id, CAST({_EVENT} AS JSON) AS v FROM events), found AS (
      SELECT event_id, 1 AS rule, 0 AS i, CASE WHEN {_TYPE_OF('type')} IS NULL THEN 'Missing required key "type"' WHEN {_TYPE_OF('type')} <> 'VARCHAR' THEN 'Expected "type" to be string, got ' || {_NAMED.format(_TYPE_OF('type'))} END AS error FROM j
      UNION ALL SELECT event_id, 2, 0, CASE WHEN {_TYPE_OF('value')} NOT IN ('NULL', 'DOUBLE', 'UBIGINT', 'BIGINT') THEN 'Expected "value" to be one of [number, null], got ' || {_NAMED.format(_TYPE_OF('value'))} END FROM j
      UNION ALL SELECT event_id, 3, 0, CASE WHEN {_TYPE_OF('props')} <> 'OBJECT' THEN 'Expected "props" to be an object, got ' || {_NAMED.format(_TYPE_OF('props'))} WHEN {_TYPE_OF('props.k')} IS NULL THEN 'Missing required key "props.k"' END FROM j
      UNION ALL SELECT event_id, 4, i, CASE WHEN json_type(x) <> 'VARCHAR' THEN 'Expected "tags[' || i || ']" to be string, got ' || {_NAMED.format('json_type(x)')} END
        FROM (SELECT event_id, unnest(range(CAST(json_array_length(v, '$.tags') AS BIGINT))) AS i, unnest(json_extract(v, '$.tags[*]')) AS x FROM j))
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY rule, i) - 1 AS place, error FROM found WHERE error IS NOT NULL""")
def structure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of what the events hold, and errors that SQL works out from the same JSON."""
    return _errors(_payloads(spark, sf_dir, _EVENT), _EVENT_SCHEMA)


_EXTRAS = """CASE event_id % 3 WHEN 0 THEN '{"data": {"items": [1], "extra": 1}}' WHEN 1 THEN '{"data": {"items": ["a"]}, "b": 1, "a": 2}' ELSE '{"data": {"items": []}}' END"""


@query(_table_of({0: ['Unexpected key "data.extra" in strict mode'], 1: ['Expected "data.items[0]" to be number, got string', 'Unexpected key "a" in strict mode', 'Unexpected key "b" in strict mode']}, 3))
def structure_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(_payloads(spark, sf_dir, _EXTRAS), {"data": {"items": ["number"]}}, strict=True)


@query(_table_of({0: ['Unknown type: banana'], 1: ['Unknown type: banana'], 2: ['Missing required key "a"', 'Missing required key "e"']}, 3))
def parse_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown names, and optional elements, as `parse` has them."""
    text = """CASE event_id % 3 WHEN 0 THEN '{"a": 1, "b": 1, "e": ["x", null]}' WHEN 1 THEN '{"a": "s", "b": null, "e": []}' ELSE '{}' END"""
    return _errors(_payloads(spark, sf_dir, text), {"a": "banana|number", "b": "number?", "e": ["string?"]}, dialect="parse")


@query(f"""SELECT event_id, event_id % 7 > 3 AS success, CASE WHEN event_id % 7 < 4 THEN 'Validation failed:' || chr(10) || '  - ' || CASE event_id % 7 WHEN 0 THEN 'Expected "k" to be number, got string' WHEN 1 THEN 'Missing required key "k"'
      WHEN 2 THEN 'Expected "k" to be number, got null' ELSE 'Invalid object: must be a non-null object, got array' END END AS error, CASE WHEN event_id % 7 > 3 THEN {_SOILED} END AS data FROM events""")
def safe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir)
    found = rows.select("event_id", fr.safe_parse(rows, {"k": "number"}, source="payload", carrier_kind="variant").alias("found"))
    return found.select("event_id", "found.success", "found.error", "found.data")


_KEYED = """concat('{"id": ', CASE WHEN value < 30 THEN 'null' ELSE CAST(event_id AS VARCHAR) END, ', "f', user_id % 200 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, '": ', CASE WHEN event_id % 3 = 0 THEN '7' ELSE '"s"' END, ', "deep": {"', event_type, '": [', CASE WHEN value > 80 THEN '1, true' ELSE '2' END, ']}}')"""
_NAME = "CASE WHEN event_id % 13 = 0 THEN 'none' ELSE concat(event_type, '-', user_id % 200) END"


@query(f"""WITH j AS (SELECT event_id, event_type, user_id % 200 AS k, {_NAME} AS name, CAST({_KEYED} AS JSON) AS v FROM events), found AS (
      SELECT event_id, 0 AS rule, 0 AS i, 'Unknown schema: none' AS error FROM j WHERE name = 'none'
      UNION ALL SELECT event_id, 1, 0, 'Expected "id" to be number, got null' FROM j WHERE name <> 'none' AND json_type(v, '$.id') = 'NULL'
      UNION ALL SELECT event_id, 2, 0, CASE WHEN json_type(v, '$.f' || k) IS NULL THEN 'Missing required key "f' || k || '"' ELSE 'Expected "f' || k || '" to be one of [string, boolean], got number' END
        FROM j WHERE name <> 'none' AND coalesce(json_type(v, '$.f' || k), '') <> 'VARCHAR'
      UNION ALL SELECT event_id, 3, i, 'Expected "deep.' || event_type || '[' || i || ']" to be number, got boolean'
        FROM (SELECT event_id, event_type, name, unnest(range(CAST(json_array_length(v -> 'deep' -> event_type) AS BIGINT))) AS i, unnest(json_extract(v -> 'deep' -> event_type, '$[*]')) AS x FROM j) WHERE name <> 'none' AND json_type(x) = 'BOOLEAN')
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY rule, i) - 1 AS place, error FROM found""")
def schema_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that each name one of a thousand schemas, in one pass."""
    events = table(spark, sf_dir, "events")
    rows = events.select("event_id", F.expr(_NAME).alias("name"), F.expr(_KEYED.replace("VARCHAR", "STRING")).alias("payload"))
    kinds = [r.event_type for r in events.select("event_type").distinct().collect()]  # a handful
    schemas = {f"{kind}-{k}": {"id": "number", f"f{k}": "string|boolean", "deep": {kind: ["number"]}} for kind in kinds for k in range(200)}
    return errors_by_schema(rows, schemas, by="name", source="payload", keep=["event_id"])


_DEEP = """concat(repeat('{"name": "a", "kids": [{"name": null, "kids": []}, ', CAST(c_custkey % 9 AS INT)), CASE WHEN c_custkey % 2 = 0 THEN '{"name": "z", "kids": 1}' ELSE '{"kids": [5], "of": null}' END, repeat(']}', CAST(c_custkey % 9 AS INT)))"""


@query("""WITH found AS (
      SELECT c_custkey, i, 0 AS rule, 'Expected "' || repeat('kids[1].', i) || 'kids[0].name" to be string, got null' AS error FROM (SELECT c_custkey, unnest(range(c_custkey % 9)) AS i FROM customer)
      UNION ALL SELECT c_custkey, 99, 1, 'Expected "' || repeat('kids[1].', c_custkey % 9) || 'kids" to be an array, got number' FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT c_custkey, 99, 1, 'Missing required key "' || repeat('kids[1].', c_custkey % 9) || 'name"' FROM customer WHERE c_custkey % 2 = 1
      UNION ALL SELECT c_custkey, 99, 2, 'Expected "' || repeat('kids[1].', c_custkey % 9) || 'kids[0]" to be an object, got number' FROM customer WHERE c_custkey % 2 = 1)
    SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY i, rule) - 1 AS place, error FROM found""")
def schema_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of a depth that only the rows know, against a schema that refers to itself."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("tree").alias("name"), F.expr(_DEEP).alias("payload"))
    tree = {"name": "string", "kids": [Ref("tree")], "of": Ref("tree", optional=True)}
    return errors_by_schema(rows, {"tree": tree}, by="name", source="payload", keep=["c_custkey"])


_ORDER = """concat('{"key": ', o_orderkey, ', "price": ', CASE WHEN o_orderkey % 7 = 0 THEN '"none"' ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) END, ', "who": {"id": ', o_custkey, ', "note": ', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat('"n', o_custkey, '"') END,
    '}, "big": 90071992547409', o_orderkey % 100, ', "tags": [{"n": "', o_orderpriority, '", "w": 0.5}', CASE WHEN o_orderkey % 2 = 0 THEN ', {"n": "x"}' ELSE '' END, '], "any": [1, "two"], "more": true}')"""
_ORDER_SCHEMA = {"key": "number", "price": "number", "who": {"id": "number", "note": "string|null"}, "big": "number", "tags": [{"n": "string", "w": "number?"}], "any": "array", "gone": "boolean?"}


@query(f"""SELECT o_orderkey, CAST(v ->> '$.key' AS DOUBLE) AS key, CAST(v ->> '$.price' AS DOUBLE) AS price, CAST(v ->> '$.who.id' AS DOUBLE) AS id, v ->> '$.who.note' AS note, CAST(v ->> '$.big' AS DOUBLE) AS big,
      array_to_string(list_transform(json_extract(v, '$.tags[*]'), lambda t: (t ->> '$.n') || coalesce(t ->> '$.w', '-')), ';') AS tags, json_array_length(v, '$.any') AS n_any, (v -> '$.gone') IS NULL AS gone
    FROM (SELECT o_orderkey, CAST({_ORDER} AS JSON) AS v FROM orders) WHERE json_type(v, '$.price') <> 'VARCHAR'""")
def parsed_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that pass as typed columns, nested ones and arrays of objects too."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER.replace("VARCHAR", "STRING")).alias("payload"))
    found = with_parsed(rows, _ORDER_SCHEMA, source="payload", carrier_kind="variant").filter("is_valid")
    tags = F.array_join(F.transform("data.tags", lambda t: F.concat(t["n"], F.coalesce(t["w"].cast("string"), F.lit("-")))), ";")
    return found.select("o_orderkey", "data.key", "data.price", "data.who.id", "data.who.note", "data.big", tags.alias("tags"), F.size("data.any").cast("long").alias("n_any"), F.col("data.gone").isNull().alias("gone"))


_AMOUNT = """concat('{"n": ', CASE o_orderkey % 4 WHEN 0 THEN concat('9007199254740993', o_orderkey % 10) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN concat('0.1234567890123456', o_orderkey % 10, '7') ELSE concat(o_orderkey, '.25') END, ', "xs": [', o_orderkey, ', 9007199254740993]}')"""


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND CAST(CAST(t AS DOUBLE) AS HUGEINT) <> CAST(t AS HUGEINT) OR o_orderkey % 4 = 2 AND CAST(CAST(CAST(t AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)) <> CAST(t AS DECIMAL(38, 18)) THEN 'Number at "n" is ' || t ELSE '' END AS of_n,
      'Number at "xs[1]" is 9007199254740993' AS of_xs FROM (SELECT o_orderkey, json({_AMOUNT}) ->> '$.xs[0]' AS _, regexp_extract({_AMOUNT}, '"n": ([0-9.]+)', 1) AS t FROM orders)""")
def parsed_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a double does not hold exactly."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_AMOUNT.replace("VARCHAR", "STRING")).alias("payload"))
    found = with_parsed(rows, {"n": "number", "xs": ["number"]}, source="payload", carrier_kind="variant")
    one = lambda at: F.coalesce(F.regexp_extract(F.array_join(F.filter("losses", lambda x: x.contains(at)), ";"), "^(.*), kept", 1), F.lit(""))
    return found.select("o_orderkey", one('"n"').alias("of_n"), one('"xs').alias("of_xs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Expected \"c_name\" to be of type string, got object;' ELSE '' END || 'Expected \"c_acctbal\" to be of type string,boolean, got number;Expected \"gone\" to be of type number, got undefined' AS errors FROM customer")
def validate_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))
    found = fr.validate(rows, {"c_name": "string", "c_acctbal": ["string", "boolean"], "gone": "number", "c_custkey": "n"})
    return rows.select("c_custkey", F.array_join(found, ";").alias("errors"))


@query("SELECT c_custkey, c_acctbal >= 0 AS is_valid, CASE WHEN c_acctbal < 0 THEN 'Expected \"c_acctbal\" to be positive, got number' ELSE '' END AS errors FROM customer")
def custom_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = TypeRegistry()
    registry.register("Positive", c.is_positive_number)
    rows = table(spark, sf_dir, "customer")
    found = fr.with_validation(rows, {"c_acctbal": "positive", "c_name": "string"}, registry=registry)
    return found.select("c_custkey", "is_valid", F.array_join("errors", ";").alias("errors"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) AS net FROM lineitem")
def expect_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.guard import expect

    net = expect(lambda quantity, discount: quantity * (1 - discount), {"paramTypes": ["number", "number"], "returnType": "number"})
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*_LINE, net(rows, "l_quantity", "l_discount").alias("net"))


@query("""SELECT 'Expected "k" to be number, got ' || CASE event_id % 7 WHEN 0 THEN 'string' ELSE 'null' END AS error, count(*) AS count FROM events WHERE event_id % 7 IN (0, 2) GROUP BY 1
    UNION ALL SELECT 'Missing required key "k"', count(*) FROM events WHERE event_id % 7 = 1 UNION ALL SELECT 'Invalid object: must be a non-null object, got array', count(*) FROM events WHERE event_id % 7 = 3""")
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.error_report(_payloads(spark, sf_dir), {"k": "number"}, source="payload", carrier_kind="variant")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 200000")
def valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    schema = {"o_orderstatus": c.one_of(["O", "F"]), "o_totalprice": c.in_range(1000, 200000), "o_custkey": "number"}
    return fr.valid_rows(rows, schema).select("o_orderkey", "o_custkey")


def _shipping(quantity, flag):
    """Text for large orders, an error for some flags: what a guard is for."""
    if flag == "R":
        raise ValueError("returned")
    return f"{quantity:.0f} by ship" if quantity > 40 else None if quantity < 3 else quantity * 0.5


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN e IS NULL THEN q * 0.5 END AS value, e AS error FROM (SELECT *, CASE
      WHEN q IS NULL THEN 'None of the types matched for null: null must be a number, is object' WHEN f = 'R' THEN 'returned'
      WHEN q > 40 THEN 'Return type mismatch: None of the types matched for ' || CAST(q AS INT) || ' by ship: ' || CAST(q AS INT) || ' by ship must be a number, is string'
      WHEN q < 3 THEN 'Return type mismatch: None of the types matched for null: null must be a number, is object' END AS e
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 6 THEN l_quantity END AS q, l_returnflag AS f FROM lineitem))""")
def expect_python_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function with a signature: arguments that fail never reach it, results that fail and what it raises are told."""
    from .operators.guard import expect_python

    rows = table(spark, sf_dir, "lineitem").select(*_LINE, F.when(F.col("l_linenumber") != 6, F.col("l_quantity")).alias("q"), F.col("l_returnflag").alias("f"))
    priced = expect_python(_shipping, {"paramTypes": ["number", "string"], "returnType": "number"}, "double", report=True)
    return rows.select(*_LINE, priced(rows, "q", "f").alias("found")).select(*_LINE, "found.value", "found.error")


_HOST = """CASE event_id % 10 WHEN 0 THEN concat('https://bücher', event_id, '.de/') WHEN 1 THEN concat('http://日本', event_id, '.jp') WHEN 2 THEN concat('http://a%zz', event_id, '/') WHEN 3 THEN concat('http://h%4', event_id % 9 + 1, '.org/x')
    WHEN 4 THEN concat('http://ｗｗｗ.h', event_id, '.org') WHEN 5 THEN 'http://xn--bcher-kva.de/' WHEN 6 THEN 'http://xn--/' WHEN 7 THEN concat('http://a％', event_id, '/') WHEN 8 THEN concat('http://xn--a.', event_id, 'h/') ELSE concat('http://１０.0.0.', event_id % 300, '/') END"""
_on_events("str_url_hosts", _HOST, c.is_url, "CASE event_id % 10 WHEN 2 THEN false WHEN 6 THEN false WHEN 7 THEN false WHEN 8 THEN false WHEN 9 THEN event_id % 300 < 256 ELSE true END", " must be a valid URL.")
