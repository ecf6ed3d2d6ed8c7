"""Validation of whole DataFrames: flags and errors, splits, reports, parsing.

Everything here is a projection or a filter on the rows as they lie; only the
report shuffles, and that one counts of messages.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import Check, Validator, is_type, matches_type
from ..functions.logic import column, negated
from ..functions.registry import DEFAULT, TypeRegistry
from ..functions.text import first_of, json_array, json_value, let
from ..functions.values import Row, Typed, Value, Variant, value
from ..plans.compile import Findings, compile_schema
from .lookup import entries, lifted
from .taking import is_json_text, taken_out, within

log = logging.getLogger("rowguard")


class ValidationError(TypeError):
    """A definition that no rows can be held against."""


def carrier(frame: DataFrame, source: str | None = None, kind: str = "typed") -> Value:
    """What is validated: the row itself, a column of it, or ("variant") the JSON text in a column.

    JSON text that is no JSON is missing, as is a null.
    """
    if source is None:
        return Row(frame)
    own = value(frame, source)
    if kind == "variant" and isinstance(own, Typed) and own.kind == "string":
        return Variant(json_value(own.column))
    if kind == "map" and not (isinstance(own, Typed) and isinstance(own.type, T.MapType)):
        raise ValidationError(f"{source} is no map")
    return own


def _fresh(name: str, frame: DataFrame) -> str:
    while any(c.startswith(name) for c in frame.columns):
        name += "_"
    return name


def prepared(frame: DataFrame, source: str | None = None, carrier_kind: str = "typed") -> tuple[DataFrame, str | None]:
    """The frame with JSON text of `source` parsed into a column of its own, once for each row, and that column's name.

    Whatever looks at the text many times should look at this instead. The
    column comes last; nothing is added where `source` is no text.
    """
    if source is None or carrier_kind != "variant" or not is_json_text(value(frame, source)):
        return frame, source
    name = _fresh("_payload", frame)
    rows = frame.select("*", json_array(value(frame, source).column).alias(name + "_"))
    return rows.select(*frame.columns, _once(first_of(F.col(name + "_"))).alias(name)), name


def _once(column: Column) -> Column:
    """A generator of one row each: filters further up are not moved below it, where they would work everything out anew."""
    return F.explode(F.array(column))


def _takes_apart(frame: DataFrame, schema, source: str | None, kind: str) -> bool:
    """Whether the schema's entries are taken out of JSON text or a VARIANT first."""
    if source is None or not isinstance(schema, dict) or not schema:
        return False
    own = value(frame, source)
    return isinstance(own, Variant) or kind == "variant" and is_json_text(own)


def _in_column(frame: DataFrame, schema, how: dict, body: Callable[[Findings], Column]) -> Column:
    """`body` of the findings, as one column: JSON text is parsed once, entries are taken out once."""
    source, kind = how.get("source"), how.get("carrier_kind", "typed")
    if not _takes_apart(frame, schema, source, kind):
        return body(findings(frame, schema, **how))
    rest = {k: v for k, v in how.items() if k not in ("source", "carrier_kind")}

    def inner(own: Variant) -> Column:
        out = body(compile_schema(schema, own, **rest))
        if "columnnodeexpression(" in str(out):
            raise ValidationError("Python functions cannot look into JSON within one column: use with_validation and the like")
        return out

    return within(value(frame, source), schema, inner, flat=rest.get("dialect") == "flat", rooted=bool(rest.get("strict")))


def findings(frame: DataFrame, schema, *, source: str | None = None, carrier_kind: str = "typed", dialect: str = "structure", strict: bool = False, registry: TypeRegistry = DEFAULT) -> Findings:
    key = (frame.schema.json() if source is None else frame.schema[source.split(".")[0] if source not in frame.columns else source].json(), source, carrier_kind)
    return compile_schema(schema, carrier(frame, source, carrier_kind), dialect, strict, registry, key)


def _ready(frame: DataFrame, schema, how: dict) -> tuple[DataFrame, Findings, str | None]:
    """Rows to look for findings in, the findings, and the column, if there is one, that tells whether there are none.

    Of a VARIANT or JSON text, all that the schema names is taken out into columns first, each
    with its kind, in projections that are not folded into those that use them,
    and then tested. What uses these columns should be worked out once only.
    """
    source, kind = how.get("source"), how.get("carrier_kind", "typed")
    if entries(schema):
        rows, own = prepared(frame, source, kind)
        find = lambda f: Row(f, frame.columns) if source is None else value(f, own)
        rows, schema = lifted(rows, schema, find, _fresh("_in", rows))
        if source is None:
            rest = {k: v for k, v in how.items() if k not in ("source", "carrier_kind")}
            return rows, compile_schema(schema, find(rows), **rest), None
        return _ready(rows, schema, how | {"source": own})
    if not _takes_apart(frame, schema, source, kind):
        return frame, findings(frame, schema, **how), None
    name = _fresh("_at", frame)
    rest = {k: v for k, v in how.items() if k not in ("source", "carrier_kind")}
    rows, own = taken_out(frame, schema, value(frame, source), name, flat=rest.get("dialect") == "flat", rooted=bool(rest.get("strict")))
    found = compile_schema(schema, own, **rest, key=("taken out", name, source, frame.schema.json()))
    return rows.select("*", column(found.valid()).alias(name + "ok")), found, name + "ok"


def with_validation(frame: DataFrame, schema, *, valid: str = "is_valid", errors: str = "errors", **how) -> DataFrame:
    """The rows with is_valid and errors."""
    rows, found, ok = _ready(frame, schema, how)
    if ok is None:
        return rows.select(*frame.columns, column(found.valid()).alias(valid), found.found().alias(errors))
    once = rows.select(*frame.columns, _once(found.found(F.col(ok))).alias(errors))
    return once.select(*frame.columns, (F.size(errors) == 0).alias(valid), errors)


def check_structure(frame: DataFrame, schema, **how) -> Column:
    """struct(is_valid, errors)."""
    return _in_column(frame, schema, how, lambda found: F.struct(column(found.valid()).alias("is_valid"), found.found().alias("errors")))


def valid_rows(frame: DataFrame, schema, **how) -> DataFrame:
    """By the predicate alone: what a scan can skip, it does."""
    rows, found, ok = _ready(frame, schema, how)
    if ok is None:
        return rows.filter(column(found.valid())).select(*frame.columns)
    flag = _fresh("_is_valid", frame)
    return rows.select(*frame.columns, _once(F.col(ok)).alias(flag)).filter(flag).select(*frame.columns)


def invalid_rows(frame: DataFrame, schema, **how) -> DataFrame:
    """The rows that are not valid, with their errors."""
    rows, found, ok = _ready(frame, schema, how)
    if ok is None:
        return rows.filter(column(negated(found.valid()))).select(*frame.columns, found.found().alias("errors"))
    return rows.select(*frame.columns, _once(found.found(F.col(ok))).alias("errors")).filter(F.size("errors") > 0)


def errors_in(frame: DataFrame, schema, **how) -> DataFrame:
    """A row for each error: the row's columns, place (from 0) and error."""
    rows, found, ok = _ready(frame, schema, how)
    return rows.select(*frame.columns, F.posexplode(found.found(None if ok is None else F.col(ok))).alias("place", "error"))


def error_report(frame: DataFrame, schema, **how) -> DataFrame:
    """How often each error is found."""
    return errors_in(frame, schema, **how).groupBy("error").agg(F.count("*").alias("count"))


def validate(frame: DataFrame, schema: dict, **how) -> Column:
    """The errors of a flat schema."""
    return _in_column(frame, schema, how | {"dialect": "flat"}, Findings.errors)


def _checked(frame: DataFrame, definition, source: str | None, kind: str, registry: TypeRegistry, body: Callable[[Column, Column], Column]) -> Column:
    """`body` of (ok, message) of the first argument of parse: name, names, validator or schema."""
    if isinstance(definition, dict):
        how = {"source": source, "carrier_kind": kind, "dialect": "parse", "registry": registry}
        says = lambda found: F.concat(F.lit("Validation failed:\n  - "), F.array_join(found.errors(), "\n  - "))
        return _in_column(frame, definition, how, lambda found: body(column(found.valid()), says(found)))
    if not callable(definition) and not isinstance(definition, (str, list, tuple)):
        raise ValidationError("Invalid first argument to parse(): expected type alias, validator, or schema.")
    names = definition if isinstance(definition, str) or callable(definition) else list(definition)
    check = lambda own: definition(own) if callable(definition) else is_type(names, own, registry)
    own = carrier(frame, source) if source is None or not is_json_text(value(frame, source)) else value(frame, source)
    if kind == "variant" and is_json_text(own):
        given = let(json_array(own.column), lambda parts: first_of(parts))
        return let(given, lambda v: body(column((made := check(Variant(v))).ok), column(made.message)))
    made: Check = check(own)
    return body(column(made.ok), column(made.message))


def _whole(frame: DataFrame, source: str | None) -> Column:
    return F.struct(*frame.columns) if source is None else value(frame, source).column


def parse(frame: DataFrame, definition, *, source: str | None = None, carrier_kind: str = "typed", registry: TypeRegistry = DEFAULT) -> Column:
    """The value as it is; the query fails at the first row that does not pass."""
    own = _whole(frame, source)
    return _checked(frame, definition, source, carrier_kind, registry, lambda ok, message: F.when(ok, own).otherwise(F.raise_error(message)))


def safe_parse(frame: DataFrame, definition, *, source: str | None = None, carrier_kind: str = "typed", registry: TypeRegistry = DEFAULT) -> Column:
    """struct(success, data, error)."""
    own = _whole(frame, source)
    made = lambda ok, message: F.struct(ok.alias("success"), F.when(ok, own).alias("data"), F.when(~ok, message).alias("error"))
    return _checked(frame, definition, source, carrier_kind, registry, made)


def apply(frame: DataFrame, source: str, validator: Validator) -> Column:
    """struct(ok, message) of a validator on a column."""
    return validator(value(frame, source)).column()


def one_of_table(frame: DataFrame, source: str, values: DataFrame, ok: str = "ok", message: str = "message") -> DataFrame:
    """`one_of` with the values in the only column of a table: a join, for more values than a plan should carry.

    Null is one of them if it is among them. Messages name how many there are, not which.
    """
    own, name = value(frame, source), _fresh("_one_of", frame)
    known = values.toDF(name).distinct().withColumn(name + "_", F.lit(True))
    n = values.distinct().agg(F.count("*").alias(name + "n"))
    joined = frame.join(known, own.column.eqNullSafe(F.col(name)), "left").crossJoin(F.broadcast(n))  # a row of one number
    found = F.coalesce(F.col(name + "_"), F.lit(False))
    says = F.concat(column(own.text()), F.lit(" must be one of "), F.col(name + "n").cast("string"), F.lit(" values, is "), column(own.text()))
    return joined.select(*frame.columns, found.alias(ok), F.when(~found, says).alias(message))


def is_(frame: DataFrame, source: str, types: str | list[str], registry: TypeRegistry = DEFAULT) -> Column:
    return column(matches_type(types, value(frame, source), registry))


def with_types(frame: DataFrame, source: str, tests: dict[str, str | list[str]], registry: TypeRegistry = DEFAULT) -> DataFrame:
    """The rows with a column for each test, by name: whether the value is of any of its types. The kind of a VARIANT is found out once."""
    own = value(frame, source)
    if not isinstance(own, Variant):
        return frame.select("*", *[column(matches_type(types, own, registry)).alias(n) for n, types in tests.items()])
    name = _fresh("_kind", frame)
    rows = frame.select("*", own.raw_kind.alias(name))
    known = Variant(own.column, kind=F.col(name))
    return rows.select(*frame.columns, *[column(matches_type(types, known, registry)).alias(n) for n, types in tests.items()])


def as_type(frame: DataFrame, source: str, types: str | list[str], registry: TypeRegistry = DEFAULT) -> Column:
    """The value, or the query fails with the message of `is_type`."""
    own = value(frame, source)
    check = is_type(types, own, registry)
    return F.when(column(check.ok), own.column).otherwise(F.raise_error(column(check.message)))


def _guards(name: str) -> tuple[Callable[[DataFrame, str], Column], Callable[[DataFrame, str], Column]]:
    """(whether a column's values are of a type, the values or the query fails)."""
    return lambda frame, source: is_(frame, source, name), lambda frame, source: as_type(frame, source, name)


is_string, as_string = _guards("string")
is_number, as_number = _guards("number")
is_boolean, as_boolean = _guards("boolean")
is_array, as_array = _guards("array")
is_object, as_object = _guards("object")


def kind_name(frame: DataFrame, source: str) -> Column:
    """The kind of each value as messages name it."""
    return column(value(frame, source).kind_name())


def assert_type(frame: DataFrame, source: str, types: str | list[str], registry: TypeRegistry = DEFAULT) -> tuple[DataFrame, Observation]:
    """The frame as it is, and what it counts while some action runs over it: `failed` rows.

    `warn` logs them. Nothing fails.
    """
    own = value(frame, source)
    wrong = negated(matches_type(types, own, registry))
    seen = Observation(f"assert {source}")
    return frame.observe(seen, F.count_if(column(wrong)).alias("failed")), seen


def warn(seen: Observation, source: str, types: str | list[str]) -> int:
    failed = seen.get["failed"]
    if failed:
        shown = types if isinstance(types, str) else ",".join(types)
        log.warning("Assertion failed: Expected %s in %s: %d rows", shown, source, failed)
    return failed
