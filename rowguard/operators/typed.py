"""Valid JSON text and VARIANTs as typed columns: what a schema describes, as the StructType of `to_struct_type`.

Every entry is taken out by its place and turned into its column type:

    string, json     string             number     double
    boolean          boolean            null       null
    array            array<variant>     object     variant
    [t]              array<t>           {...}      struct
    several kinds, or a validator       variant

A double does not hold every number that JSON can write. `losses` names those
that it does not hold, with what became of them: whole numbers that no double
is equal to, beyond 2^53, and decimals of over 15 digits that do not come back from
the double's own text. (A VARIANT holds up to 38 digits; numbers written with an
exponent, or longer ones, are doubles there already, so nothing is known to be lost.) With `exact`, numbers become
decimal(38, 18) instead, and `losses` names what does not fit that.

Only rows that pass get data. Null where the schema allows null or a missing key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logic import Text, column, joined
from ..functions.registry import DEFAULT, TypeRegistry
from ..functions.values import Typed, Value, Variant
from ..plans.schema import Schema, places, to_struct_type

EXACT = T.DecimalType(38, 18)
_NONE = "array<string>"


def data_type(schema: dict, registry: TypeRegistry = DEFAULT, exact: bool = False) -> T.StructType:
    """The type of the data."""
    made = to_struct_type(schema, registry)
    return _exactly(made) if exact else made


def _exactly(own: T.DataType) -> T.DataType:
    if isinstance(own, T.StructType):
        return T.StructType([T.StructField(f.name, _exactly(f.dataType), f.nullable) for f in own.fields])
    if isinstance(own, T.ArrayType):
        return T.ArrayType(_exactly(own.elementType), own.containsNull)
    return EXACT if isinstance(own, T.DoubleType) else own


def extracted(definition, v: Value, wanted: T.DataType) -> Column:
    """A value that passes, as its column type; null where it is null or missing."""
    if isinstance(wanted, T.StructType) and isinstance(definition, dict):
        fields = [extracted(own, v.field(k), wanted[k].dataType).alias(k) for k, own in definition.items()]
        return F.when(column(v.is_nested()), F.struct(*fields)) if fields else F.lit(None).cast(wanted)
    if isinstance(wanted, T.ArrayType) and isinstance(definition, (list, tuple)) and len(definition) == 1:
        own = definition[0]
        return F.when(column(v.is_kind("array")), v.each(lambda x, _: extracted(own, x, wanted.elementType), places(own)))
    if isinstance(v, Typed):
        return F.to_variant_object(v.column) if isinstance(wanted, T.VariantType) else v.column.cast(wanted)
    if isinstance(wanted, T.VariantType):
        return v.column
    if isinstance(wanted, T.NullType):
        return F.lit(None)
    if isinstance(wanted, T.StringType):
        return F.when(column(v.is_kind("string")), v.string())
    return F.try_variant_get(v.column, "$", wanted.simpleString())


def lost(definition, v: Value, wanted: T.DataType, path: Text = "") -> list[Column]:
    """Arrays of what the numbers of a value lose."""
    if isinstance(wanted, T.StructType) and isinstance(definition, dict):
        at = lambda k: k if isinstance(path, str) and not path else joined(path, ".", k)
        return [found for k, own in definition.items() for found in lost(own, v.field(k), wanted[k].dataType, at(k))]
    if isinstance(wanted, T.ArrayType) and isinstance(definition, (list, tuple)) and len(definition) == 1 and isinstance(v, Variant):
        own, element = definition[0], wanted.elementType

        def each(x: Value, i: Column) -> Column:
            found = lost(own, x, element, F.concat(column(path), F.lit("["), i.cast("string"), F.lit("]")))
            return F.concat(*found) if found else F.array().cast(_NONE)

        return [F.coalesce(F.flatten(v.each(each, places(own))), F.array().cast(_NONE))] if _numbers(element) else []
    if not isinstance(wanted, (T.DoubleType, T.DecimalType)) or not isinstance(v, Variant):
        return []
    text, kept = F.try_variant_get(v.column, "$", "string"), F.try_variant_get(v.column, "$", wanted.simpleString())
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "[-.]", ""), "^0+", ""))
    exactly = F.try_variant_get(v.column, "$", "decimal(38,0)") == kept.try_cast("bigint")  # of whole numbers in the range of a long
    again = text.try_cast("decimal(38,18)") == kept.cast("string").try_cast("decimal(38,18)")
    same = (digits <= 15) | F.coalesce(F.when(text.contains("."), again).otherwise(exactly), F.lit(False))
    if isinstance(wanted, T.DecimalType):
        same = kept.isNotNull()
    known = F.coalesce(v.raw_kind.isin("BIGI", "INT", "SMAL", "TINY", "DECI") if isinstance(wanted, T.DoubleType) else v.is_kind("number"), F.lit(False))
    says = F.concat(F.lit('Number at "'), column(path), F.lit('" is '), text, F.lit(", kept as "), F.coalesce(kept.cast("string"), F.lit("null")))
    return [F.when(known & ~same, F.array(says)).otherwise(F.array().cast(_NONE))]


def _numbers(own: T.DataType) -> bool:
    if isinstance(own, T.StructType):
        return any(_numbers(f.dataType) for f in own.fields)
    return _numbers(own.elementType) if isinstance(own, T.ArrayType) else isinstance(own, (T.DoubleType, T.DecimalType))


def with_parsed(frame: DataFrame, schema: dict, *, source: str, into: str = "data", exact: bool = False, registry: TypeRegistry = DEFAULT, **how) -> DataFrame:
    """The rows with is_valid, errors, `into` (a struct, null where not valid) and losses.

    `source` is JSON text (carrier_kind="variant") or a VARIANT column. Entries that look into tables are
    not parsed here: check them on what comes out.
    """
    from .frame import _once, _ready

    schema = Schema(schema)
    wanted = data_type(schema, registry, exact)
    rows, found, ok = _ready(frame, schema, {"source": source, "dialect": "parse", "registry": registry, **how})
    if ok is None:
        raise TypeError(f"{source} is neither JSON text nor a VARIANT")
    v = found.of
    losses = lost(schema, v, wanted)
    made = F.struct(
        found.found(F.col(ok)).alias("errors"),
        F.when(F.col(ok), extracted(schema, v, wanted)).alias("data"),
        F.when(F.col(ok), F.concat(*losses) if losses else F.array().cast(_NONE)).otherwise(F.array().cast(_NONE)).alias("losses"),
    )
    name = "_parsed"
    while name in frame.columns:
        name += "_"
    once = rows.select(*frame.columns, _once(made).alias(name))
    got = F.col(name)
    return once.select(*frame.columns, (F.size(got["errors"]) == 0).alias("is_valid"), got["errors"].alias("errors"), got["data"].alias(into), got["losses"].alias("losses"))


def parsed_rows(frame: DataFrame, schema: dict, *, source: str, exact: bool = False, registry: TypeRegistry = DEFAULT, **how) -> DataFrame:
    """Only the valid rows, as the columns of the schema: what a scan of a shredded VARIANT need not read, it does not."""
    from .frame import _once, _ready

    schema = Schema(schema)
    wanted = data_type(schema, registry, exact)
    rows, found, ok = _ready(frame, schema, {"source": source, "dialect": "parse", "registry": registry, **how})
    if ok is None:
        raise TypeError(f"{source} is neither JSON text nor a VARIANT")
    once = rows.select(_once(F.when(F.col(ok), extracted(schema, found.of, wanted))).alias("data"))
    return once.filter("data IS NOT NULL").select("data.*")
