"""Membership in the values of a table at any place of a schema: joins instead of lists in the plan.

    with_validation(df, {"owner": {"id": in_table(customers)}, "parts": [in_table(parts)]}, source="payload", carrier_kind="variant")

Entries of this kind are lifted out of the schema before it is compiled. One
outside arrays is a left join with the distinct values. One that stands for the
elements of an array takes one explode: the distinct elements of each row are
joined with the values, and the known ones come back to the row as an array that
the element test looks into, so errors stay where the schema has them. Rows
without elements are spread over the join by a salt; hot values are split by
adaptive execution, and small tables are broadcast if Spark finds them small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import Check
from ..functions.logic import column, either, joined
from ..functions.values import Typed, Value, Variant

SALTS = 1000


class InTable:
    """A validator: one of the values in the only column of a table, of the same kind. With `nullable` null passes too, with `optional` what is missing."""

    def __init__(self, values: DataFrame, nullable: bool = False, optional: bool = False):
        if len(values.columns) != 1:
            raise ValueError(f"one column of values, not {len(values.columns)}")
        self.type = values.schema[0].dataType
        self.kind = Typed(F.lit(None), self.type).kind
        if self.kind not in ("string", "number", "boolean", "bigint", "date"):
            raise ValueError(f"values of type {self.type.simpleString()} are not looked up")
        self.values = values.toDF("value").filter("value IS NOT NULL").distinct()
        self.nullable, self.optional = nullable, optional

    def key(self, v: Value) -> Column:
        """What is looked up of a value, null where it is of another kind."""
        if isinstance(v, Typed) and type(v) is Typed:
            return v.column if v.kind == self.kind else F.lit(None).cast(self.type)
        wanted = v.is_kind(self.kind)
        own = {"string": v.string, "number": v.number}.get(self.kind, lambda: F.try_variant_get(v.column, "$", self.type.simpleString()))
        return F.lit(None).cast(self.type) if wanted is False else F.when(column(wanted), own())

    def check(self, v: Value, known: Column) -> Check:
        ok = either(known, v.null() if self.nullable else False, v.missing() if self.optional else False)
        return Check(ok, lambda: joined(v.text(), " must be one of the table's values, is ", v.text()), v)

    def __call__(self, v: Value) -> Check:
        raise TypeError("membership in a table is a join: use with_validation, valid_rows, invalid_rows, errors_in or error_report")


def in_table(values: DataFrame, nullable: bool = False, optional: bool = False) -> InTable:
    return InTable(values, nullable, optional)


Step = str | None  # a key, or None for the elements of an array


def entries(schema, at: tuple[Step, ...] = ()) -> list[tuple[tuple[Step, ...], InTable]]:
    """The lookups of a schema and the steps that lead there."""
    if isinstance(schema, InTable):
        return [(at, schema)]
    if isinstance(schema, dict):
        return [found for k, own in schema.items() for found in entries(own, (*at, k))]
    return [found for own in schema for found in entries(own, (*at, None))] if isinstance(schema, (list, tuple)) and len(schema) == 1 else []


def _put(schema, at: tuple[Step, ...], validator: Callable[[Value], Check]):
    """The schema with something else at a place."""
    if not at:
        return validator
    if at[0] is None:
        return [_put(schema[0], at[1:], validator)]
    return {k: _put(own, at[1:], validator) if k == at[0] else own for k, own in schema.items()}


def _values_at(v: Value, at: tuple[Step, ...], key: Callable[[Value], Column]) -> Column:
    """All that is looked up of one row, as an array."""
    for i, step in enumerate(at):
        if step is None:
            inner = v.each(lambda x, _: _values_at(x, at[i + 1 :], key))
            return F.when(column(v.is_kind("array")), F.flatten(inner))
        v = v.field(step)
    return F.array(key(v))


def lifted(frame: DataFrame, schema, own: Callable[[DataFrame], Value], name: str) -> tuple[DataFrame, object]:
    """The frame with a column `name`... for each lookup, and the schema that asks those columns instead."""
    for i, (at, lookup) in enumerate(entries(schema)):
        flag = f"{name}{i}"
        values = lookup.values.select(F.col("value").alias(flag + "v"), F.lit(0).alias(flag + "s"))
        root = own(frame)
        if None not in at:
            keyed = frame.withColumn(flag + "k", _values_at(root, at, lookup.key)[0])
            frame = _joined(keyed, values, flag).drop(flag + "k")
            test = lambda v, c=flag: F.coalesce(F.col(c), F.lit(False))
        else:
            found = frame.withColumn(flag + "r", F.monotonically_increasing_id()).withColumn(flag + "a", F.array_distinct(_values_at(root, at, lookup.key)))
            whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in frame.columns])
            each = found.select(flag + "r", whole.alias(flag + "w"), F.posexplode_outer(flag + "a").alias(flag + "i", flag + "k"))
            each = each.withColumn(flag + "w", F.when(F.coalesce(F.col(flag + "i"), F.lit(0)) == 0, F.col(flag + "w")))
            hits = _joined(each, values, flag).groupBy(flag + "r").agg(F.first(flag + "w", ignorenulls=True).alias(flag + "w"), F.collect_list(F.when(F.col(flag), F.col(flag + "k"))).alias(flag))
            frame = hits.select(*[F.col(flag + "w").getField(c).alias(c) for c in frame.columns], flag)
            test = lambda v, c=flag, k=lookup.key: F.coalesce(F.array_contains(F.col(c), k(v)), F.lit(False))
        schema = _put(schema, at, lambda v, t=test, o=lookup: o.check(v, t(v)))
    return frame, schema


def _joined(rows: DataFrame, values: DataFrame, flag: str) -> DataFrame:
    """`rows` with a column `flag`: whether the key in `flag`k is one of the values."""
    salt = F.when(F.col(flag + "k").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
    salted = rows.withColumn(flag + "t", salt.cast("int"))
    match = (F.col(flag + "k") == F.col(flag + "v")) & (F.col(flag + "t") == F.col(flag + "s"))
    return salted.join(values, match, "left").withColumn(flag, F.col(flag + "s").isNotNull()).drop(flag + "t", flag + "s", flag + "v")
