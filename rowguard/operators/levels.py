"""Rows that each name their schema, and schemas that refer to themselves, validated level by level.

Every row starts at the root of the schema that it names. A step joins the values
of one depth with the table of nodes, turns each into an error, or into the
values below it, or into nothing if it is fine. Errors go through further steps as
they are. All rows take the same steps, whichever of the schemas they name, so
the plan is as long as the deepest schema. Where schemas refer to each other the
depth is known by no plan: steps go on, cut off by checkpoints, until no values are left.

Values are not shuffled: the table of nodes, which the driver makes of the schemas, is
broadcast. Errors are, once, to be put in order: depth first, as the schemas have them.
Where schemas refer to each other, rows are dealt out over all cores first: a small file
may hold many deep values, and each would stay in the task that read it until the last step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.logic import column
from ..functions.registry import DEFAULT, TypeRegistry
from ..functions.text import first_of, json_array
from ..functions.values import Typed, Variant, kind_code, value
from ..plans.nodes import PATH, Nodes, Ref
from ..sources.shared import cut

__all__ = ["Ref", "errors_by_schema", "with_validation_by_schema"]

STEPS_AT_ONCE = 4  # between two checkpoints
TASKS_A_CORE = 3  # that rows are dealt out to, as some are deeper than others
_ITEMS = "array<struct<at:int,key:string,node:int,v:variant>>"


def _stepper(nodes: DataFrame, checks: list) -> Callable[[DataFrame], DataFrame]:
    """What goes from values to errors and to the values below them; its columns are built once for all steps."""
    has = F.col("v").isNotNull()
    entries = F.when(F.col("kind") == "object", F.try_variant_get("v", "$", "map<string,variant>"))
    elements = F.when(F.col("kind") == "array", F.try_variant_get("v", "$", "array<variant>"))
    # What could be taken apart is known by that: to tell the type of a value, Spark walks through all that lies below.
    code = F.when(F.col("entries").isNotNull(), "OBJE").when(F.col("elements").isNotNull(), "ARRA").otherwise(kind_code(F.col("v")))
    v = Variant(F.col("v"), kind=F.col("code"))
    got, path = column(v.kind_name()), F.col("path")
    nested, is_array = v.is_nested(), v.is_kind("array")
    accepted = F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False)) | F.when(F.col("json"), column(v.is_base("json"))).otherwise(False)
    expected = lambda what: F.concat(F.lit('Expected "'), path, F.lit('" to be '), what, F.lit(", got "), got)
    no_object = F.when(F.size("order") == 0, F.concat(F.lit("Invalid object: must be a non-null object, got "), got)).otherwise(expected(F.lit("an object")))
    tests = [(c(v).ok, c(v).message) for c in checks]
    failing = [F.when((F.col("element") == i) & ~column(ok), F.concat(F.lit('Validation failed at "'), path, F.lit('": '), column(says))) for i, (ok, says) in enumerate(tests)]
    found = (
        F.when(F.col("kind") == "wrong", F.replace(F.col("says"), F.lit(PATH), path))
        .when(F.col("kind") == "check", F.coalesce(*failing) if failing else F.lit(None).cast("string"))
        .when(F.col("optional") & (~has | column(v.null())), F.lit(None).cast("string"))
        .when(~has & (F.size("order") > 0), F.concat(F.lit('Missing required key "'), path, F.lit('"')))
        .when((F.col("kind") == "names") & ~accepted, F.coalesce("says", expected(F.col("wanted"))))
        .when((F.col("kind") == "object") & ~nested, no_object)
        .when((F.col("kind") == "array") & ~is_array, expected(F.lit("an array")))
    )
    item = lambda at, key, node, own: F.struct(at.cast("int").alias("at"), key.cast("string").alias("key"), node.cast("int").alias("node"), own.cast("variant").alias("v"))
    nothing = F.lit(None)
    below = F.when(F.col("kind") == "object", F.transform("children", lambda c: item(c["at"], c["key"], c["node"], F.try_element_at("entries", c["key"])))).when(
        F.col("kind") == "array", F.transform("elements", lambda x, i: item(i, nothing, F.col("element"), x))
    )
    ends = F.col("node").isNull() | F.col("found").isNotNull()
    items = F.when(ends, F.array(item(nothing, nothing, nothing, nothing))).when(has & ~column(v.null()), below)
    error = F.when(F.col("node").isNull(), F.col("error")).otherwise(F.col("found")).alias("error")
    # Of a bare column, Spark would ask for the size before it explodes, and for that work it out twice.
    each = F.explode(F.coalesce("items", F.array().cast(_ITEMS))).alias("item")
    # Here, not in the transforms above, which are not compiled.
    at, key = F.col("item.at"), F.col("item.key")
    order = F.when(at.isNull(), F.col("order")).otherwise(F.array_append("order", at)).alias("order")
    where = F.when(at.isNull(), path).when(key.isNull(), F.concat(path, F.lit("["), at.cast("string"), F.lit("]"))).when(path == "", key).otherwise(F.concat(path, F.lit("."), key)).alias("path")

    def step(state: DataFrame) -> DataFrame:
        known = state.join(F.broadcast(nodes), "node", "left").withColumns({"entries": entries, "elements": elements}).withColumn("code", code).withColumn("found", found)
        taken = known.select("row", "keep", "order", "path", error, items.alias("items"))
        return taken.select("row", "keep", "order", "path", "error", each).select("row", "keep", order, where, "item.node", "item.v", "error")

    return step


def _found(frame: DataFrame, schemas: dict[str, dict], by: str, source: str, keep: Column, marks: bool, registry: TypeRegistry) -> DataFrame:
    """row, keep, order, path, error; with `marks` each row has one without an error as well."""
    spark, nodes = frame.sparkSession, Nodes(schemas, registry)
    table, own = nodes.table(spark), value(frame, source)
    if isinstance(own, Typed) and own.kind != "string":
        raise TypeError(f"{source} is neither JSON text nor a VARIANT")
    name = value(frame, by).column.cast("string")
    rows = frame.select(F.monotonically_increasing_id().alias("row"), keep.alias("keep"), name.alias("name"), own.column.alias("v"))
    if nodes.recursive:
        rows = rows.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "row")
    if isinstance(own, Typed):
        rows = rows.withColumn("v", json_array(F.col("v"))).withColumn("v", first_of(F.col("v")))
    rows = rows.join(F.broadcast(nodes.root_table(spark)), "name", "left")
    unknown = F.when(F.col("root").isNull(), F.concat(F.lit("Unknown schema: "), F.coalesce("name", F.lit("null"))))
    first = F.struct(F.array().cast("array<int>").alias("order"), F.lit("").alias("path"), F.col("root").alias("node"), F.col("v"), unknown.alias("error"))
    if marks:  # the row itself goes along once, without being looked at
        mark = F.struct(F.array().cast("array<int>").alias("order"), F.lit("").alias("path"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("variant").alias("v"), F.lit(None).cast("string").alias("error"))
        state = rows.select("row", F.explode(F.array(F.struct(F.col("keep"), mark.alias("at")), F.struct(F.lit(None).alias("keep"), first.alias("at")))).alias("one")).select("row", "one.keep", "one.at.*")
    else:
        state = rows.select("row", "keep", first.alias("at")).select("row", "keep", "at.*")
    step = _stepper(table, nodes.checks)
    if not nodes.recursive:
        for _ in range(nodes.depth + 1):
            state = step(state)
        return state
    done = []
    while True:
        for _ in range(STEPS_AT_ONCE):
            state = step(state)
        state = cut(state)
        done.append(state.filter("node IS NULL"))
        state = state.filter("node IS NOT NULL")
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def errors_by_schema(frame: DataFrame, schemas: dict[str, dict], *, by: str, source: str, keep: list[str], registry: TypeRegistry = DEFAULT) -> DataFrame:
    """A row for each error: the columns `keep`, place (from 0) and error, as `parse` words it.

    `by` has each row's schema by name; `source` is JSON text or a VARIANT. A name that
    no schema has is an error. Only errors are shuffled.
    """
    found = _found(frame, schemas, by, source, F.struct(*keep), False, registry)
    place = F.row_number().over(W.partitionBy("row").orderBy("order")) - 1
    return found.select("keep.*", place.cast("long").alias("place"), "error")


def with_validation_by_schema(frame: DataFrame, schemas: dict[str, dict], *, by: str, source: str, registry: TypeRegistry = DEFAULT) -> DataFrame:
    """The rows with is_valid and errors. Rows are shuffled once, to meet their errors."""
    found = _found(frame, schemas, by, source, F.struct(*["`" + c.replace("`", "``") + "`" for c in frame.columns]), True, registry)
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("order", "error"))))
    whole = found.groupBy("row").agg(F.first("keep", ignorenulls=True).alias("keep"), errors.alias("errors"))
    return whole.select("keep.*", (F.size("errors") == 0).alias("is_valid"), F.transform("errors", lambda e: e["error"]).alias("errors"))
