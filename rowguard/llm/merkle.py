"""Merkle manifest of a dataset: a tree for each group of rows, one over the groups' roots, a proof for each row.

H is the lower-case hex SHA-256 of its inputs put together, digests as hex text.
A row's leaf is H of its columns in the order given, each "-" if null, else its
UTF-8 byte count, ":" and its value. A group's leaves ascend by the order column;
while there are several nodes, every ARITY consecutive ones become their H (a last
run of one too). What remains is the group's subroot, a lone leaf as it is. The
subroots, by group (null first, bytewise), give the root in the same way.

Places in a group are counted without sending it to one task: rows are sorted
by range, counted for each task and group, and only those counts are summed in
order. Each level is one window over (group, parent's index): its full-frame
collect_list gives both what the parent hashes and each node's siblings; the
first node of a run stands for the parent in the next level. No task ever sees
more than ARITY nodes of a parent. Then paths come down the levels again: a
parent's path is joined to its nodes, which put their own siblings before it.
Leaves and levels are cut off by checkpoints, so a lost executor costs one level.

Texts are hashed whole where they lie; only digests are shuffled. Rows with
equal (or null, which come first) order values are ordered by leaf; a repeated
row is a leaf each time. An empty table has no rows and no root. Only the named
columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, named

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_IN_TASK = (1 << 33) - 1  # what monotonically_increasing_id counts within a task


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The leaf of a row with these values."""
    own = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in own]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, start, lambda at, step: digest(F.concat(step["before"], at, step["after"])))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows`, cut off, with `idx`, the place among the rows of the same `key`, and `n`, how many these are."""
    rows = cut(rows).withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart, so that they can be dealt out
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = ["key", *order, "row"]
    rows = cut(rows.repartitionByRange(n, *ends).sortWithinPartitions(*ends).drop("row").withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    rows = rows.withColumns({"task": task, "at": F.col("at").bitwiseAND(_IN_TASK)})
    per_task = rows.groupBy("key", "task").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = W.partitionBy("key").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = per_task.select("key", "task", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"), F.sum("rows").over(W.partitionBy("key")).alias("n"))
    return rows.join(starts, ["key", "task"]).withColumn("idx", F.col("at") - F.col("first") + F.col("earlier")).drop("at", "task", "first", "earlier")


def _levels(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The levels from `nodes` (key, idx, n, digest) up to a node for each key, each in the shared folder."""
    levels, most = [cut(nodes)], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = _with_run(levels[-1], arity)
        up = F.when(F.col("n") > 1, digest(F.array_join("run", ""))).otherwise(F.col("digest"))
        parents = run.filter(F.col("idx") % arity == 0).select("key", F.col("parent").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), up.alias("digest"))
        levels.append(cut(parents))
        most = -(-most // arity)
    return levels


def _with_run(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` with the index of their `parent` and `run`, the digests of all its nodes."""
    rows = nodes.withColumn("parent", F.floor(F.col("idx") / arity))
    whole = W.partitionBy("key", "parent").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("run", F.collect_list("digest").over(whole))


def _down(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The nodes of the first level with their `path` and what else `tops` (key, path, ...) has of the last level's."""
    paths = levels[-1].join(tops, "key")
    for nodes in reversed(levels[:-1]):
        parents = paths.drop("n", "digest").withColumnRenamed("idx", "parent").withColumnRenamed("path", "above")
        place = (F.col("idx") % arity).cast("int")
        step = F.struct(
            F.array_join(F.slice("run", F.lit(1), place), "").alias("before"),
            F.array_join(F.slice("run", place + 2, F.lit(arity)), "").alias("after"),
        )
        own = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("above"))).otherwise(F.col("above"))
        paths = _with_run(nodes, arity).join(parents, ["key", "parent"]).withColumn("path", own).drop("run", "parent", "above")
    return paths


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """Of each row the order column, the group, leaf, subroot, root and path (an array of before, after), and `carry`.

    `carry` has columns to work out of `docs` in the same pass, by name. `fold(leaf, path)` is the root.
    """
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("v"), named(group).cast("string")), F.lit("n"))  # no null, and null first
    rows = docs.select(key.alias("key"), named(order).alias("order"), leaf([named(c) for c in columns]).alias("digest"), F.struct(F.lit(0), *[c.alias(n) for n, c in carry.items()]).alias("carry"))
    rows = _placed(rows, ["order", "digest"])
    lower = _levels(rows, arity)
    subroots = lower[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    upper = _levels(_placed(subroots, ["group"]), arity)
    step = "array<struct<before:string,after:string>>"
    tops = upper[-1].select("key", F.array().cast(step).alias("path"), F.col("digest").alias("root"))
    tops = _down(upper, tops, arity).select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "root", "path")
    found = _down(lower, tops, arity)
    source = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30))
    return found.select(F.col("order").alias(order), source.alias(group), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col("carry")[n].alias(n) for n in carry])
