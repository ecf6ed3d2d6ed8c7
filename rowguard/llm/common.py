"""Helpers shared by the operators: lineage cuts and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests, a laptop) gets a temporary folder;
    on a cluster other machines would not see one, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="rowguard-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete what was written there, in whatever file system it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def cut(frame: DataFrame) -> DataFrame:
    """Write `frame` to the shared checkpoint folder and go on from the files.

    They stay there unless the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` true, as tests and bench
    do: then Spark deletes them once nothing refers to them any more.
    """
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, columns: list[str]) -> str:
    """`name`, made longer until no column has it."""
    while name.lower() in [c.lower() for c in columns]:
        name += "_"
    return name


_stored: list[str] = []


def stored(frame: DataFrame, name: str) -> DataFrame:
    """`frame` as a table in the shared folder: read back, never computed again, and only the columns asked for.

    Its files stay until `release`, as what is returned reads them.
    """
    typed = [f.name for f in frame.schema.fields if not isinstance(f.dataType, T.NullType)]  # Parquet has no column without a type
    path = new_path(frame.sparkSession, name)
    frame.select(*map(named, typed)).write.parquet(path)
    _stored.append(path)
    read = frame.sparkSession.read.parquet(path)
    return read.select(*[named(c) if c in typed else F.lit(None).alias(c) for c in frame.columns])


def release(docs: DataFrame) -> None:
    """Delete the `stored` tables of this process but those that `docs` reads.

    For whoever has written what the operators gave, as the stages of a pipeline have.
    """
    read = _roots(docs)
    for path in list(_stored):
        if path.rsplit("/", 1)[-1] not in read:
            drop(docs.sparkSession, path)
            _stored.remove(path)


def _leaves(docs: DataFrame) -> list:
    own = docs._jdf.queryExecution().analyzed().collectLeaves()
    return [own.apply(i) for i in range(own.size())]


def _roots(docs: DataFrame) -> str:
    """The folders that the files read by `docs` lie in."""
    files = [leaf for leaf in _leaves(docs) if leaf.nodeName().startswith("LogicalRelation")]
    return " ".join(leaf.relation().location().rootPaths().mkString(" ") for leaf in files)


def is_scan(docs: DataFrame) -> bool:
    """Whether `docs` is nothing but files: its rows come in the same order and parts each time."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.children().isEmpty() and plan.nodeName().startswith("LogicalRelation") and "HadoopFsRelation" in plan.relation().getClass().getName()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, and the name of that column.

    Numbers of plain files are the same each time. What is computed is written once
    and its numbers read back, so they stay whatever it is computed from.
    """
    name = fresh("row", docs.columns)
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    return rows if is_scan(docs) else stored(rows, "rows"), name


_kept: dict[tuple, object] = {}


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """Something dear that this Python worker keeps from task to task: one of each kind."""
    if (kind, key) not in _kept:
        for old in [k for k in _kept if k[0] == kind]:
            del _kept[old]
        _kept[kind, key] = make()
    return _kept[kind, key]


def keep_only(*kinds: str) -> None:
    """As a task begins: forget what tasks of other operators kept, and give memory that lies idle back to the system."""
    for old in [k for k in _kept if k[0] not in kinds]:
        del _kept[old]
    gc.collect(0)
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the text of `column` exceeds `most` bytes.

    A single longer text makes a slice of its own; no text is ever cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + most
            end = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def spans(lengths: np.ndarray) -> np.ndarray:
    """Where each of the pieces with these lengths starts, and where the last ends."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
