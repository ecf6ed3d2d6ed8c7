"""Validation on streams: stateless, so rows pass as they come, in any output mode."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.checks import matches_type
from ..functions.logic import column, negated
from ..functions.registry import DEFAULT, TypeRegistry
from ..functions.values import value
from ..operators.frame import errors_in, log, with_validation


def validated(stream: DataFrame, schema, **how) -> DataFrame:
    """The stream with is_valid and errors."""
    return with_validation(stream, schema, **how)


def error_counts(stream: DataFrame, schema, time: str, window: str, delay: str, **how) -> DataFrame:
    """How often each error comes in each window of event time. Rows later than `delay` are not counted."""
    errors = errors_in(stream, schema, **how).select(F.col(time).cast("timestamp").alias("at"), "error")
    return errors.withWatermark("at", delay).groupBy(F.window("at", window), "error").agg(F.count("*").alias("count"))


def split_to(stream: DataFrame, schema, path: str, quarantine: str, checkpoint: str, **how) -> StreamingQuery:
    """Valid rows and the others, with errors, to two folders of Parquet, batch by batch.

    A batch is read and checked once, kept while both folders are written. One
    that is done again overwrites what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = with_validation(batch, schema, valid="_is_valid", **how).persist()
        checked.filter("_is_valid").drop("_is_valid", "errors").write.mode("overwrite").parquet(f"{path}/batch={number}")
        checked.filter("NOT _is_valid").drop("_is_valid").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        checked.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


@dataclass(frozen=True)
class BatchCount:
    batch: int
    rows: int
    failed: int


def asserted(stream: DataFrame, source: str, types: str | list[str], name: str, registry: TypeRegistry = DEFAULT) -> DataFrame:
    """The stream as it is; each batch tells under `name` how many rows it has and how many are of none of the types. Nothing fails."""
    wrong = negated(matches_type(types, value(stream, source), registry))
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(column(wrong)).alias("failed"))


class Assertions(StreamingQueryListener):
    """What `asserted` streams tell, batch by batch: `counts` by name. Failures are logged as warnings.

    With `limit`, a share of the rows of a batch, `exceeded` has the names that went beyond it;
    `stop_beyond` ends a query then. Add it by ``spark.streams.addListener``.
    """

    def __init__(self, limit: float | None = None):
        super().__init__()
        self.limit, self.counts, self.exceeded = limit, {}, set()
        self._changed = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._changed.set()

    def onQueryProgress(self, event) -> None:
        for name, seen in event.progress.observedMetrics.items():
            if {"rows", "failed"} <= set(seen.__fields__):
                self.note(name, event.progress.batchId, seen["rows"], seen["failed"])

    def note(self, name: str, batch: int, rows: int, failed: int) -> None:
        self.counts.setdefault(name, []).append(BatchCount(batch, rows, failed))
        if failed:
            log.warning("Assertion failed: %s: %d of %d rows in batch %d", name, failed, rows, batch)
        if self.limit is not None and failed > self.limit * rows:
            self.exceeded.add(name)
            self._changed.set()

    def stop_beyond(self, query: StreamingQuery, every: float = 0.5) -> bool:
        """Wait for the end of the query, or end it once a limit is exceeded: whether one was."""
        while query.isActive:
            self._changed.wait(every)
            if self.exceeded:
                query.stop()
        return bool(self.exceeded)
