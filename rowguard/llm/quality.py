"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text gives DIMENSIONS statistics, transformed so that their spread is
nearer to normal. The class means and covariances come from sums over all
labelled rows, which Spark takes; only those sums reach the driver. Each
covariance is shrunk towards the pooled one and towards a sphere, its Cholesky
factor's inverse is kept, and a text's score is the logistic of the difference
of the two log densities (squared Mahalanobis lengths by that inverse, and the
factors' log determinants) plus that of the log shares of the classes.

Null and empty texts have the statistics of no text and are scored like any
other. Texts are read whole, however long; an empty table has no rows; of a
document only doc_id and text are read. Repeated rows are each scored; of repeated labels each counts. Rows
without a label only get scores. With one class only, its share (0 or 1)
is the score of all; with no labels it is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, keep_only, named, slices, spans, stored, texts_of
from .decontam import Words

NAMES = ["words", "letters", "capitals", "digits", "stops", "signs", "bars", "bangs", "lines", "word_length", "repeats", "others"]
DIMENSIONS = len(NAMES)
_CLASS = np.zeros(256, np.uint8)  # 0: blank or control
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[33:127][_CLASS[33:127] == 0] = 5
for _chars, _kind in ((b".,;:'\"()-", 4), (b"|", 6), (b"!?", 7)):
    _CLASS[list(_chars)] = _kind
_CLASS[10] = 8


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text."""
    parts = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    kinds = _CLASS[np.frombuffer(b"".join(parts), np.uint8)]
    starts = spans(np.array([len(p) for p in parts], np.int64))[:-1]
    n = [np.add.reduceat((kinds == k).astype(np.int32), starts).astype(float) for k in range(9)]
    size = np.maximum(sum(n[1:8]), 1)
    letters = np.maximum(n[1] + n[2], 1)
    words = Words(texts)
    count = words.per_text.astype(float)
    hashes = words.hash ^ (words.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(words.text[np.unique(hashes, return_index=True)[1]], minlength=len(texts))
    per = np.maximum(count, 1)
    root = lambda part, whole: np.sqrt(part / whole)
    return np.stack(
        [np.log1p(count), (n[1] + n[2]) / size, root(n[2], letters), root(n[3], size), root(n[4], size), root(n[5], size), root(n[6], size), root(n[7], size),
         np.log1p(n[8] / per), np.log1p(letters / per), np.log((distinct + 1) / (count + 1)), root(size - n[1] - n[2] - n[4], size)],
        axis=1,
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x: the statistics of each text. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("powers")
        for batch in slices(batches, "text", 1 << 20):
            x = statistics(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Two classes: means, Cholesky factors of the shrunk covariances, log shares."""

    def __init__(self, labelled: DataFrame, pooling: float = 0.2, rounding: float = 0.02):
        wide = labelled.filter("quality in (0, 1)").select("quality", *[F.col("x")[i].alias(f"x{i}") for i in range(DIMENSIONS)])
        middle = wide.agg(*[F.avg(f"x{i}") for i in range(DIMENSIONS)]).first()  # sums of squares around it lose no digits
        x = [F.col(f"x{i}") - F.lit(m or 0.0) for i, m in enumerate(middle)]
        sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
        squares = [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(DIMENSIONS) for j in range(i + 1)]
        rows = wide.groupBy("quality").agg(F.count("*").alias("n"), *sums, *squares).collect()
        self.n = {r.quality: r.n for r in rows}
        self.parts = {}
        if len(self.n) < 2:
            return
        means, scatter = {}, {}
        for r in rows:
            off = np.array([r[f"s{i}"] for i in range(DIMENSIONS)]) / r.n
            means[r.quality] = off + np.array(middle)
            q = np.zeros((DIMENSIONS, DIMENSIONS))
            for i in range(DIMENSIONS):
                for j in range(i + 1):
                    q[i, j] = q[j, i] = r[f"q{i}_{j}"] / r.n - off[i] * off[j]
            scatter[r.quality] = q
        total = sum(self.n.values())
        pooled = sum(scatter[k] * self.n[k] for k in scatter) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        for k in scatter:
            cov = ((1 - pooling) * scatter[k] + pooling * pooled) / np.outer(self.scale, self.scale)
            cov = (1 - rounding) * cov + rounding * max(np.trace(cov) / DIMENSIONS, 1e-6) * np.eye(DIMENSIONS)
            factor = np.linalg.cholesky(cov)
            self.parts[k] = means[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(self.n[k] / total)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), 1.0 if self.n.get(1) else 0.0 if self.n else 0.5)
        logs = []
        for k in (0, 1):
            mean, inverse, log_det, log_share = self.parts[k]
            z = ((x - mean) / self.scale) @ inverse.T
            logs.append(log_share - 0.5 * ((z**2).sum(axis=1) + log_det))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def learn(found: DataFrame, labels: DataFrame, **shrinkage: float) -> Model:
    """Fit to `features` and the `labels` (doc_id, quality) that are to be learned from."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id is not null and quality is not null")
    return Model(cut(found.select("doc_id", "x").join(own, "doc_id")), **shrinkage)


def score(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each row of `features`."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            s = sent.value.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of all `docs`, learned from `labels`."""
    found = cut(features(docs))
    return score(found, learn(found, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted to be bad.

    Statistics are taken once and written beside the rows.
    """
    x = fresh("x", docs.columns)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("powers")
        for batch in slices(batches, "text", 1 << 20):
            own = pa.array(list(statistics(texts_of(batch))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, x])

    found = stored(docs.mapInArrow(measure, T.StructType([*docs.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])), "statistics")
    model = learn(found.select(F.col("doc_id").cast("long"), named(x).alias("x")), labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(own: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(np.array(own.tolist()).reshape(-1, DIMENSIONS)) >= 0.5)

    return found.filter(good(named(x))).select(*map(named, docs.columns))
