"""Language identification by interpolated Kneser-Ney models of letters.

A text is read in lower case, everything between letters as one blank, and
each language has a model of a letter given the two before it. The highest
order has counts; the lower ones count the different letters that precede
(continuation counts), and each order is interpolated with the next lower one,
down to a uniform share of all letters seen.

Counting goes over all learning rows: a task counts its texts, Spark sums and
derives the continuation counts. The driver gets every distinct n-gram, works
out the log probabilities once, in sorted arrays of whole keys that tasks
search, and sends them out: 8 bytes for each trigram and 8 more for each
language. That grows with the letters of the scripts, not with the rows, but a
script of many letters can have millions; there is no path for models that
driver and executors cannot hold. Scoring shuffles nothing.

The prediction is the language of the lowest cross-entropy per letter. It is
rejected where that lies above the median of the language's learning rows by
more than `tolerance` times the distance of their 99th percentile from it (0.1
at least): up to one row in a hundred may be junk under a language's name without
moving the limit, and more rows do not raise it. A language none of whose learning
rows is predicted as such has no limit. Null texts and texts
without a letter get `und`, score 0, and are rejected. Ties go to the language
that sorts first. With nothing to learn from all are `und`. Repeated rows are
each scored; rows with null language are scored, not learned from. Texts are read
whole, however long; an empty table has no rows. Only the text, the language and
the columns to keep are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, keep_only, named, slices, spans, stored, texts_of

TOLERANCE = 10.0

_SHIFT = 21  # bits of a code point
_ONE, _TWO = (1 << _SHIFT) - 1, (1 << 2 * _SHIFT) - 1
_BLANK = 32
_is_letter: list[np.ndarray] = []


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all trigrams, text after text, and how many each text has: none if it has no letter."""
    if not _is_letter:
        _is_letter.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    low = [t.lower() for t in texts]
    code = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = spans(np.array([len(t) + 1 for t in low], np.int64))  # of the blank before each text
    letter = _is_letter[0][code]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # a blank after each word; the first word has the one before it
    of = np.searchsorted(ends, np.flatnonzero(kept), side="right") - 1
    code = np.where(letter, code, _BLANK)[kept]
    of = np.where((code == _BLANK), np.r_[0, of[:-1]], of)  # the blank after a text's last word lies before the next
    first = np.diff(of, prepend=-1) != 0
    one = np.r_[_BLANK, code[:-1]]
    one[first] = _BLANK
    two = np.r_[_BLANK, one[:-1]]
    two[first] = _BLANK
    return (two << 2 * _SHIFT) | (one << _SHIFT) | code, np.bincount(of, minlength=len(texts))


def count(docs: DataFrame, lang: str) -> DataFrame:
    """lang, key, n of all trigrams of the rows whose language is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, "text", 1 << 18):
            keys, n = trigrams(texts_of(batch))
            langs = np.array(batch.column(0).to_pylist(), object)
            for own in sorted(set(langs)):
                found, times = np.unique(keys[np.repeat(langs == own, n)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.string()), pa.array(found), pa.array(times)], names=["lang", "key", "n"])

    rows = docs.select(F.col(lang).alias("lang"), "text").filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model:
    """Sorted arrays of all n-grams seen, with what every language makes of them."""

    def __init__(self, grams: DataFrame):
        grams = cut(grams)
        self.langs = sorted(r.lang for r in grams.select("lang").distinct().toLocalIterator())
        if not self.langs:
            return
        pairs = grams.groupBy("lang", F.col("key").bitwiseAND(_TWO).alias("key")).agg(F.count("*").alias("n"))
        singles = pairs.groupBy("lang", F.col("key").bitwiseAND(_ONE).alias("key")).agg(F.count("*").alias("n"))
        three, two, one = self.table(grams), self.table(pairs), self.table(singles)
        after_two, after_one = self.contexts(grams), self.contexts(pairs)
        discount = [self.discount(t) for t in (one, two, three)]
        n = one["n"].sum(axis=0)
        letters = len(one["key"]) + 1
        share = lambda t, d: np.maximum(t["n"] - d, 0)
        floor = discount[0] * (one["n"] > 0).sum(axis=0) / n / letters
        self.unseen = np.log(floor)
        self.one = one["key"], share(one, discount[0]) / n + floor
        self.back_one = after_one["key"], *self.weights(after_one, discount[1])
        self.back_two = after_two["key"], *self.weights(after_two, discount[2])
        self.two = two["key"], self.mixed(two, discount[1], self.back_one, self.unigram(two["key"] & _ONE))
        self.three = three["key"], np.log(self.mixed(three, discount[2], self.back_two, self.bigram(three["key"] & _TWO)))

    def table(self, grams: DataFrame) -> dict:
        """All keys, sorted, and n of each for each language."""
        return self.sums(grams.select("lang", "key", "n"), "n")

    def contexts(self, grams: DataFrame) -> dict:
        """key of what stands before, and for each language how often it does and before how many letters."""
        rows = grams.groupBy("lang", F.shiftright("key", _SHIFT).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        return self.sums(rows, "n", "kinds")

    def sums(self, frame: DataFrame, *columns: str) -> dict:
        rows = frame.toPandas()
        keys, at = np.unique(rows["key"].to_numpy(np.int64), return_inverse=True)
        out = {"key": keys}
        for c in columns:
            out[c] = np.zeros((len(keys), len(self.langs)))
            out[c][at, np.searchsorted(self.langs, rows["lang"])] = rows[c]
        return out

    @staticmethod
    def discount(table: dict) -> np.ndarray:
        once, twice = (table["n"] == 1).sum(axis=0), (table["n"] == 2).sum(axis=0)
        return np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9)

    @staticmethod
    def weights(after: dict, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each context one over its count, and the weight of the lower order (1 where it is unknown)."""
        known = after["n"] > 0
        per = np.where(known, 1 / np.maximum(after["n"], 1), 0)
        return per, np.where(known, discount * after["kinds"] * per, 1)

    def mixed(self, table: dict, discount: np.ndarray, back: tuple, lower: np.ndarray) -> np.ndarray:
        at = np.searchsorted(back[0], table["key"] >> _SHIFT)
        return np.maximum(table["n"] - discount, 0) * back[1][at] + back[2][at] * lower

    @staticmethod
    def find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def unigram(self, keys: np.ndarray) -> np.ndarray:
        at, hit = self.find(self.one[0], keys)
        return np.where(hit[:, None], self.one[1][at], np.exp(self.unseen))

    def bigram(self, keys: np.ndarray) -> np.ndarray:
        at, hit = self.find(self.two[0], keys)
        out = self.two[1][at]
        if not hit.all():
            miss = keys[~hit]
            known, there = self.find(self.back_one[0], miss >> _SHIFT)
            out[~hit] = np.where(there[:, None], self.back_one[2][known], 1) * self.unigram(miss & _ONE)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of each text by each language, and the number of letters and blanks read."""
        keys, n = trigrams(texts)
        total = np.zeros((len(texts), len(self.langs)))
        if len(keys):
            at, hit = self.find(self.three[0], keys)
            logs = self.three[1][at]
            if not hit.all():
                miss = keys[~hit]
                known, there = self.find(self.back_two[0], miss >> _SHIFT)
                logs[~hit] = np.log(np.where(there[:, None], self.back_two[2][known], 1) * self.bigram(miss & _TWO))
            full = np.flatnonzero(n)
            total[full] = -np.add.reduceat(logs, (np.cumsum(n) - n)[full], axis=0)
        return total / np.maximum(n, 1)[:, None], n


def learn(docs: DataFrame, lang: str = "lang") -> Model:
    return Model(count(docs, lang))


SCORES = "lang_pred string, score double, entropy double, n_letters long"


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` and SCORES, before any rejection."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        keep_only()
        for batch in slices(batches, "text", 1 << 18):
            texts = texts_of(batch)
            if own.langs:
                h, n = own.entropies(texts)
                best, least = h.argmin(axis=1), h.min(axis=1)
                sure = 1 / np.exp(-(h - least[:, None]) * np.minimum(n, 100)[:, None]).sum(axis=1)
            else:
                n = best = least = sure = np.zeros(len(texts), np.int64)
            some = n > 0
            found = [pa.array([own.langs[b] if s else "und" for b, s in zip(best, some)], pa.string()), pa.array(np.where(some, sure, 0.0)), pa.array(np.where(some, least, 0.0)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names=[*batch.schema.names[1:], "lang_pred", "score", "entropy", "n_letters"])

    own = docs.select("text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(run, f"{schema}, {SCORES}")


def highest(scored: DataFrame, lang: str, learned: Column, tolerance: float, pred: str = "lang_pred", entropy: str = "entropy") -> Column:
    """The entropy up to which the predicted language is accepted, null where there is no limit."""
    right = scored.filter(learned & (named(lang) == named(pred)))
    at = right.groupBy(named(pred).alias("lang")).agg(F.percentile_approx(named(entropy), [0.5, 0.99], 10_000).alias("q"))
    out = F.lit(None).cast("double")
    for name, (middle, high) in at.collect():
        out = F.when(named(pred) == name, F.lit(middle + tolerance * max(high - middle, 0.1))).otherwise(out)
    return out


def calibrate(scored: DataFrame, lang: str, learned: Column, tolerance: float = TOLERANCE) -> DataFrame:
    """`scored` with rejected: und, or an entropy too far beyond what the language's learning rows have."""
    most = highest(scored, lang, learned, tolerance)
    return scored.withColumn("rejected", F.coalesce((F.col("lang_pred") == "und") | (F.col("entropy") > most), F.lit(False)))


def identify(docs: DataFrame, learned: Column, keep: list[str], lang: str = "lang", tolerance: float = TOLERANCE) -> DataFrame:
    """Learn from the rows where `learned` holds and score all: `keep`, SCORES and rejected. `keep` has to name `lang`."""
    model = learn(docs.filter(learned), lang)
    return calibrate(cut(score(docs, model, keep)), lang, learned, tolerance)


def keep_known(docs: DataFrame, lang: str = "lang", tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not rejected, learned from all rows with a language.

    Scored once: rows and scores are written, the limits taken from the scores, and the rest read back.
    """
    model = learn(docs, lang)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    pred, entropy = fresh("lang_pred", docs.columns), fresh("entropy", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        keep_only()
        for batch in slices(batches, "text", 1 << 18):
            langs, least = [None] * batch.num_rows, np.zeros(batch.num_rows)
            if own.langs:
                h, n = own.entropies(texts_of(batch))
                langs, least = [own.langs[b] if k else None for b, k in zip(h.argmin(axis=1), n)], h.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(least)], names=[*batch.schema.names, pred, entropy])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(entropy, T.DoubleType())])
    scored = stored(docs.mapInArrow(run, schema), "languages")
    most = highest(scored, lang, F.lit(True), tolerance, pred, entropy)
    return scored.filter(named(pred).isNotNull() & F.coalesce(named(entropy) <= most, F.lit(True))).select(*map(named, docs.columns))
