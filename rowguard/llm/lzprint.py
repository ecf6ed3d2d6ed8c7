"""Lempel-Ziv phrase fingerprints.

A text is parsed once into dictionary phrases: each phrase is the shortest
string that is not in the dictionary yet, and joins it. The set of phrases is
what a compressor of this family would learn from the text. Each phrase is
hashed, the hashes are dealt into BINS bins, and the least of each bin is kept
(16 bits of it): a minimum-hash signature. The likeness of two texts is the
share of equal bins among those that either fills, which estimates the Jaccard
likeness of their phrase sets.

`with_next` also holds each document against the next by doc_id and against an
edit, half itself and half the next. The texts are shuffled once, into ranges
of doc_id, and a task goes through its range in order with one document in
hand. The first and last rows of each range come out with their texts; these
pairs, two rows for each range, are then brought together in a join.

Null texts are empty; an empty text has no phrase and a fingerprint of empty
bins, like that of another empty text and unlike any other's. Rows that share
a doc_id follow one another by text. The next of the last row is the first; a
single row is its own next. No rows give no rows. A text is parsed whole, however
long, in one task: some hundreds of bytes for each phrase while it lasts, of which a
text has at most about as many as characters divided by their logarithm.
Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, keep_only, slices, spans, texts_of
from .decontam import _powers

BINS = 128
_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
_EMPTY = 0xFFFF


class Parse:
    """A dictionary of phrases as a tree of dicts; `ends` has where each phrase of the text ends."""

    def __init__(self):
        self.root: dict = {}
        self.node = self.root
        self.ends: list[int] = []
        self.added: list[tuple[dict, str]] = []

    def feed(self, text: str, start: int, undo: bool = False) -> None:
        root, node, ends = self.root, self.node, self.ends
        added = self.added
        for at, char in enumerate(text, start + 1):
            deeper = node.get(char)
            if deeper is None:
                node[char] = {}
                if undo:
                    added.append((node, char))
                node = root
                ends.append(at)
            else:
                node = deeper
        self.node = node

    def back(self, node: dict, n_ends: int) -> None:
        """Forget what was fed with `undo`."""
        for at, char in reversed(self.added):
            del at[char]
        self.added.clear()
        self.node = node
        del self.ends[n_ends:]


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def phrase_ends(text: str, following: str) -> tuple[list[int], list[int]]:
    """Ends of the phrases of a text and of its edit; what they begin with is parsed once."""
    half = len(text) // 2
    split = len(text) - half
    parse = Parse()
    parse.feed(text[:split], 0)
    node, n = parse.node, len(parse.ends)
    parse.feed(text[split:], split, undo=True)
    own = parse.ends[:]
    parse.back(node, n)
    parse.feed(following[:half], split)
    return own, parse.ends


_tables = [_powers(_UP, 1), _powers(_DOWN, 1)]


def signatures(texts: list[str], ends: list[list[int]]) -> np.ndarray:
    """A row of BINS 16-bit values for each text with these phrase ends; 65535 where a bin is empty."""
    out = np.full((len(texts), BINS), _EMPTY, np.uint64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    base = spans(np.array([len(t) for t in texts], np.int64))
    counts = np.array([len(e) for e in ends], np.int64)
    if not counts.sum():
        return out.astype("<u2")
    if len(code) >= len(_tables[0]):
        _tables[:] = _powers(_UP, 2 * len(code)), _powers(_DOWN, 2 * len(code))
    stop = np.fromiter((e for own in ends for e in own), np.int64, int(counts.sum()))
    of = np.repeat(np.arange(len(texts)), counts)
    start = np.r_[0, stop[:-1]]
    first = np.cumsum(counts) - counts
    start[first[counts > 0]] = 0
    start, stop = start + base[of], stop + base[of]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _tables[0][: len(code)], out=sums[1:])
        h = (sums[stop] - sums[start]) * _tables[1][start]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    bins = of * BINS + (h % np.uint64(BINS)).astype(np.int64)
    least = np.full(len(texts) * BINS, 2**64 - 1, np.uint64)
    np.minimum.at(least, bins, h)
    value = (least >> np.uint64(7)) % np.uint64(_EMPTY)
    return np.where(least == 2**64 - 1, np.uint64(_EMPTY), value).reshape(-1, BINS).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bins among those that a or b fills; 1 where neither fills any."""
    filled = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=-1)
    equal = ((a == b) & (a != _EMPTY)).sum(axis=-1)
    return np.where(filled == 0, 1.0, equal / np.maximum(filled, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (binary) of each document. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the trees hold no cycles
        keep_only()
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            found = signatures(texts, [phrase_ends(t, "")[0] for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _results(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of RESULT for pairs of a text and its next, in runs where the next is the text that follows."""
    ends = [phrase_ends(a, b) for a, b in zip(texts, following)]
    edits = [edit(a, b) for a, b in zip(texts, following)]
    own = signatures(texts, [e[0] for e in ends])
    edited = signatures(edits, [e[1] for e in ends])
    loose = [i for i, b in enumerate(following) if i + 1 == len(texts) or b is not texts[i + 1]]
    nexts = np.roll(own, -1, axis=0)
    if loose:
        nexts[loose] = signatures([following[i] for i in loose], [phrase_ends(following[i], "")[0] for i in loose])
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits], [f.tobytes() for f in own], [f.tobytes() for f in edited], likeness(own, edited), likeness(own, nexts)]
    return [pa.array(c, f.type) for c, f in zip(columns, _ARROW)]


def with_next(docs: DataFrame) -> DataFrame:
    """RESULT for each document, its edit and its next."""
    kinds = pa.schema([*_ARROW, ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of all rows of a range but the last, which comes out with its text, as does the first."""
        gc.disable()
        part, ids, texts, head = TaskContext.get().partitionId(), [], [], None
        keep_only()
        for batch in slices(batches, "text"):
            ids, texts = ids[-1:] + batch.column(0).to_pylist(), texts[-1:] + texts_of(batch)
            if head is None:
                head = texts[0]
                yield pa.RecordBatch.from_pydict({f.name: [part if f.name == "part" else head if f.name == "head" else None] for f in kinds}, kinds)
            if len(texts) > 1:
                n = len(texts) - 1
                columns = _results(ids[:-1], texts[:-1], texts[1:])
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=kinds)
        if head is not None:
            yield pa.RecordBatch.from_pydict({f.name: [{"doc_id": ids[-1], "part": part, "tail": texts[-1]}.get(f.name)] for f in kinds}, kinds)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        keep_only()
        for batch in slices(batches, "tail"):
            yield pa.RecordBatch.from_arrays(_results(batch.column(0).to_pylist(), texts_of(batch, "tail"), texts_of(batch, "head")), schema=_ARROW)

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = cut(ranged.mapInArrow(run, f"{RESULT}, part int, head string, tail string"))
    heads = found.filter("head is not null").select("part", "head")
    # A row for each range, without its text: as many as there were shuffle partitions.
    order = W.orderBy("part")
    least = F.min("part").over(W.partitionBy())
    after = heads.select("part", F.coalesce(F.lead("part").over(order), least).alias("next_part"))
    tails = found.filter("tail is not null").select("doc_id", "part", "tail")
    joined = tails.join(after, "part").join(heads.select(F.col("part").alias("next_part"), "head"), "next_part").select("doc_id", "tail", "head")
    whole = found.filter("head is null and tail is null").select([f.name for f in _ARROW])
    return whole.unionByName(joined.mapInArrow(pairs, RESULT))
