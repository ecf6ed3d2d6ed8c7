"""Benchmark decontamination by suffix arrays of the training text.

Each task sorts the word suffixes of its shard of documents and finds the
windows of all benchmark items in that array by binary search; the range that
a search ends in holds all places where the window occurs verbatim. Only words
in runs of benchmark words can begin a match, so the array holds the suffixes
of these runs and none else, sorted as deep as a window reaches; and only
windows are searched all of whose pairs of adjacent words the shard has.

The texts stay where they were read: nothing is shuffled. A benchmark of up to
GROUP_BYTES of text is sent to the tasks as it is. A larger one is dealt into groups of
about that size by a hash, never all of it to the driver or a task; each group
has a pass of its own over the documents, in which a worker builds it once, and
what the passes found is put together for each document. A document is one row
and its matches are found together, whichever items they are from.

Words: A-Z in lower case, runs of digits, a-z and all that is not ASCII.
A window is `window` consecutive words of an item, or all words of a shorter
one. Null and empty texts have no words and are clean; an item without words
matches nothing; rows repeated in either table count as often in the
documents, once in the benchmark's item_ids, which may be of any type that sorts;
what an item without an id matches is hit, but no id tells of it. An empty
benchmark leaves all. Very long texts are shards of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, keep_only, kept, named, numbered, slices, spans, texts_of

WINDOW = 10
GROUP_BYTES = 4 << 20
SLICE_BYTES = 1 << 20

_FORM = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
_BASE, _ROOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Words:
    """The words of some texts: hash, place in the bytes, and number of the text."""

    LARGEST = 4 << 20  # of the tables of powers that a worker keeps

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = b"\n".join(parts) + b"\n"
        starts_of_texts = spans(np.array([len(p) + 1 for p in parts], np.int64))
        form = _FORM[np.frombuffer(self.bytes, np.uint8)]
        edge = np.diff((form != 0).astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(starts_of_texts, self.start, side="right") - 1
        self.per_text = np.bincount(self.text, minlength=len(texts))
        own = 1 << max(16, len(form).bit_length())
        tables = lambda: (_powers(_BASE, own), _powers(_ROOT, own))
        up, down = kept("powers", own, tables) if own <= self.LARGEST else tables()
        with np.errstate(over="ignore"):
            sums = np.zeros(len(form) + 1, np.uint64)
            np.cumsum(form * up[: len(form)], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * down[self.start]
            self.hash = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].translate(_FORM.tobytes())


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of `ids` by their first `depth` ids or more, by doubling."""
    n, known = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while known < depth and n:
        nxt = np.full(n, -1, np.int64)
        nxt[: max(0, n - known)] = rank[known:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        known *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Benchmark:
    """Vocabulary and windows of some items; equal windows are one."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        words = Words([t for _, t in items])
        self.items = [i for i, _ in items]
        self.vocabulary, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
        self.spelt = [words.word(i) for i in first]
        n = words.per_text
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)  # windows of each item
        item = np.repeat(np.arange(len(n)), count)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(n[item], window)
        at = (np.cumsum(n) - n)[item] + offset
        inside = np.arange(window) < size[:, None]
        rows = np.where(inside, ids[np.minimum(at[:, None] + np.arange(window), max(len(ids) - 1, 0))] + 1 if len(ids) else 0, 0).astype(np.int32)
        whole = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * window))).ravel()
        _, kinds, number = np.unique(whole, return_index=True, return_inverse=True)
        self.windows, self.sizes = rows[kinds], size[kinds].astype(np.int64)
        order = np.argsort(number, kind="stable")
        self.item, self.offset = item[order].astype(np.int32), offset[order]
        self.first = np.searchsorted(number[order], np.arange(len(kinds) + 1))  # of each window in item and offset
        self.pairs = self.pair(self.windows[:, :-1], self.windows[:, 1:])

    @staticmethod
    def pair(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """A number below 2 ** 20 for two words that follow each other, 0 for a word and none."""
        with np.errstate(over="ignore"):
            h = (one.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (other.astype(np.uint32) * np.uint32(0x85EBCA6B))
        return np.where((one > 0) & (other > 0), (h * np.uint32(0xC2B2AE35)) >> np.uint32(12), 0).astype(np.int32)

    def likely(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the windows all of whose words, and pairs of words, `ids` may have."""
        word, pair = np.zeros(len(self.vocabulary) + 1, bool), np.zeros(1 << 20, bool)
        word[ids] = True
        word[0] = pair[0] = True
        pair[self.pair(ids[:-1], ids[1:])] = True
        out = np.flatnonzero(word[self.windows[:, 0]])
        for k in range(self.pairs.shape[1]):
            out = out[pair[self.pairs[out, k]]]
        for k in range(1, self.windows.shape[1]):
            out = out[word[self.windows[out, k]]]
        return out

    def places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these windows, where it is in `item` and `offset`: which of `windows`, and where."""
        n = self.first[windows + 1] - self.first[windows]
        of = np.repeat(np.arange(len(windows)), n)
        return of, self.first[windows][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(number of a word, number of the window that occurs from there on), all of them."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.sizes) or not len(words.hash):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == words.hash, at + 1, 0)
        while True:
            new_run = np.flatnonzero(np.diff(words.text, prepend=-1) | (ids == 0) | np.r_[True, ids[:-1] == 0])
            length = np.diff(np.append(new_run, len(ids)))
            kept = np.repeat((length >= self.sizes.min()) & (ids[new_run] > 0), length)
            place = np.flatnonzero(kept)
            if not len(place):
                return none
            gap = np.r_[False, np.repeat(np.arange(len(length)), length)[place][1:] != np.repeat(np.arange(len(length)), length)[place][:-1]]
            to = np.arange(len(place)) + np.cumsum(gap)  # a zero between runs
            text = np.zeros(to[-1] + 1 + self.windows.shape[1], np.int64)
            text[to] = ids[place]
            origin = np.full(len(text), -1, np.int64)
            origin[to] = place
            likely = self.likely(text)
            if not len(likely):
                return none
            order = suffix_array(text, self.windows.shape[1])
            low, high = self.bound(likely, text, order, False), self.bound(likely, text, order, True)
            n = high - low
            window = np.repeat(likely, n)
            where = origin[order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            hit = np.unique(np.concatenate([where + k for k in range(self.windows.shape[1])])) if len(where) else where
            wrong = [i for i in hit if i < len(ids) and ids[i] and words.word(i) != self.spelt[ids[i] - 1]]
            if not wrong:
                return where, window
            ids[wrong] = 0  # another word of the same hash

    def bound(self, likely: np.ndarray, text: np.ndarray, order: np.ndarray, right: bool) -> np.ndarray:
        windows, sizes = self.windows[likely], self.sizes[likely]
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(order), np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            sign = np.zeros(len(low), np.int64)  # of the suffix against the window
            for k in range(windows.shape[1]):
                own = text[np.minimum(at + k, len(text) - 1)]
                sign = np.where((sign == 0) & (k < sizes), np.sign(own - windows[:, k]), sign)
            before = (sign < 0) | (right & (sign == 0))
            going = low < high
            low = np.where(going & before, middle + 1, low)
            high = np.where(going & ~before, middle, high)
        return low


class Search:
    """Goes to the tasks: a group of benchmark items, and how to hold texts against it."""

    def __init__(self, items: DataFrame, window: int = WINDOW):
        self.window, self.key = window, uuid.uuid4().hex
        rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).collect()  # of a group's size
        self.sent = items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows])

    def group(self) -> Benchmark:
        """The group as this worker built it."""
        return kept("benchmark", self.key, lambda: Benchmark(self.sent.value, self.window))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]], list[list]]:
        """Of each text: words, edges of the runs of words that are hit (first, last and one more, first, ...), and the items with windows in it."""
        words, group = Words(texts), self.group()
        edges = np.zeros(len(words.hash) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        where, window = group.search(words)
        np.add.at(edges, where, 1)
        np.add.at(edges, where + group.sizes[window], -1)
        both = np.unique(np.stack([words.text[where], window], axis=1), axis=0)
        of, place = group.places(both[:, 1])
        for text, item in np.unique(np.stack([both[of, 0], group.item[place]], axis=1), axis=0):
            items[text].add(group.items[item])
        hit = np.cumsum(edges)[:-1] > 0
        first = spans(words.per_text)
        change = np.flatnonzero(np.diff(hit, prepend=False) | (hit & (np.diff(words.text, prepend=-1) != 0)))
        runs: list[list[int]] = [[] for _ in texts]
        for a, b in zip(change.tolist(), [*change[1:].tolist(), len(hit)]):
            if hit[a]:
                text = int(words.text[a])
                runs[text] += [a - int(first[text]), min(b, int(first[text + 1])) - int(first[text])]
        return words.per_text, runs, [sorted(i for i in own if i is not None) for own in items]

    def longest(self, texts: list[str]) -> list[tuple]:
        """(number of the text, its word, item, its word, words): matches that no word can be added to."""
        words, out, group = Words(texts), [], self.group()
        first = spans(words.per_text)
        where, window = group.search(words)
        of, place = group.places(window)
        pairs = {(a, i, j): s for a, i, j, s in zip(where[of].tolist(), group.item[place].tolist(), group.offset[place].tolist(), group.sizes[window][of].tolist())}
        for (a, i, j), size in pairs.items():
            if (a - 1, i, j - 1) not in pairs or words.text[a - 1] != words.text[a]:
                k = 0
                while (a + k + 1, i, j + k + 1) in pairs and words.text[a + k + 1] == words.text[a]:
                    k += 1
                out.append((int(words.text[a]), int(a - first[words.text[a]]), group.items[i], j, size + k))
        return out


def groups_of(bench: DataFrame, window: int) -> Iterator[Callable[[], Search]]:
    """How to send out each group of items, of about GROUP_BYTES of text; one item is never parted."""
    bench = bench.select("item_id", "text").distinct()  # so that a group is no larger because a row is repeated
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // GROUP_BYTES) or 1
    number = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    for k in range(n):
        yield lambda k=k: Search(bench if n == 1 else bench.filter(number == k), window)


def _pass(docs: DataFrame, search: Search, item: T.DataType, keep: str) -> DataFrame:
    kind = to_arrow_type(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("powers", "benchmark")
        for batch in slices(batches, "text", SLICE_BYTES):
            n_words, runs, items = search.texts(texts_of(batch))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=[keep, "n_words", "runs", "items"])

    return docs.select(named(keep).cast("long"), "text").mapInArrow(run, f"{keep} long, n_words long, runs array<long>, items array<{item.simpleString()}>")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit and the item_ids found, for each document."""
    item = bench.schema["item_id"].dataType
    groups = list(groups_of(bench, window))
    ends = lambda runs: F.aggregate(F.sequence(F.lit(0), (F.size(runs) / 2 - 1).cast("int")), F.lit(0).cast("long"), lambda n, i: n + runs[(2 * i + 1).cast("int")] - runs[(2 * i).cast("int")])
    length = lambda runs: F.when(F.size(runs) > 0, ends(runs)).otherwise(F.lit(0).cast("long"))
    if len(groups) == 1:
        return _pass(docs, groups[0](), item, "doc_id").select("doc_id", "n_words", length(F.col("runs")).alias("n_hit"), "items")
    rows, name = numbered(docs)
    found = None
    for group in groups:
        own = cut(_pass(rows, group(), item, name))
        found = own if found is None else found.union(own)
    parts = F.flatten(F.transform(F.collect_list("runs"), lambda r: F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(0), (F.size(r) / 2 - 1).cast("int")), lambda i: F.struct(r[(2 * i).cast("int")].alias("a"), r[(2 * i + 1).cast("int")].alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    union = F.aggregate(F.array_sort(parts), none, lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], r["b"]).alias("upto")))["n"]
    joined = found.groupBy(name).agg(F.first("n_words").alias("n_words"), union.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select(named("doc_id").cast("long").alias("doc_id"), named(name)).join(joined, name).select("doc_id", "n_words", "n_hit", "items")


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches: doc_id, doc_word, item_id, item_word, n_words."""
    item = bench.schema["item_id"].dataType
    kinds = [pa.int64(), pa.int64(), to_arrow_type(item), pa.int64(), pa.int64()]
    out = None
    for group in groups_of(bench, window):
        search = group()

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            keep_only("powers", "benchmark")
            for batch in slices(batches, "text", SLICE_BYTES):
                ids = batch.column(0).to_pylist()
                rows = [(ids[t], a, i, j, n) for t, a, i, j, n in search.longest(texts_of(batch))]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_word", "item_id", "item_word", "n_words"])

        own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, doc_word long, item_id {item.simpleString()}, item_word long, n_words long")
        out = own if out is None else out.union(own)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts hold no window of the benchmark.

    With several groups each pass only writes the numbers of the rows that are hit; these go at the end, all at once.
    """
    groups = list(groups_of(bench, window))
    if len(groups) == 1:
        search = groups[0]()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only("powers", "benchmark")
            for batch in slices(batches, "text", SLICE_BYTES):
                yield batch.filter(pa.array([not runs for runs in search.texts(texts_of(batch))[1]]))

        return docs.mapInArrow(run, docs.schema)
    rows, name = numbered(docs)
    hit = None
    for group in groups:
        own = cut(_hit(rows.select(named(name).alias("row"), "text"), group()))
        hit = own if hit is None else hit.union(own)
    return rows.join(hit.distinct().withColumnRenamed("row", name), name, "left_anti").select(*map(named, docs.columns))


def _hit(rows: DataFrame, search: Search) -> DataFrame:
    """The numbers of the rows whose texts hold a window of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("powers", "benchmark")
        for batch in slices(batches, "text", SLICE_BYTES):
            hit = pa.array([bool(runs) for runs in search.texts(texts_of(batch))[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit)], names=["row"])

    return rows.mapInArrow(run, "row long")
