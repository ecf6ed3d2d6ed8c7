"""SimHash near-duplicates through tables of distances to pivots.

A fingerprint bit is set where over half of the XXH64 values of a text's
shingles have it. Two fingerprints link at `bits` or fewer differing bits,
and documents are grouped by the links, however long their chains.

Finding the links, exactly:

* Equal fingerprints are one. Fingerprints are cut into `bits` + 3 blocks;
  two that link differ in at most `bits` blocks, so they agree in three. Each
  fingerprint is dealt out under every choice of three blocks (about 32 bits
  of key), and only keys that two or more share go on.
* Each fingerprint has a row of Hamming distances to PIVOTS reference
  fingerprints. By the triangle inequality two that link differ by at most
  `bits` in every coordinate; pairs beyond that in any are discarded, and the
  survivors' own distance is taken.
* First all of a key are held against its least and its greatest fingerprint:
  two pairs for each row. What hangs together then, by links in any key, needs
  no further link.
* Keys that still hold several sets are compared in blocks of about MOST rows,
  which different tasks take: the largest set's members against the others,
  and those among each other. Before that, a key with over MOST of the others is
  dealt out anew under pairs of five parts of its remaining bits, which loses
  no link either. No pairs are written out there, only links that join sets.

Null and empty texts have fingerprint 0 and link like any other. Rows repeated
are all returned, in one group. Texts are read whole, however long; an empty
table has no rows. Only doc_id and text are read. Rows with null
doc_id get a group of their least doc_id that is not null, if there is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, combinations, groupby
from operator import add, itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_only, named, numbered, slices, spans, texts_of
from .components import components

PIVOTS = 24
MOST = 512
_BYTES = np.uint64(0x0101010101010101)


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of `size` words, A-Z in lower case; all words if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    at, starts = 0, []
    for word in words:
        starts.append(at)
        at += len(word) + 1
    return [joined[a : b - 1] for a, b in zip(starts, starts[size:] + [at])]


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, text after text, and how many each text has."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = [digest(s, 42) for s in shingles(text, size)]
        counts[i] = len(own)
        hashes += own
    return np.array(hashes, np.uint64), counts


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprints as unsigned 64-bit integers. Eight byte-wide counters to a word, emptied every 255 shingles."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    groups = -(-counts[full] // 255)
    of = np.repeat(np.arange(len(full)), groups)
    first = np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups)
    starts = (np.cumsum(counts[full]) - counts[full])[of] + 255 * first
    edges = np.cumsum(groups) - groups
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _BYTES, starts)
        set_in = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), edges, axis=0)
        for byte in range(8):
            out[full] |= (2 * set_in[:, byte] > counts[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints_of(texts: list[str], size: int) -> np.ndarray:
    return majority(*shingle_hashes(texts, size))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, "text"):
            found = fingerprints_of(texts_of(batch), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks(bits: int, equal: int = 3) -> list[int]:
    """Masks of `equal` of `bits` + `equal` blocks."""
    ends = [64 * i // (bits + equal) for i in range(bits + equal + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(blocks, equal)]


def finer_masks(mask: int, bits: int, equal: int = 2) -> list[int]:
    """Masks of `equal` of `bits` + `equal` parts of the bits that are not in `mask`."""
    rest = [b for b in range(64) if not mask >> b & 1]
    ends = [len(rest) * i // (bits + equal) for i in range(bits + equal + 1)]
    return [sum(c) for c in combinations([sum(1 << b for b in rest[x:y]) for x, y in zip(ends, ends[1:])], equal)]


def pivots(words: int = 1) -> np.ndarray:
    """PIVOTS reference fingerprints of so many 64-bit words."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(PIVOTS * words)], np.uint64).reshape(PIVOTS, words)


def distances(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (words of 64 bits) to the pivots."""
    refs = pivots(prints.shape[1])
    return sum(np.bitwise_count(prints[:, None, w] ^ refs[None, :, w]).astype(np.int16) for w in range(prints.shape[1]))


def within(one: Column, other: Column, far: Column, other_far: Column, words: int, bits: int) -> Column:
    """No coordinate differs by over `bits`, nor do the fingerprints."""
    apart = F.greatest(*[F.abs(far[i] - other_far[i]) for i in range(PIVOTS)])
    own = reduce(add, [F.bit_count(one[i].bitwiseXOR(other[i])) for i in range(words)])
    return (apart <= bits) & (own <= bits)


def hang_together(group: np.ndarray, prints: np.ndarray, bits: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `prints` (words of 64 bits) the first that it hangs together with in its group: by `label` alone, and by links too.

    Rows of a group are consecutive; rows of one label hang together already.
    """
    n = len(prints)
    table = distances(prints)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(np.append(starts, n))
    last, first = np.repeat(starts + sizes - 1, sizes), np.repeat(starts, sizes)
    rows, step, given = np.arange(n), 0, np.arange(n)
    if label is not None:
        order = np.lexsort((rows, label, first))
        new = (np.diff(label[order], prepend=label[order[0]] - 1) != 0) | (np.diff(first[order], prepend=-1) != 0)
        given[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    label = given.copy()
    while True:
        step += 1
        rows = rows[rows + step <= last[rows]]
        if not len(rows):
            return given, label
        near = rows[label[rows] != label[rows + step]]  # what hangs together already needs no further link
        near = near[np.abs(table[near, 0] - table[near + step, 0]) <= bits]
        near = near[(np.abs(table[near] - table[near + step]) <= bits).all(axis=1)]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]).sum(axis=1, dtype=np.int64) <= bits]
        while len(near):
            one, other = label[near], label[near + step]
            np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
            while (label != label[label]).any():
                label = label[label]
            near = near[label[near] != label[near + step]]


def open_keys(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (t, key, node) of the keys that hold several sets, with what the key holds.

    label: the row's set; n: rows of the key; most, major: rows of the largest set, and which it is.
    """
    label = roots.select("node", F.col("root").alias("label"))
    own = rows.select("t", "key", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sets = own.groupBy("t", "key", "label").agg(F.count("*").alias("of"))
    keys = sets.groupBy("t", "key").agg(F.sum("of").alias("n"), F.max(F.struct("of", "label")).alias("m")).filter("n > m.of")
    keys = keys.select("t", "key", "n", F.col("m.of").alias("most"), F.col("m.label").alias("major"))
    return cut(own.join(keys, ["t", "key"]))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of `open_keys` with g, the block: every pair of rows of different sets meets in one.

    A key of over MOST rows is cut into parts: of the largest set, and of the
    others. Each part of the others meets all parts.
    """
    minor = F.col("label") != F.col("major")
    parts, others = F.ceil(F.col("most") / MOST).cast("int"), F.ceil((F.col("n") - F.col("most")) / MOST).cast("int")
    own = F.pmod(F.xxhash64("node"), F.when(minor, others).otherwise(parts)).cast("int")
    kind = lambda k, i, j: F.struct(F.lit(k).alias("k"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_major = F.transform(upto(parts), lambda j: kind(1, own, j))
    with_others = F.transform(upto(others), lambda j: kind(2, F.least(own, j), F.greatest(own, j)))
    blocks = F.when(F.col("n") <= MOST, F.array(kind(0, F.lit(0), F.lit(0)))).when(minor, F.concat(with_major, with_others)).otherwise(F.transform(upto(others), lambda j: kind(1, j, own)))
    return rows.withColumn("b", F.explode(blocks)).withColumn("g", F.xxhash64("t", "key", "b.k", "b.i", "b.j"))


def links_in_blocks(rows: DataFrame, bits: int, members: bool) -> DataFrame:
    """Edges (u, v) by which sets within a block (g, node, label, print) hang together.

    With `members`, instead the nodes of each of these wider sets as (c, node, label):
    c is a hash of the nodes, so that one found in several blocks is one.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):  # one by one: a task's rows may be many
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
                new.append(batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1))
                held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            group, node, label, prints = held
            whole = len(group) if batch is None else int(np.searchsorted(group, group[-1]))  # the last group may go on
            if not whole:
                continue
            held = [h[whole:] for h in held]
            given, found = hang_together(group[:whole], prints[:whole], bits, label[:whole])
            joined = np.flatnonzero(given != found)
            if not members:
                yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[found[joined]])], names=["u", "v"])
                continue
            some = np.isin(found, found[joined])
            sums = np.zeros(whole, np.uint64)
            np.add.at(sums, found[some], _mixed(node[:whole][some].view(np.uint64), 2000))
            columns = [sums[found[some]].view(np.int64), node[:whole][some], label[:whole][some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["c", "node", "label"])

    dealt = rows.select("g", "node", "label", "print").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(verify, "c long, node long, label long" if members else "u long, v long").distinct()


def linked(dealt: DataFrame, bits: int, prints: DataFrame | None = None, words: int = 1, exact: Callable[[DataFrame], Jaccard] | None = None, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root): what hangs together by links of nodes that share a key (t, key); roots themselves are left out.

    `prints` has node, print and far (its distances to the pivots); without, a node is its own
    print. `exact` takes the nodes that share keys and gives what decides about
    pairs that are near enough; without, nearness decides. `finer` deals crowded keys out anew.
    """
    keys = dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("node").alias("u"), F.max("node").alias("w")).filter("n > 1")
    rows = cut(dealt.join(keys, ["t", "key"]))
    judge = exact(rows.select("node").distinct()) if exact else None
    # A pair for each row and center. Those of a crowded center are spread over parts, which each get the center's own data.
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / MOST)).cast("int").alias("part")
    stars = rows.filter("node != u").select("u", F.col("node").alias("v"), "n").union(rows.filter("node != u AND node != w").select("w", "node", "n"))
    stars = cut(stars.groupBy("u", "v").agg(F.max("n").alias("n")).select("u", "v", part))
    if prints is None:
        coordinates = lambda c: F.array(*[F.bit_count(c.bitwiseXOR(F.lit(signed(int(p))))) for p in pivots()[:, 0]])
        pairs = stars.select("u", "v", "part", *[x.alias(n) for c in "uv" for x, n in ((F.array(c), f"p_{c}"), (coordinates(F.col(c)), f"f_{c}"))])
    else:
        side = lambda c: prints.select(F.col("node").alias(c), F.col("print").alias(f"p_{c}"), F.col("far").alias(f"f_{c}"))
        pairs = stars.join(side("v"), "v").join(stars.select("u", "part").distinct().join(side("u"), "u"), ["u", "part"])
    near = pairs.filter(within(F.col("p_u"), F.col("p_v"), F.col("f_u"), F.col("f_v"), words, bits)).select("u", "v", "part")
    roots = components(judge.pairs(cut(near)) if judge else near.select("u", "v"))
    rows = open_keys(rows.filter("n > 3"), roots)  # of three, all pairs are held against each other by now
    if rows.isEmpty():
        return roots
    if finer:
        crowded = finer(rows.filter(F.col("n") - F.col("most") > MOST))
        rows = rows.filter(F.col("n") - F.col("most") <= MOST).union(open_keys(crowded, roots))
    blocks = in_blocks(rows.withColumn("print", F.array("node")) if prints is None else rows.join(prints.select("node", "print"), "node"))
    found = links_in_blocks(blocks, bits, members=judge is not None)
    return components(_edges(roots).union(judge.groups(found) if judge else found))


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def roots_of(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(node, root) of the distinct fingerprints of column `fingerprint` that links within `bits` join."""
    masks = block_masks(bits)
    own = F.col("fingerprint")
    dealt = prints.select(own.alias("node"), F.explode(F.array(*[F.struct(F.lit(i).alias("t"), own.bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k"))

    def finer(rows: DataFrame) -> DataFrame:
        node = F.col("node")
        parts = [F.array(*[F.struct(F.lit(i * 100 + j).alias("t"), node.bitwiseAND(F.lit(signed(m | p))).alias("key")) for j, p in enumerate(finer_masks(m, bits))]) for i, m in enumerate(masks)]
        return rows.select("node", F.explode(F.element_at(F.array(*parts), F.col("t") + 1)).alias("k")).select("k.t", "k.key", "node")

    return linked(dealt.select("k.t", "k.key", "node"), bits, finer=finer)


def near_duplicates(prints: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id (the least doc_id that links lead to) of each row of `fingerprints`."""
    prints = cut(prints)
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    root = roots_of(distinct, bits).select(F.col("node").alias("fingerprint"), "root")
    rooted = distinct.join(root, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return prints.join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_of(fingerprint: str):
    """The 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fingerprint)), 16, "0"))


WORDS, BANDS, LEAST = 8, 12, 3


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    h, counts = shingle_hashes(texts, size)
    ends = spans(counts)
    return [np.unique(h[a:b]) for a, b in zip(ends, ends[1:])]


def wide_of(texts: list[str], size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The shingle sets, their fingerprints of WORDS * 64 bits, and BANDS keys: each from LEAST least values of the hashes."""
    sets = shingle_sets(texts, size)
    h, counts = np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
    prints = np.stack([majority(h if not w else _mixed(h, w), counts) for w in range(WORDS)], axis=1)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for band in range(BANDS):
            for k in range(LEAST):
                least = np.minimum.reduceat(_mixed(h, 1000 + band * LEAST + k), starts)
                keys[full, band] = _mixed(keys[full, band] ^ least, 7)
    return sets, prints, keys


def alike(sets: list[np.ndarray], similarity: float, label: np.ndarray) -> np.ndarray:
    """The labels, the lesser of two wherever sets of different ones have at least this Jaccard similarity."""
    n, label = len(sets), label.copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = spans(sizes)
    mark = np.zeros(len(ids) + 1, bool)
    for i in range(n - 1):
        own = ids[ends[i] : ends[i + 1]]
        rest = np.arange(i + 1, n)
        rest = rest[(label[rest] != label[i]) & (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-9) & (sizes[rest] > 0)]
        if not len(rest):
            continue
        mark[own] = True
        both = np.array([np.count_nonzero(mark[ids[ends[j] : ends[j + 1]]]) for j in rest.tolist()])
        mark[own] = False
        for j in rest[both >= similarity * (sizes[rest] + sizes[i] - both) - 1e-9].tolist():
            one, other = sorted((label[i], label[j]))
            label[label == other] = one
    return label


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(one) or not len(other):
        return 0.0
    at = np.minimum(one.searchsorted(other), len(one) - 1)
    both = np.count_nonzero(one[at] == other)
    return both / (len(one) + len(other) - both)


class Jaccard:
    """Decides by exact Jaccard similarity. `sets` has node and own, its distinct shingle hashes, sorted."""

    def __init__(self, sets: DataFrame, similarity: float):
        self.sets, self.similarity = sets, similarity

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of (u, v, part) that are alike. Each part of a u is a group of its own, of which a task holds u's set only."""
        asked = pairs.select(F.col("v").alias("node"), "u", "part", "v")
        asked = asked.union(pairs.select("u", "part").distinct().select("u", "u", "part", F.lit(None).cast("long")))
        least = self.similarity - 1e-9

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            center = None
            for batch in batches:
                us, vs, sets = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
                out = []
                for i, v in enumerate(vs):
                    own = np.frombuffer(sets[i].as_buffer(), "<u8")
                    if v is None:
                        center = own.copy()
                    elif likeness(center, own) >= least:
                        out.append((us[i], v))
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

        rows = self.sets.join(asked, "node").select("u", "part", "v", "own")
        return rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first()).mapInArrow(check, "u long, v long")

    def groups(self, near: DataFrame) -> DataFrame:
        """Edges (u, v) that join what is alike in the sets (c, node, label) of at most two parts of MOST nodes."""
        similarity = self.similarity

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries = (e for batch in batches for e in zip(*(c.to_pylist() for c in batch.columns)))
            for _, group in groupby(entries, itemgetter(0)):
                members = list(group)
                given = np.array([m[1] for m in members], np.int64)
                found = alike([np.frombuffer(m[2], "<u8") for m in members], similarity, given)
                joined = np.flatnonzero(given != found)
                yield pa.RecordBatch.from_arrays([pa.array(given[joined]), pa.array(found[joined])], names=["u", "v"])

        rows = self.sets.join(near, "node").select("c", "label", "own")
        return rows.repartition("c").sortWithinPartitions("c").mapInArrow(decide, "u long, v long").distinct()


def bits_at(similarity: float, bits: int = WORDS * 64, slack: float = 7.0) -> int:
    """Differing bits that Jaccard `similarity` of the shingles leads to, and `slack` standard deviations more.

    Large sets would do with 5. Small ones lie further apart than the formula
    says: 4 of 5 shingles 96 bits on average (deviation 8.8), not 77.6, of 134.
    """
    angle = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * angle + slack * np.sqrt(bits * angle * (1 - angle)))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, row, and the doc_id and row of the one that stands for its group (the least doc_id, null first).

    For likeness too far for blocks of bits to find: sets of distinct shingles, of
    which those that share one of BANDS keys and lie near by wide fingerprints,
    in every pivot's coordinate first, are compared exactly: the distance only spares
    comparisons. Keys miss about one pair in 5,000 at 0.8, fewer above; the distance
    about one in 100,000 of sets of 4 and 5, practically none of larger ones.
    Null and empty texts are one group. Rows repeated are of one group. `row`
    numbers the rows.
    """
    rows, name = numbered(docs)
    every = _grouped(rows, name, shingle, similarity)
    return every.join(_first(every), "root").select("doc_id", "row", F.col("stays.doc_id").alias("group_doc_id"), F.col("stays.row").alias("group_row"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all their columns, one of each group of `similar`."""
    rows, name = numbered(docs)
    stays = _first(_grouped(rows, name, shingle, similarity)).select(F.col("stays.row").alias(name))
    return rows.join(stays, name, "left_semi").select(*[named(c) for c in docs.columns])


def _first(every: DataFrame) -> DataFrame:
    return every.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("stays"))


def _grouped(numbered_docs: DataFrame, name: str, shingle: int, similarity: float) -> DataFrame:
    """doc_id, row and root, which rows of a group have in common."""
    rows = numbered_docs.select(F.col("doc_id").cast("long"), "text", named(name).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, "text"):
            sets, prints, keys = wide_of(texts_of(batch), shingle)
            same = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) for s in sets]
            longs = [pa.array(list(x), pa.list_(t)) for x, t in ((prints.view(np.int64), pa.int64()), (distances(prints), pa.int16()), (keys.view(np.int64), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same, pa.binary()), *longs], names=["doc_id", "row", "same", "print", "far", "keys"])

    def sets_of(nodes: DataFrame) -> Jaccard:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only()
            for batch in slices(batches, "text"):
                own = [s.astype("<u8").tobytes() for s in shingle_sets(texts_of(batch), shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])

        some = rows.select(F.col("row").alias("node"), "text").join(nodes, "node", "left_semi")
        return Jaccard(cut(some.mapInArrow(run, "node long, own binary")), similarity)

    found = cut(rows.mapInArrow(run, "doc_id long, row long, same binary, print array<long>, far array<smallint>, keys array<long>"))
    first = found.groupBy("same").agg(F.min("row").alias("node"))
    distinct = cut(found.join(first.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "same", "print", "far", "keys"))
    dealt = distinct.select("node", F.posexplode("keys").alias("t", "key"))
    root = linked(dealt.select("t", "key", "node"), bits_at(similarity), distinct.select("node", "print", "far"), WORDS, sets_of)
    rooted = distinct.select("node", "same").join(root, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return found.select("doc_id", "row", "same").join(rooted, "same").select("doc_id", "row", "root")
