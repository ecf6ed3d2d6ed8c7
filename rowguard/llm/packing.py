"""Best-fit packing by a grouping genetic algorithm.

Texts become pieces of at most `capacity` tokens, and pieces are packed into
sequences. What fills a sequence alone is one. The others are dealt out at
random into blocks of about BLOCK pieces, so that each block has the mixture
of lengths of all. On each block work ISLANDS populations of packings, in
different tasks:

* An individual is a set of bins. The first are best-fit packings of the
  pieces by falling length, in all but one with some noise.
* Crossover injects the well-filled bins of one parent whole into the other,
  removes the bins that share a piece with them, and places the displaced
  pieces: first in the stead of one or two smaller ones wherever that fills a
  bin better (two only in bins of up to PAIRED pieces), then, longest first,
  where they fit best. Mutation displaces the emptiest bins the same way.
* Fewer bins are fitter, then those that are fuller squared. After each round
  the elite of an island migrates to the next one of its block, in a shuffle.

Bins of the best packing of each block that stay below KEEP of the capacity,
and one in MIXED of the others for their small pieces, are opened again and
their pieces dealt out anew among each other, and so on for LEVELS levels. So
what one block leaves over meets what others do, and no task sees more than
its block, however many documents there are.

Null and empty texts have the end token only. Repeated rows are packed each.
No rows give no pieces. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_only, slices, spans, texts_of
from .pfor import unsigned_crc32
from .tokens import encoder

BLOCK, ISLANDS, ROUNDS = 1500, 3, 2
TASK = 8  # islands for a task, of some tenths of a second each
POPULATION, CHILDREN = 4, 16
PAIRED = 12
KEEP = 0.9995
LEVELS, MIXED = 3, 16


def pieces(docs: DataFrame, capacity: int = 2048, end: int = 0, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece. Nothing is shuffled."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("encoder")
        for batch in slices(batches, "text", 1 << 19):
            ids, sizes = encoder(vocabulary).encode(texts_of(batch), end)
            raw, ends = ids.astype("<u4").tobytes(), spans(sizes)
            n = -(-sizes // capacity)
            of = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[of] - start, capacity)
            parts = [raw[4 * a : 4 * (a + b)] for a, b in zip(ends[of] + start, length)]
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([unsigned_crc32(p) for p in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * keep_ids, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Packing:
    """Bins of pieces (numbers into `lengths`) with what is free in each."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self, items: list[int]) -> None:
        """Put each item into the fullest bin that takes it, or a new one."""
        lengths, bins, free = self.lengths, self.bins, self.free
        with_free: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(free):
            with_free.setdefault(f, []).append(b)
            mask |= 1 << f
        for item in items:
            size = lengths[item]
            fits = mask >> size
            if fits:
                f = size + (fits & -fits).bit_length() - 1
                at = with_free[f]
                b = at.pop()
                if not at:
                    mask &= ~(1 << f)
                bins[b].append(item)
                left = free[b] = f - size
            else:
                b, left = len(bins), self.capacity - size
                bins.append([item])
                free.append(left)
            with_free.setdefault(left, []).append(b)
            mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        return -len(self.bins), sum((1 - f / self.capacity) ** 2 for f in self.free)

    def without(self, drop: set[int]) -> Packing:
        """A copy without the bins of these numbers."""
        out = Packing(self.lengths, self.capacity)
        out.bins = [own[:] for b, own in enumerate(self.bins) if b not in drop]
        out.free = [f for b, f in enumerate(self.free) if b not in drop]
        return out

    def numbers(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), "<i4")
        for b, own in enumerate(self.bins):
            out[own] = b
        return out

    @staticmethod
    def of(lengths: list[int], capacity: int, numbers: np.ndarray) -> Packing:
        out = Packing(lengths, capacity)
        n = int(numbers.max(initial=-1)) + 1
        out.bins, out.free = [[] for _ in range(n)], [capacity] * n
        for item, b in enumerate(numbers.tolist()):
            out.bins[b].append(item)
            out.free[b] -= lengths[item]
        return out


def exchanged(packing: Packing, items: list[int]) -> list[int]:
    """Displaced pieces for smaller ones inside the bins, where that fills them better; what is displaced then, longest first."""
    lengths = packing.lengths
    pool = sorted(items, key=lengths.__getitem__)
    sizes = [lengths[i] for i in pool]

    def trade(b: int, out: tuple[int, ...], at: int) -> None:
        new, gain = pool.pop(at), sizes.pop(at) - sum(lengths[packing.bins[b][k]] for k in out)
        for k in sorted(out, reverse=True):
            old = packing.bins[b].pop(k)
            place = bisect_right(sizes, lengths[old])
            pool.insert(place, old)
            sizes.insert(place, lengths[old])
        packing.bins[b].append(new)
        packing.free[b] -= gain

    for b, own in enumerate(packing.bins):
        free = packing.free[b]
        if not free or not pool:
            continue
        best, trial = 0, None
        for out in chain(((k,) for k in range(len(own))), combinations(range(len(own)), 2) if len(own) <= PAIRED else ()):
            size = sum(lengths[own[k]] for k in out)
            at = bisect_right(sizes, free + size) - 1
            if at >= 0 and sizes[at] - size > best:
                best, trial = sizes[at] - size, (out, at)
            if best == free:
                break
        if trial:
            trade(b, *trial)
    return pool[::-1]


def displaced_into(packing: Packing, drop: set[int], kept: set[int] = frozenset()) -> Packing:
    items = [i for b in drop for i in packing.bins[b] if i not in kept]
    out = packing.without(drop)
    out.best_fit(exchanged(out, items))
    return out


def crossover(into: Packing, other: Packing, draw: random.Random) -> Packing:
    """`into` with a share of the well-filled bins of `other` injected whole."""
    full = sorted(range(len(other.bins)), key=other.free.__getitem__)[: max(1, len(other.bins) // 2)]
    injected = [b for b in full if draw.random() < 0.5] or full[:1]
    inside = {i for b in injected for i in other.bins[b]}
    hit = {b for b, own in enumerate(into.bins) if not inside.isdisjoint(own)}
    items = [i for b in hit for i in into.bins[b] if i not in inside]
    out = into.without(hit)
    out.bins += [other.bins[b][:] for b in injected]
    out.free += [other.free[b] for b in injected]
    out.best_fit(exchanged(out, items))
    return out


def mutate(packing: Packing, draw: random.Random) -> Packing:
    """The emptiest bins and a few others opened, and their pieces placed anew."""
    n = len(packing.bins)
    drop = set(sorted(range(n), key=packing.free.__getitem__, reverse=True)[: max(2, n // 20)])
    drop.update(draw.randrange(n) for _ in range(max(2, n // 20)))
    return displaced_into(packing, drop)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[np.ndarray]) -> Packing:
    """One round of an island, from the elites that it is given."""
    draw = random.Random(seed)
    people = [Packing.of(lengths, capacity, e) for e in elites]
    while len(people) < POPULATION:
        noise = 0.0 if not people and seed % ISLANDS == 0 else 0.15
        order = sorted(range(len(lengths)), key=lambda i: lengths[i] * (1 + noise * draw.random()), reverse=True)
        one = Packing(lengths, capacity)
        one.best_fit(order)
        people.append(one)
    bound = -(-sum(lengths) // capacity)
    for child in range(CHILDREN):
        people.sort(key=Packing.fitness, reverse=True)
        if len(people[0].bins) == bound:
            break
        a, b = draw.sample(people, 2)
        a, b = (a, b) if a.fitness() >= b.fitness() else (b, a)
        people[-1] = mutate(crossover(a, b, draw), draw) if child % 2 else crossover(a, b, draw)
    return max(people, key=Packing.fitness)


def _evolve_rows(capacity: int, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                island, given = row["island"], row["elites"] or []
                elites = [np.frombuffer(given[(island - k) % ISLANDS], "<i4") for k in (0, 1)] if given else []
                best = evolve(row["lengths"], capacity, (row["block"] * 31 + round_) * ISLANDS + island, elites)
                out.append((row["block"], island, best.numbers().tobytes(), *best.fitness()))
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate([("block", pa.int64()), ("island", pa.int32()), ("elite", pa.binary()), ("bins", pa.int64()), ("filled", pa.float64())])})

    return run


def _places(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Bin, offset in it and fill of it for each piece of a block."""
    kind = pa.list_(pa.struct([("bin", pa.int32()), ("offset", pa.int64()), ("fill", pa.int64())]))
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            packing = Packing.of(row["lengths"], capacity, np.frombuffer(row["elite"], "<i4"))
            places = [None] * len(row["lengths"])
            for b, own in enumerate(packing.bins):
                offset = 0
                for i in own:
                    places[i] = {"bin": b, "offset": offset, "fill": capacity - packing.free[b]}
                    offset += row["lengths"][i]
            out.append(places)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["block", "places"])


def _pack_blocks(rows: DataFrame, capacity: int) -> DataFrame:
    """`rows` with block, bin, offset and fill."""
    n_blocks = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block")
    dealt = rows.select(block, F.struct(*rows.columns).alias("item"))
    blocks = cut(dealt.groupBy("block").agg(F.collect_list("item").alias("items")))  # about BLOCK, by a random number
    lengths = blocks.select("block", F.transform("items", lambda i: i["length"]).alias("lengths"))
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    tasks = -(-n_blocks * ISLANDS // TASK)  # by work: in bytes an island is next to nothing
    elites = lengths.withColumn("elites", F.lit(None).cast("array<binary>"))
    for round_ in range(ROUNDS):
        spread = elites.select("block", islands, "lengths", "elites").repartition(tasks, "block", "island")
        evolved = spread.mapInArrow(_evolve_rows(capacity, round_), "block long, island int, elite binary, bins long, filled double")
        by_block = evolved.groupBy("block").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("island", "elite"))), lambda e: e["elite"]).alias("elites"),
            F.max_by("elite", F.struct("bins", "filled", "island")).alias("elite"),
        )
        elites = lengths.join(by_block, "block")
    placed = elites.select("block", "lengths", "elite").mapInArrow(
        lambda b: _places(b, capacity), "block long, places array<struct<bin:int,offset:long,fill:long>>"
    )
    both = blocks.join(placed, "block").select("block", F.explode(F.arrays_zip("items", "places")).alias("z"))
    return cut(both.select("z.items.*", "block", "z.places.*"))


def pack(cut_up: DataFrame, capacity: int = 2048) -> DataFrame:
    """The rows of `pieces`, with all their columns, and sequence_id and offset."""
    columns = cut_up.columns
    rows = cut(cut_up)
    full = F.col("length") >= capacity
    own = -1 - F.monotonically_increasing_id()
    out = rows.filter(full).select(*columns, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = rows.filter(~full)
    for level in range(LEVELS):
        packed = _pack_blocks(left, capacity)
        settled = F.lit(level == LEVELS - 1) | (F.col("fill") >= KEEP * capacity) & (F.col("bin") % MIXED != 0)
        number = F.lit(level << 60) + F.shiftleft("block", 24) + F.col("bin")
        out = out.unionByName(packed.filter(settled).select(*columns, number.cast("long").alias("sequence_id"), "offset"))
        left = packed.filter(~settled).select(*columns)
    return out
