"""How filters of documents interact: what each removes in every order, what others would have removed anyway.

Five filters fail a text (null: empty). Words are what lies between ASCII white space.

    A  under 50 words
    B  under 65 distinct words for each 100
    C  capital letters A-Z more than 5 of 100 characters
    D  any of # $ % & * |
    E  identical to the text of any smaller doc_id

E is exact: texts are routed by xxHash64, and a partition keeps a chain for
each hash, of whole texts with their least id; all others are emitted as
failing. Each task first does so with what it reads itself, a bounded part at
a time, so that of a text that fills a third of all rows one copy for each
part is shuffled. Partitions come sorted by hash and id: a chain is only as
long as the number of different texts with one hash, and only one is held.

Each document then is a mask of five bits. combineByKey sums vectors of counts by
mask (all, good, toxic) for each part of the corpus; the 120 orders follow from
the 32 numbers. Lost executors only cost the tasks that read from them.

Rows with a null doc_id never fail E, nor does another text because of theirs, and
they have no labels. Of repeated doc_ids those of the least id all pass E. A
document is good (toxic) if any of its labels says so. Null and empty sources are
the part "". No rows give no parts. Only doc_id, source, text, quality and toxic
are read. One text has to fit into a Python worker, with its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, permutations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
HELD = 16 << 20  # bytes of text that a task compares before it passes them on
SORTED = 32 << 20  # bytes of text that a task sorts, if none is a copy
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
_E = 1 << FILTERS.index("E")

Routed = tuple[tuple[int, int], tuple]


def failing(text: str, own: bytes) -> int:
    """The bits of the filters A to D that a text, whose UTF-8 is `own`, fails."""
    words = own.split()  # of bytes: at ASCII white space only
    fails = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * (len(own) - len(own.translate(None, _CAPITALS))) > 5 * len(text),
        len(own.translate(None, _SIGNS)) < len(own),
    )
    return sum(1 << i for i, fail in enumerate(fails) if fail)


def _settled(doc_id: int | None, part: str, mask: int, n: int = 1) -> Routed:
    """A document, that many times, that needs no comparing any more, dealt out by its id."""
    return (xxhash.xxh64_intdigest(repr((doc_id, part))), 0), (None, doc_id, part, mask, n)


def route(rows: Iterable, most: int = HELD) -> Iterator[Routed]:
    """((hash, least id), (text, least id, part, mask, rows)) of each text in a held part of the rows; the others are settled."""
    chains: dict[int, list[list]] = {}
    held = 0
    for doc_id, part, text in rows:
        own = text.encode("utf-8", "surrogatepass")
        mask = failing(text, own)
        if doc_id is None:
            yield _settled(None, part, mask)
            continue
        chain = chains.setdefault(xxhash.xxh64_intdigest(own), [])
        entry = next((e for e in chain if e[0] == own), None)
        if entry is None:
            chain.append([own, doc_id, {part: 1}, mask])
            held += len(own) + 200
        elif doc_id > entry[1]:
            yield _settled(doc_id, part, mask | _E)
        elif doc_id == entry[1]:
            entry[2][part] = entry[2].get(part, 0) + 1
        else:
            for other, n in entry[2].items():
                yield _settled(entry[1], other, mask | _E, n)
            entry[1:3] = doc_id, {part: 1}
        if held > most:
            yield from _passed_on(chains)
            chains, held = {}, 0
    yield from _passed_on(chains)


def _passed_on(chains: dict[int, list[list]]) -> Iterator[Routed]:
    for key, chain in chains.items():
        for own, doc_id, parts, mask in chain:
            for part, n in parts.items():
                yield (key, doc_id), (own, doc_id, part, mask, n)


def compare(routed: Iterable[Routed]) -> Iterator[tuple]:
    """(doc_id, part, mask, rows) of a partition sorted by hash and id."""
    for _, run in groupby(routed, lambda r: r[0][0]):
        chain: list[tuple[bytes, int]] = []  # different texts with this hash, with their least ids
        for _, (own, doc_id, part, mask, n) in run:
            if own is not None:
                least = next((i for text, i in chain if text == own), None)
                if least is None:
                    chain.append((own, doc_id))
                elif doc_id > least:
                    mask |= _E
            yield doc_id, part, mask, n


def masks(docs: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, part, mask and n, how many rows they stand for, of all documents."""
    text, part = F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), part, text).rdd
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(-(-size // SORTED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapPartitions(lambda own: route(own, held)).repartitionAndSortWithinPartitions(n, lambda key: key[0])
    return docs.sparkSession.createDataFrame(dealt.mapPartitions(compare), "doc_id long, part string, mask int, n long", verifySchema=False)


_SIZE = 1 << len(FILTERS)


def _vector(row) -> list[int]:
    return _added([0] * (3 * _SIZE), row)


def _added(sums: list[int], row) -> list[int]:
    mask, n, good, toxic = row
    sums[mask] += n
    sums[_SIZE + mask] += good * n
    sums[2 * _SIZE + mask] += toxic * n
    return sums


def _merged(one: list[int], other: list[int]) -> list[int]:
    return [a + b for a, b in zip(one, other)]


def report(part: str, sums: list[int]) -> Iterator[tuple]:
    """The rows of a part, a row for each order and step."""
    counts, good, toxic = (sums[i * _SIZE : (i + 1) * _SIZE] for i in range(3))
    orders = 120
    shapley = {f: sum(n * orders // mask.bit_count() for mask, n in enumerate(counts) if mask >> i & 1) for i, f in enumerate(FILTERS)}
    for order in permutations(FILTERS):
        earlier = 0
        for step, f in enumerate(order, 1):
            own = 1 << FILTERS.index(f)
            here = [m for m in range(_SIZE) if m & own and not m & earlier]
            yield (
                part, "".join(order), step,
                sum(n for m, n in enumerate(counts) if not m & (earlier | own)),
                sum(counts[m] for m in here),
                sum(n for m, n in enumerate(counts) if m & own and m & earlier),
                counts[own],
                sum(good[m] for m in here),
                sum(toxic[m] for m in here),
                shapley[f],
            )
            earlier |= own


def interactions(docs: DataFrame, labels: DataFrame, held: int = HELD) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    found = masks(docs, held).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))  # an id that fills many rows is one here
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.groupBy("doc_id").agg(says("quality"), says("toxic"))
    rows = found.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    sums = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _added, _merged)
    return docs.sparkSession.createDataFrame(sums.flatMap(lambda own: report(*own)), SCHEMA, verifySchema=False)
