"""Token ids as files of patched frame-of-reference blocks.

A block holds 128 values. Their minimum is subtracted, and the rest packed at
the width that the given percentile of them needs; what does not fit keeps its
low bits in place and its high bits in a list of exceptions. Blocks vary in
size, so each chunk starts with an index of where its blocks start.

    chunk: "PFR1", values, blocks, start of each block and the end (in words
           of 32 bits, from the first block), then the blocks
    block: minimum; width + 256 * exceptions; 4 * width packed words;
           a word for each exception: position + 128 * high bits

All are little-endian unsigned 32-bit words. In a block, value 4i + k is the
i-th in lane k; the lanes are packed side by side.

A file is a Parquet part of chunks in the order of doc_id (rows of one doc_id
by text): Spark's writer and committer see to lost tasks. A chunk holds whole
documents, their ids (a byte for each tells of a null one), lengths and where the
chunk starts in its part.

Null texts are empty ones and have the end id only. Null doc_ids come first and
come back as null. Repeated rows are all kept. A very long text is a chunk by itself. An empty table gives no chunks. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep_only, slices, spans, texts_of
from .tokens import encoder

MAGIC = np.frombuffer(b"PFR1", "<u4")[0]
BLOCK, LANES = 128, 4
CHUNK_BYTES = 1 << 20
ROUNDS = BLOCK // LANES
CHUNKS = "part int, chunk int, first long, n_docs int, n_tokens long, doc_ids binary, no_ids binary, lengths binary, ids binary"


def bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, percentile: float = 90.0) -> bytes:
    """The chunk of these unsigned 32-bit values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = values
    if n:
        full[n:] = values[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1, initial=2**32 - 1) if n else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    bits = bit_length(rest)
    rank = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    width = np.partition(bits, rank, axis=1)[:, rank] if n else np.zeros(0, np.int64)
    width = np.maximum(width, bits.max(axis=1, initial=0) - 25)  # the high bits share a word with the position
    patched = bits > width[:, None]
    n_patched = patched.sum(axis=1)
    at = spans(2 + LANES * width + n_patched)
    out = np.zeros(3 + blocks + 1 + at[-1], "<u4")
    out[:3] = MAGIC, n, blocks
    out[3 : 4 + blocks] = at
    body = out[4 + blocks :]
    body[at[:-1]] = low
    body[at[:-1] + 1] = width + 256 * n_patched
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        kept = (rest[rows] & np.uint32((1 << int(w)) - 1)).reshape(-1, ROUNDS, LANES)
        words = np.zeros((len(rows), int(w), LANES), np.uint32)
        for i in range(ROUNDS):
            word, shift = divmod(i * int(w), 32)
            words[:, word] |= kept[:, i] << np.uint32(shift)
            if shift + w > 32:
                words[:, word + 1] |= kept[:, i] >> np.uint32(32 - shift)
        body[(at[rows] + 2)[:, None] + np.arange(LANES * w)] = words.reshape(len(rows), -1)
    block, position = np.nonzero(patched)
    first = np.cumsum(n_patched) - n_patched
    place = at[block] + 2 + LANES * width[block] + (np.arange(len(block)) - first[block])
    body[place] = position + 128 * (rest[block, position].astype(np.int64) >> width[block])
    return out.tobytes()


def unpack(chunk: bytes, from_block: int = 0, to_block: int | None = None) -> np.ndarray:
    """The values of a chunk, or of some of its blocks only, found by the index."""
    words = np.frombuffer(chunk, "<u4")
    if words[0] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n, blocks = int(words[1]), int(words[2])
    to_block = blocks if to_block is None else to_block
    at = words[3 + from_block : 4 + to_block].astype(np.int64)
    body = words[4 + blocks :]
    heads = at[:-1]
    width = (body[heads + 1] & 255).astype(np.int64)
    n_patched = (body[heads + 1] >> 8).astype(np.int64)
    out = np.zeros((len(heads), ROUNDS, LANES), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = body[(heads[rows] + 2)[:, None] + np.arange(LANES * w)].reshape(len(rows), int(w), LANES)
        mask, kept = np.uint32((1 << int(w)) - 1), np.empty((len(rows), ROUNDS, LANES), np.uint32)
        for i in range(ROUNDS):
            word, shift = divmod(i * int(w), 32)
            kept[:, i] = packed[:, word] >> np.uint32(shift)
            if shift + w > 32:
                kept[:, i] |= packed[:, word + 1] << np.uint32(32 - shift)
        out[rows] = kept & mask
    out = out.reshape(-1, BLOCK)
    block = np.repeat(np.arange(len(heads)), n_patched)
    first = np.cumsum(n_patched) - n_patched
    own = body[(heads + 2 + LANES * width)[block] + np.arange(len(block)) - first[block]]
    out[block, own & 127] |= (own >> 7) << width[block].astype(np.uint32)
    out += body[heads][:, None]
    return out.ravel()[: max(0, n - from_block * BLOCK)]


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 2, percentile: float = 90.0) -> None:
    """Encode all texts and write the chunks under `path`. The texts are shuffled once, by ranges of doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("encoder")
        part, first = TaskContext.get().partitionId(), 0
        for chunk, batch in enumerate(slices(batches, "text", CHUNK_BYTES)):
            ids, lengths = encoder(vocabulary).encode(texts_of(batch), end)
            own = batch.column(0)
            numbers = pa.compute.fill_null(own, 0).to_numpy(zero_copy_only=False).astype("<i8")
            row = [part, chunk, first, len(lengths), len(ids), numbers.tobytes(), own.is_null().to_numpy(zero_copy_only=False).tobytes(), pack(lengths.astype(np.uint32)), pack(ids, percentile)]
            yield pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(CHUNKS.split(", "), row)}, _arrow)
            first += len(ids)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    _arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CHUNKS.split(", ")])
    own = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    own.mapInArrow(encode, CHUNKS).write.mode("error").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, lengths = unpack(row["ids"]), unpack(row["lengths"])
                ends = spans(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lengths), row["part"]), pa.int32()),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["no_ids"], bool)),
                        pa.array(row["first"] + ends[:-1], pa.int64()),
                        pa.array(lengths.astype(np.int64), pa.int64()),
                        pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    chunks = spark.read.schema(CHUNKS).parquet(path)
    # A row for each part, of which there are as many as there were shuffle partitions.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = chunks.mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids binary")
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def unsigned_crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
