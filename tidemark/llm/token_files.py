"""Operator 2: token ids of a corpus in patched frame-of-reference files.

A segment holds the ids of consecutive documents in blocks of 128. A block subtracts
its smallest id, packs the differences at a width that a percentile of them needs, and
keeps the larger ones in a list of exceptions. The block starts are an index at the
segment's head, so that any block is read alone. Segments are binary values of Parquet
files: Spark's writer commits them as a whole, to any store that Spark can write.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, written
from tidemark.llm.encoding import byte_encoder

#: Fixed values of the format.
MAGIC = b"TMF1"
BLOCK = 128

#: A block's entry in the index.
ENTRY = np.dtype([("start", "<u4"), ("base", "<u4"), ("width", "u1"), ("exceptions", "u1")])
SEGMENT = "shard int, segment int, first long, n_ids long, doc_ids binary, doc_lengths binary, payload binary"


def _groups(width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for w in np.unique(width):
        if w:
            yield int(w), np.flatnonzero(width == w)


def _packed(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values as rows of bytes, ``w`` bits a value, lowest first: eight values fill ``w`` bytes."""
    eights = np.ascontiguousarray(values.reshape(-1, 8).T).astype(np.uint64)
    out = np.zeros((w, eights.shape[1]), np.uint8)
    for j, value in enumerate(eights):
        at, shift = divmod(j * w, 8)
        value <<= shift
        for k in range(at, -(-(shift + w) // 8) + at):
            out[k] |= value.astype(np.uint8)
            value >>= 8
    return out.T.reshape(len(values), values.shape[1] * w // 8)


def _unpacked(rows: np.ndarray, w: int) -> np.ndarray:
    """The values of rows of bytes that ``_packed`` made."""
    columns = np.ascontiguousarray(rows.reshape(-1, w).T).astype(np.uint64)
    out = np.empty((8, columns.shape[1]), np.uint32)
    for j in range(8):
        at, shift = divmod(j * w, 8)
        value = columns[at] >> shift
        for k in range(1, -(-(shift + w) // 8)):
            value |= columns[at + k] << (8 * k - shift)
        out[j] = value & ((1 << w) - 1)
    return out.T.reshape(len(rows), rows.shape[1] * 8 // w)


def encode_ids(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Unsigned 32-bit ids as one payload: magic, count, index, packed blocks with their exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = full[n - 1]
    full = full.reshape(blocks, BLOCK)
    index = np.zeros(blocks, ENTRY)
    index["base"] = full.min(axis=1, initial=2**32 - 1) if blocks else 0
    off = full - index["base"][:, None]
    kth = np.sort(off, axis=1)[:, int(np.ceil(percentile * BLOCK)) - 1]
    width = np.frexp(kth.astype(np.float64))[1].astype(np.uint8)
    index["width"] = width
    limit = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    late = off > limit[:, None]
    rows, places = np.nonzero(late)
    counts = late.sum(axis=1)
    index["exceptions"] = counts
    size = width.astype(np.int64) * (BLOCK // 8) + counts * 5
    starts = np.concatenate([[0], np.cumsum(size)])
    index["start"] = starts[:-1]
    body = np.zeros(int(starts[-1]), np.uint8)
    low = off & limit[:, None].astype(np.uint32)
    for w, own in _groups(width):
        body[starts[own][:, None] + np.arange(w * (BLOCK // 8))] = _packed(low[own], w)
    if len(rows):
        turn = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[rows] + width[rows].astype(np.int64) * (BLOCK // 8) + turn * 5
        body[at] = places
        body[at[:, None] + 1 + np.arange(4)] = off[rows, places].astype("<u4").view(np.uint8).reshape(-1, 4)
    return MAGIC + np.uint32(n).tobytes() + index.tobytes() + body.tobytes()


def decode_ids(payload: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """The ids of a payload, or of some of its blocks, which the index finds."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    n = int(np.frombuffer(payload, "<u4", 1, 4)[0])
    blocks = -(-n // BLOCK)
    index = np.frombuffer(payload, ENTRY, blocks, 8)
    body = np.frombuffer(payload, np.uint8, offset=8 + blocks * ENTRY.itemsize)
    last = blocks if n_blocks is None else min(blocks, first_block + n_blocks)
    index = index[first_block:last]
    starts, width = index["start"].astype(np.int64), index["width"]
    out = np.zeros((len(index), BLOCK), np.uint32)
    for w, own in _groups(width):
        out[own] = _unpacked(body[starts[own][:, None] + np.arange(w * (BLOCK // 8))], w)
    counts = index["exceptions"].astype(np.int64)
    if counts.any():
        rows = np.repeat(np.arange(len(index)), counts)
        turn = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[rows] + width[rows].astype(np.int64) * (BLOCK // 8) + turn * 5
        values = np.ascontiguousarray(body[at[:, None] + 1 + np.arange(4)]).view("<u4")[:, 0]
        out[rows, body[at]] = values
    out += index["base"][:, None]
    return out.reshape(-1)[: n - first_block * BLOCK]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2, segment_ids: int = 65536, percentile: float = 0.9, partitions: int | None = None) -> None:
    """Writes the token ids of all texts, each followed by ``end_id``, in ascending doc_id order.

    ``docs`` needs doc_id and text; other columns are left out. Null texts count as
    empty; null doc_ids come first; rows of one doc_id are in the order of their texts'
    hash. Shards are ranges of (doc_id, hash), so that a doc_id with very many rows is
    split too. A segment has whole documents, ``segment_ids`` ids at least but for the last.
    """
    spark = docs.sparkSession
    small_batches(spark, 2048)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__h", F.xxhash64("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = byte_encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple] = []
        n_held = first = segment = 0

        def out() -> pa.RecordBatch:
            raw = b"".join(x for _, x in held)
            ids = np.frombuffer(raw, "<u4")
            lengths = np.array([len(x) // 4 for _, x in held], "<u4").tobytes()
            # the lowest 64-bit integer stands for a null doc_id
            doc_ids = np.array([-(2**63) if d is None else d for d, _ in held], "<i8").tobytes()
            row = {"shard": [shard], "segment": [segment], "first": [first], "n_ids": [len(ids)], "doc_ids": [doc_ids], "doc_lengths": [lengths], "payload": [encode_ids(ids, percentile)]}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.stream(batch.column(1)), strict=True):
                held.append((doc_id, ids + end))
                n_held += len(ids) // 4 + 1
                if n_held >= segment_ids:
                    yield out()
                    first, segment, n_held = first + n_held, segment + 1, 0
                    held.clear()
        if held:
            yield out()

    ordered = rows.repartitionByRange(n, "doc_id", "__h").sortWithinPartitions("doc_id", "__h").select("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of token files: doc_id, start (ids before it), n_tokens, ids (binary).

    The numbers of ids by shard are summed from two columns of the files; their running
    sum has one row for each shard and is written, so that Spark knows its size and
    needn't shuffle the segments while it is small.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = written(before, "shard-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_ids(row["payload"]).astype("<u4").tobytes()
                lengths = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                own = [None if d == -(2**63) else d for d in np.frombuffer(row["doc_ids"], "<i8").tolist()]
                texts = [ids[a * 4 : b * 4] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(starts + row["first"] + row["before"]), pa.array(lengths), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return segments.join(before, "shard").select("first", "before", "doc_ids", "doc_lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
