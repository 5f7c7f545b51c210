"""Operator 6: packs documents into training windows by the sum-of-squares rule.

The end of each document (what is left after cutting off whole windows) goes to the
open window whose fill level makes the sum of the squared counts of partially filled
windows smallest; the counts by level are an array. Each partition packs its own rows
in one pass: nothing is shuffled and a task that is run again gives the same windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.llm.encoding import byte_encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Fills windows of ``size`` tokens with pieces (doc_id, start, doc_tokens, ids as bytes).

    ``counts[h]`` is the number of open windows filled to h. What is open at the end is
    closed together, its pieces cut to fit; so is what is open above ``most_open`` windows,
    should that be given. Without it open windows hold at most the ids of one partition,
    which Spark's size of an input split bounds.
    """

    def __init__(self, size: int, first_sequence: int, most_open: int | None = None):
        self.size, self.next_sequence, self.most_open = size, first_sequence, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.n_open = 0

    def place(self, length: int) -> int:
        """The level to put ``length`` tokens on: 0 opens a window. Ties go to the fullest window."""
        n, size = self.counts, self.size
        levels = np.arange(1, size - length + 1)
        levels = levels[n[1 : size - length + 1] > 0]
        # moving a window from h to h + length changes the sum of squares by 2 - 2 n[h] + 2 n[h + length], less if it gets full
        change = np.where(levels + length < size, 2 - 2 * n[levels] + 2 * n[np.minimum(levels + length, size)], 1 - 2 * n[levels])
        if len(levels) and change.min() <= 2 * n[length] + 1:
            return int(levels[len(change) - 1 - int(np.argmin(change[::-1]))])
        return 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        at = 0
        while total - at >= self.size:
            yield from self._close([(doc_id, at, total, ids[at * 4 : (at + self.size) * 4])])
            at += self.size
        if at == total:
            return
        rest = total - at
        level = self.place(rest)
        window = self.open[level].pop() if level else []
        window.append((doc_id, at, total, ids[at * 4 :]))
        if level:
            self.counts[level] -= 1
            self.n_open -= 1
        if level + rest == self.size:
            yield from self._close(window)
            return
        self.open[level + rest].append(window)
        self.counts[level + rest] += 1
        self.n_open += 1
        if self.most_open is not None and self.n_open > self.most_open:
            yield from self.finish()

    def _close(self, window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, total, ids in window:
            yield doc_id, start, len(ids) // 4, total, self.next_sequence, offset, ids
            offset += len(ids) // 4
        self.next_sequence += 1

    def finish(self) -> Iterator[tuple]:
        """Closes all open windows without padding.

        Their pieces, fullest windows first, are laid end to end and cut at the window
        size; what remains is cut into lengths that are powers of two, which need none.
        """
        line = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        left = sum(len(p[3]) // 4 for p in line)
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        window, room = [], 0
        for doc_id, start, total, ids in line:
            while ids:
                if not room:
                    room = min(self.size, 1 << (left.bit_length() - 1))
                    left -= room
                part = ids[: room * 4]
                window.append((doc_id, start, total, part))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                if not room:
                    yield from self._close(window)
                    window = []


def pack_documents(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, end_id: int = 0, memo: int = 400_000, characters: int = 8_000_000) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``docs`` needs doc_id and text; other columns are left out whatever their names. A
    document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone.
    Null and repeated doc_ids are packed row by row. ``size`` must be a power of two.
    ``ids`` holds little-endian unsigned 32-bit integers. A sequence is filled to
    ``size`` or to a power of two below it, so nothing is padded. sequence_id is the
    partition's number times 2^33 plus a count. An empty table gives no row. The encoder's
    ``memo`` of words and the ``characters`` encoded at once bound a worker's memory alone.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    small_batches(docs.sparkSession, 2048)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer_path, memo)
        packer = SumOfSquares(size, TaskContext.get().partitionId() << 33)
        types = [pa.int64()] * 6 + [pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.stream(batch.column(1), characters), strict=True):
                rows.extend(packer.add(doc_id, ids + end))
                if len(rows) >= 2048:
                    yield out()
        rows.extend(packer.finish())
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
