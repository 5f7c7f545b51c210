"""Operator 12: ranked lexical search by hashed max-sketches.

A document's sketch has a number of coordinates by its own number of distinct terms; each
term is hashed to one, which keeps the maximum of its terms' impacts. With a document's
length fixed the impact rises with a term's occurrences, so the sketch stores their maximum
in a byte and stays right whatever the corpus' statistics become; the impact is looked up
when a search knows them. A query's weighted sum over the coordinates of its terms is an
upper bound of its score. A batch of documents is looked up for a block of queries at
once; then each query's documents are scored exactly from their postings by descending
bound, until the bound falls below the query's ``k``-th best score so far.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, terms_of, written

#: A sketch has between 2^6 and 2^18 coordinates, 32 or more for each distinct term below that; only those above zero are stored.
LEAST_BITS, MOST_BITS, ROOM = 6, 18, 32
#: The byte of a coordinate with so many occurrences or more; its impact is bounded by the limit of all.
MANY, LIMIT = 255, 1_000_000
INDEX = "doc_id long, n long, terms binary, counts binary, sketch binary"
RESULT = "query long, doc_id long, score long"


def sketch_of(terms: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The maximum of the counts, at most MANY, of the terms of each coordinate."""
    bits = min(MOST_BITS, max(LEAST_BITS, (ROOM * len(terms) - 1).bit_length()))
    out = np.zeros(1 << bits, np.uint8)
    np.maximum.at(out, np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) & (len(out) - 1), np.minimum(counts, MANY).astype(np.uint8))
    return out


def stored_sketch(sketch: np.ndarray) -> bytes:
    """A sketch's number of bits, then the coordinates above zero (32 bits each), then their bytes."""
    own = np.flatnonzero(sketch)
    return bytes([len(sketch).bit_length() - 1]) + own.astype("<i4").tobytes() + sketch[own].tobytes()


def read_sketch(stored: bytes) -> np.ndarray:
    out = np.zeros(1 << stored[0], np.uint8)
    n = (len(stored) - 1) // 5
    out[np.frombuffer(stored, "<i4", n, 1)] = np.frombuffer(stored, np.uint8, n, 1 + 4 * n)
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("n", "terms", "counts", "sketch")}
        for text in batch["text"]:
            found = Counter(terms_of(text.as_buffer().to_pybytes() if text.is_valid else None))
            counts = np.fromiter(found.values(), np.int32, len(found))
            rows["n"].append(int(counts.sum(dtype=np.int64)))
            rows["terms"].append(b" ".join(found))
            rows["counts"].append(counts.tobytes())
            rows["sketch"].append(stored_sketch(sketch_of(list(found), counts)))
        columns = [batch["doc_id"], pa.array(rows["n"], pa.int64()), *(pa.array(rows[c], pa.binary()) for c in ("terms", "counts", "sketch"))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts", "sketch"])


def index_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, terms, counts, sketch) of all documents with a term: the index that searches read.

    It doesn't depend on queries or on other documents, so new documents' rows may be
    appended. ``terms`` are joined by blanks and ``counts`` are their 32-bit occurrences.
    Documents that are null, empty or without terms have none. Other columns are left out;
    rows that repeat a doc_id are documents of their own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_index, INDEX).where("n > 0")


def impact(counts: np.ndarray, length: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) of each of the counts."""
    counts = np.asarray(counts, np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * length)


class Queries:
    """A block of queries: the postings (query, term) laid end to end, sorted by query."""

    def __init__(self, terms: list[list[bytes]]):
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
        self.ids = np.array([self.vocabulary[t] for own in terms for t in own], np.int64)
        self.ends = np.cumsum([len(own) for own in terms])
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.hashes = np.array([zlib.crc32(t) for t in self.vocabulary], np.int64)[self.ids]
        self.weights = np.zeros(len(self.ids), np.int64)

    def weigh(self, n: int, df: dict[bytes, int]) -> None:
        """A term's weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))) from its number of documents."""
        own = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in self.vocabulary]
        self.weights = np.array(own, np.int64)[self.ids]

    def bounds(self, sketch: np.ndarray, length: int) -> np.ndarray:
        """For each query an upper bound of a document's score."""
        of_byte = impact(np.arange(256), length)
        of_byte[MANY] = LIMIT
        return np.add.reduceat(self.weights * of_byte[sketch[self.hashes & (len(sketch) - 1)]], self.starts)

    def counts(self, terms: bytes, counts: bytes) -> np.ndarray:
        """A document's occurrences of each term of the block."""
        out = np.zeros(len(self.vocabulary), np.int64)
        places = [self.vocabulary.get(t, -1) for t in terms.split(b" ")]
        places = np.array(places, np.int64)
        out[places[places >= 0]] = np.frombuffer(counts, np.int32)[places >= 0]
        return out

    def score(self, query: int, counts: np.ndarray, length: int) -> int:
        own = slice(self.starts[query], self.ends[query])
        return int((self.weights[own] * impact(counts[self.ids[own]], length)).sum())


def _order(doc_id: int | None) -> tuple[bool, int]:
    """Ascending ids, null last."""
    return doc_id is None, doc_id or 0


class Best:
    """The ``k`` best documents of each query so far: the highest scores, ties to the smaller doc_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(queries)]
        self.least = np.ones(queries, np.int64)

    def add(self, query: int, score: int, doc_id: int | None) -> None:
        if score <= 0:
            return
        null, number = _order(doc_id)
        heap, own = self.heaps[query], (score, not null, -number)
        if len(heap) < self.k:
            heapq.heappush(heap, own)
        elif own > heap[0]:
            heapq.heapreplace(heap, own)
        if len(heap) == self.k:
            self.least[query] = heap[0][0]

    def rows(self) -> list[tuple]:
        return [(q, -number if known else None, score) for q, heap in enumerate(self.heaps) for score, known, number in heap]


def search_batch(queries: Queries, best: Best, batch: pa.RecordBatch, n: int, total: int) -> int:
    """Adds a batch of index rows to ``best``; gives the number of exact scores that it took."""
    ids, sizes, sketches = batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["sketch"]
    lengths = [10 + 90 * size * n // total for size in sizes]
    bounds = np.stack([queries.bounds(read_sketch(s.as_py()), m) for s, m in zip(sketches, lengths, strict=True)])
    held: dict[int, np.ndarray] = {}
    taken = 0
    for q in np.flatnonzero((bounds >= best.least).any(axis=0)).tolist():
        own = bounds[:, q]
        places = np.flatnonzero(own >= best.least[q])
        for d in places[np.argsort(-own[places], kind="stable")].tolist():
            if own[d] < best.least[q]:
                break
            if d not in held:
                held[d] = queries.counts(batch["terms"][d].as_py(), batch["counts"][d].as_py())
            best.add(q, queries.score(q, held[d], lengths[d]), ids[d])
            taken += 1
    return taken


def _search(queries: Queries, k: int, n: int, total: int, rows: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.ends), k)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                search_batch(queries, best, batch.slice(at, rows), n, total)
        found = list(zip(*best.rows(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query", "doc_id", "score"])

    return search


def _holders(vocabulary: set[bytes]):
    """The number of documents that hold each term of a vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for terms in batch["terms"]:
                found.update(vocabulary.intersection(terms.as_buffer().to_pybytes().split(b" ")))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    return count


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [sorted(set(terms_of(t.as_buffer().to_pybytes() if t.is_valid else None))) for t in batch["text"]]
        columns = [batch["item_id"], pa.array([b" ".join(x) for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "terms", "n_terms"])


def search(index: DataFrame, items: DataFrame, *, k: int = 10, block_terms: int = 1 << 18) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents that score highest for each item's text, scores above 0.

    ``index`` is what ``index_documents`` gives, ``items`` needs item_id and text. Equal
    scores go by ascending doc_id, null last; rows that repeat a doc_id each have a place.
    An item counts each of its terms once; items without terms have no row, equal items
    (id and text) count once, and two texts of an item_id are ranked apart. With no
    documents there are no rows. Items are dealt into blocks by hash so that a block has
    about ``block_terms`` terms: a block's terms, and the numbers of documents that hold
    them, are the only data that go to the driver and to every task, and the index is read
    once for each block. A task holds a batch of documents and ``k`` results an item.
    """
    spark = index.sparkSession
    small_batches(spark)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.mapInArrow(_query_terms, "item_id long, terms binary, n_terms long").where("n_terms > 0").distinct()
    rows = written(rows, "query-terms")
    size = rows.agg(F.sum("n_terms")).first()[0] or 0
    blocks = max(1, -(-size // block_terms))
    n, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = None
    for b in range(blocks if n else 0):
        own = sorted(map(tuple, rows.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).select("item_id", "terms").collect()), key=lambda r: (_order(r[0]), bytes(r[1])))
        if not own:
            continue
        queries = Queries([bytes(terms).split(b" ") for _, terms in own])
        df = index.select("terms").mapInArrow(_holders(set(queries.vocabulary)), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        queries.weigh(n, {bytes(r["term"]): r["df"] for r in df.collect()})
        part = index.mapInArrow(_search(queries, k, n, total, max(1, min(256, (1 << 21) // len(own)))), RESULT)
        named = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(own)], "query long, item_id long")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        part = part.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")
        part = written(part, "search-block") if blocks > 1 else part
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
