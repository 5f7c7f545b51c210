"""Operator 9: exact top-k by inner product, term at a time.

Vectors are sparse rows of integers. Queries and candidates are dealt into blocks; each
pair of blocks is a task. A task builds postings (term: places and weights) of its
candidates, scatters each query's weighted postings into an array of scores, selects the
best of it by partition and returns them; the blocks' best are merged by a window. Sums
that might not fit 64 bits are made of Python's integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written

RESULT = "query_id long, query_key binary, query_rows long, vec_id long, score long, beyond binary"
#: The ends of 64-bit scores, and a bound below which sums of 64-bit products are safe.
LOWEST, HIGHEST, SAFE = -(2**63), 2**63 - 1, 2.0**61


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) and n, the number of equal rows; null ids and vectors with a null or non-finite component left out."""
    own = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id"), own.alias("embedding")).agg(F.count("*").alias("n"))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) as an integer of any size."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def ordered_bytes(v: int) -> bytes:
    """Bytes that sort as integers do: the size, then the digits; both inverted below zero."""
    size = (abs(v).bit_length() + 7) // 8
    if v < 0:
        return b"\0" + (2**32 - 1 - size).to_bytes(4, "big") + (256**size - 1 + v).to_bytes(size, "big")
    return b"\1" + size.to_bytes(4, "big") + v.to_bytes(size, "big")


class Postings:
    """For each term the places and weights of the candidates that have it; places None: kept as a whole column, as most have it.

    Vectors are laid end to end and sorted by term, so memory follows the number of
    components, whatever the widest vector is. A term that no candidate has has no entry.
    """

    def __init__(self, vectors: list[np.ndarray], scale: int):
        n, sizes = len(vectors), np.array([len(x) for x in vectors], np.int64)
        self.vectors, self.scale, self.width, self.n = vectors, scale, int(sizes.max(initial=0)), n
        flat = np.concatenate(vectors) if n else np.zeros(0)
        with np.errstate(over="ignore"):
            flat = np.floor(flat * scale)
        place = np.repeat(np.arange(n), sizes)
        self.largest = np.zeros(n)
        np.maximum.at(self.largest, place, np.abs(flat))
        self.small = self.largest.max(initial=0) < 2**15
        kept = np.flatnonzero((flat != 0) & (self.largest < SAFE)[place])
        term = kept - np.repeat(np.cumsum(sizes) - sizes, sizes)[kept]
        kept = kept[np.argsort(term, kind="stable")]
        term, place, weight = np.sort(term), place[kept], flat[kept].astype(np.int32 if self.small else np.int64)
        #: The terms that a candidate has, ascending, and the postings of each.
        self.known, first = np.unique(term, return_index=True)
        self.terms: list[tuple[np.ndarray | None, np.ndarray]] = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=False):
            if 2 * (b - a) > n:
                column = np.zeros(n, weight.dtype)
                column[place[a:b]] = weight[a:b]
                self.terms.append((None, column))
            else:
                self.terms.append((place[a:b], weight[a:b]))

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """The inner products, and the exact ones of the places where 64 bits may not hold the sum."""
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.floor(query[: self.width] * self.scale)
            most = np.nan_to_num(np.abs(q).max(initial=0) * self.largest * max(1, len(q)), nan=np.inf)
        sure = most < SAFE
        if np.abs(q).max(initial=0) >= SAFE:
            q = np.zeros(0)
        narrow = self.small and most.max(initial=0) < 2**30
        out = np.zeros(self.n, np.int32 if narrow else np.int64)
        buffer = np.empty_like(out)
        _, at, of = np.intersect1d(np.flatnonzero(q), self.known, assume_unique=True, return_indices=True)
        own = q[np.flatnonzero(q)[at]].tolist()
        for x, i in zip(own, of.tolist(), strict=True):
            places, weights = self.terms[i]
            if places is None:
                np.multiply(weights, out.dtype.type(x), out=buffer)
                out += buffer
            else:
                out[places] += weights * out.dtype.type(x)
        exact = {}
        if not sure.all():
            own = [whole(x, self.scale) for x in query.tolist()]
            for i in np.flatnonzero(~sure).tolist():
                exact[i] = sum(a * whole(b, self.scale) for a, b in zip(own, self.vectors[i].tolist(), strict=False))
                out[i] = min(max(exact[i], LOWEST), HIGHEST)
        return out, exact


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties to the lower place, by partition."""
    n = len(scores)
    if n <= k:
        return np.arange(n)
    least = np.partition(scores, n - k)[n - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    """The k best candidates of each query: highest score, then smallest vec_id; of the query's own rows all but one."""
    candidates = candidates.sort_values("vec_id", kind="stable")
    ids, copies = candidates["vec_id"].to_numpy(), candidates["n"].to_numpy()
    vectors = [np.asarray(x, np.float64) for x in candidates["embedding"]]
    postings = Postings(vectors, scale)
    found: dict[str, list] = {c: [] for c in ("query_id", "query_key", "query_rows", "vec_id", "score", "beyond")}
    for query_id, q, n in zip(queries["vec_id"], queries["embedding"], queries["n"], strict=True):
        q = np.asarray(q, np.float64)
        # -0.0 and 0.0 are one vector in Spark's grouping
        key = hashlib.blake2b((q + 0.0).tobytes(), digest_size=16).digest()
        scores, exact = postings.scores(q)
        rows = copies
        for i in range(*np.searchsorted(ids, [query_id, query_id + 1])) if query_id < HIGHEST else np.flatnonzero(ids == query_id):
            if np.array_equal(vectors[i], q):
                rows = copies.copy()
                rows[i] -= 1
        others = np.flatnonzero(rows > 0)
        if exact:
            sure = others[~np.isin(others, list(exact))]
            top = [*sure[best_places(scores[sure], k)].tolist(), *(i for i in exact if rows[i] > 0)]
            top = sorted(top, key=lambda i: (-exact.get(i, int(scores[i])), i))[:k]
        else:
            top = others[best_places(scores[others], k)]
        top = np.asarray(top, np.int64)
        own = np.minimum(rows[top], k)
        size = int(own.sum())
        beyond = [ordered_bytes(exact[i]) if i in exact and not LOWEST < exact[i] < HIGHEST else None for i in top.tolist()]
        found["query_id"].append(np.full(size, query_id, np.int64))
        found["query_key"].extend([key] * size)
        found["query_rows"].append(np.full(size, n, np.int64))
        found["vec_id"].append(np.repeat(ids[top], own))
        found["score"].append(np.repeat(scores[top].astype(np.int64), own))
        found["beyond"].extend(b for b, c in zip(beyond, own.tolist(), strict=True) for _ in range(c))
    for c in ("query_id", "query_rows", "vec_id", "score"):
        found[c] = np.concatenate(found[c]) if found[c] else np.zeros(0, np.int64)
    return pd.DataFrame(found)


def top_k(vectors: DataFrame, is_query, *, k: int = 20, scale: int = 64, query_block: int = 1024, block: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best other rows of each row that fits ``is_query``.

    ``vectors`` needs vec_id and embedding (an array of numbers); other columns are left
    out. Score: inner product of the vectors floor(``scale`` * x), missing components
    counting as zero; it is exact and ranks exactly at any size, but one that 64 bits
    can't hold is shown as the nearest 64-bit integer. Ties go to the smaller vec_id. Null
    vec_ids and vectors that are null or hold a null or non-finite component take no part.
    Each row is a query and a candidate of its own, also where rows repeat a vec_id or are
    equal; only a query's own row isn't its candidate, so a vec_id with two query rows has
    two lists. Fewer than ``k`` others give fewer rows; an empty table gives none. Blocks
    are dealt by hash of id and vector, equal rows as one with their number; the number of
    blocks follows the counts of rows, so a task's memory doesn't grow with the input.
    """
    rows = written(distinct_vectors(vectors), "vectors")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    c, d = max(1, -(-n // block)), max(1, -(-m // query_block))
    deal = F.xxhash64("vec_id", "embedding")
    left = queries.select("vec_id", "embedding", "n", F.pmod(deal, F.lit(d)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("cb"))
    right = rows.select("vec_id", "embedding", "n", F.pmod(deal, F.lit(c)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("qb"))
    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
    best = pairs.applyInPandas(lambda q, x: search_block(q, x, k, scale), RESULT)
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("query_rows").cast("int")))).select("query_id", "rank", "vec_id", "score")
