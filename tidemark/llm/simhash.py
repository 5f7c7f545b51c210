"""Operator 4: near-duplicate groups by SimHash fingerprints.

Fingerprints are embedded as the counts of set bits in 32 segments of two bits. The
Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints. The segments are dealt into bands, each a grid over its segments' counts
with a range of its own: ranges of 1, 1 and 0 for ``reach`` 4, as a distance of 4 can't
exceed all of them (2 + 2 + 1 is 5). A fingerprint stands in its own cell of each grid and
probes the cells in range that are one count higher, so a range join finds every pair
that the bound allows in some band. Of these pairs the whole Manhattan bound removes what
it can, and only the rest is verified exactly. A cell gives the edges of a spanning forest
of its links, never all pairs: components stay whole and the output stays linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import marked, packed, small_batches, written
from tidemark.llm.components import BOTH, LEFT, RIGHT, connected_components, dealt_parts, hub_join
from tidemark.llm.near_copies import copy_roots, shingle_sets

#: Bit patterns for counting set bits in segments of two bits.
_ODD = 0x5555555555555555


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = h[at : at + 65536]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), a row for each row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x, width, seed) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fp long")


def _counts(fp: np.ndarray) -> np.ndarray:
    """The 32 two-bit counts of each fingerprint side by side, a count in unary (00, 01, 11)."""
    odd, high = np.uint64(_ODD), fp >> np.uint64(1)
    return ((fp | high) & odd) | ((fp & high & odd) << np.uint64(1))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the segments of the differences of two count vectors: in unary, their differing bits."""
    return np.bitwise_count(a ^ b)


class Steps:
    """The numbers of pairs that the grids give, that the Manhattan bound leaves, and that are linked."""

    def __init__(self, reach: int):
        self.reach, self.seen, self.bounded, self.linked = reach, 0, 0, 0

    def hits(self, fp: np.ndarray, counts: np.ndarray, other: np.ndarray, other_counts: np.ndarray) -> np.ndarray:
        """The places of the linked pairs: first by the bound, then exactly for what it leaves."""
        left = np.flatnonzero(_manhattan(counts, other_counts) <= self.reach)
        differing = (fp if np.ndim(fp) == 0 else fp[left]) ^ other[left]
        found = left[np.bitwise_count(differing) <= self.reach]
        self.seen, self.bounded, self.linked = self.seen + len(other), self.bounded + len(left), self.linked + len(found)
        return found


def _between(left: np.ndarray, right: np.ndarray, steps: Steps) -> list[tuple[int, int]]:
    """Edges that join what the links between ``left`` and ``right`` join: each of ``left`` gets one to every separate tree it touches.

    A fingerprint may stand on both sides; its link to itself then joins its two places and is no edge.
    """
    cl, cr, edges = _counts(left), _counts(right), []
    tree = np.arange(len(right))
    for x, c in zip(left, cl, strict=True):
        hit = steps.hits(x, c, right, cr)
        touched, first = np.unique(tree[hit], return_index=True)
        edges.extend((int(x), int(y)) for y in right[hit[first]] if y != x)
        if len(touched) > 1:
            joined = np.zeros(len(right), bool)
            joined[touched] = True
            tree[joined[tree]] = touched[0]
    return edges


def cell_edges(cells: Iterator[pa.RecordBatch], steps: Steps, small: int = 48) -> Iterator[pa.RecordBatch]:
    """Edges from rows (cell, part, side, fp) that come sorted, so that a cell's rows stand together.

    Small cells are compared whole batches at a time, a row with the k-th after it for
    each k; larger ones a row of the left side at a time. Only the last, unfinished cell
    is kept between batches.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def done(cell, part, side, fp) -> pa.RecordBatch | None:
        change = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], change])
        size = np.diff(np.concatenate([starts, [len(fp)]]))
        edges_u, edges_v = [], []
        member = np.repeat(size, size)
        run = np.repeat(np.arange(len(size)), size)
        few = np.flatnonzero((member > 1) & (member <= small))
        f, r, s = fp[few], run[few], side[few]
        c = _counts(f)
        for k in range(1, min(small, len(few))):
            same = r[k:] == r[:-k]
            if not same.any():
                break
            same = np.flatnonzero(same & ((s[k:] & LEFT) & (s[:-k] >> 1) | (s[:-k] & LEFT) & (s[k:] >> 1)).astype(bool))
            hit = same[steps.hits(f[same], c[same], f[same + k], c[same + k])]
            edges_u.append(f[hit])
            edges_v.append(f[hit + k])
        for at in np.flatnonzero(size > small).tolist():
            own = slice(starts[at], starts[at] + size[at])
            edges = _between(fp[own][(side[own] & LEFT) > 0], fp[own][(side[own] & RIGHT) > 0], steps)
            if edges:
                u, v = np.array(edges, np.uint64).T
                edges_u.append(u)
                edges_v.append(v)
        if not sum(map(len, edges_u)):
            return None
        u, v = np.concatenate(edges_u).view(np.int64), np.concatenate(edges_v).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in cells:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        columns[3] = columns[3].view(np.uint64)
        held.append(tuple(columns))
        if held[0][0][0] == columns[0][-1] and held[0][1][0] == columns[1][-1]:
            continue  # one cell fills all that is held
        cell, part, side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = np.flatnonzero((cell != cell[-1]) | (part != part[-1]))[-1] + 1
        out = done(cell[:last], part[:last], side[:last], fp[:last])
        held = [(cell[last:], part[last:], side[last:], fp[last:])]
        if out is not None:
            yield out
    if held:
        out = done(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if out is not None:
            yield out


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _band_cells(own: Column, band: int, segments: list[int], ranged: bool) -> Column:
    """The cell of a band's counts ``own``, and with a range of one those one count higher in one segment."""
    home = F.array(F.struct(F.xxhash64(F.lit(band), own).alias("cell"), F.lit(BOTH).alias("side")))
    if not ranged:
        return home
    # in unary a count is 00, 01 or 11: shifted with a new bit it is one higher, but for 11, which stays
    bits = F.array(*[_signed(1 << 2 * s) for s in segments])
    higher = F.transform(bits, lambda b: own.bitwiseOR(F.shiftleft(own, 1).bitwiseOR(b).bitwiseAND(F.shiftleft(b, 1).bitwiseOR(b))))
    probes = F.transform(F.filter(higher, lambda x: x != own), lambda x: F.struct(F.xxhash64(F.lit(band), x).alias("cell"), F.lit(RIGHT).alias("side")))
    return F.concat(home, probes)


def grid_cells(reach: int) -> Column:
    """Array of the (cell, side) of a fingerprint ``fp``: its own cell of each band's grid, and the cells in range that it probes.

    Bands have a range of 1 or 0, so that the ranges plus one sum up to ``reach`` + 1. Of
    two counts that differ by one in one segment the lower one probes the higher one's cell.
    """
    bands = max(3, -(-(reach + 1) // 2))
    odd, high = F.lit(_ODD), F.shiftrightunsigned("fp", 1)
    counts = F.col("fp").bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(high).bitwiseAND(odd), 1))

    def band(c: Column, i: int, segments: list[int]) -> Column:
        own = c.bitwiseAND(_signed(sum(3 << 2 * s for s in segments)))
        return _bound(own, lambda x: _band_cells(x, i, segments, i < reach + 1 - bands))

    return _bound(counts, lambda c: F.concat(*[band(c, i, s.tolist()) for i, s in enumerate(np.array_split(np.arange(32), bands))]))


def dealt_cells(fps: DataFrame, *, reach: int = 4, hot: int = 16384) -> DataFrame:
    """Rows (cell, part, side, fp), a cell's part in one partition and together.

    A cell with more than ``hot`` members is cut into blocks of about that many by hash;
    each block's own fingerprints meet each block's members in a part of its own, so no
    task gets an unbounded cell.
    """
    return dealt_parts(fps.select("fp", F.inline(grid_cells(reach))), ["fp"], hot)


def near_fingerprints(fps: DataFrame, *, reach: int = 4, hot: int = 16384) -> DataFrame:
    """Edges (u, v) that join what the links among distinct fingerprints ``fp`` join."""
    return dealt_cells(fps, reach=reach, hot=hot).mapInArrow(lambda batches: cell_edges(batches, Steps(reach)), "u long, v long").distinct()


def pair_steps(fps: DataFrame, *, reach: int = 4) -> DataFrame:
    """One row: the pairs of distinct fingerprints that the grids give, that the bound leaves, and that are linked (a pair as often as cells give it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(reach)
        for _ in cell_edges(batches, steps):
            pass
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (steps.seen, steps.bounded, steps.linked)], ["in_cells", "in_bound", "linked"])

    counts = dealt_cells(fps, reach=reach).mapInArrow(run, "in_cells long, in_bound long, linked long")
    return counts.agg(*[F.sum(c).alias(c) for c in counts.columns])


def near_duplicates(docs: DataFrame, *, width: int = 4, seed: int = 42, reach: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``docs`` needs doc_id and text; other columns are left out whatever their names.
    Documents whose fingerprints differ in at most ``reach`` bits are linked;
    component_id is the smallest doc_id reachable, itself included. Null and wordless
    texts have fingerprint zero and are linked as any other. Null doc_ids never are a
    component_id unless all of a component are null. Copies share one fingerprint and
    are never compared with each other. An empty table gives no row.
    """
    rows = written(fingerprints(docs, width=width, seed=seed), "fingerprints")
    found = roots(rows, reach=reach).select("fp", "component_id", "n")
    shown = hub_join(rows, found, "fp", "doc_id", rows.count())
    return shown.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def roots(rows: DataFrame, *, reach: int = 4) -> DataFrame:
    """fp, root (a fingerprint of its component), component_id and n (rows) of each distinct fingerprint of ``rows`` (doc_id, fp)."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    links = connected_components(near_fingerprints(distinct.select("fp"), reach=reach))
    member = distinct.join(links.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", F.col("n").alias("rows"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    found = hub_join(member.select("fp", "root", "rows"), smallest, "root", "fp", distinct.count())
    return written(found.select("fp", "root", "component_id", F.col("rows").alias("n")), "roots")


def keep_one(docs: DataFrame, *, width: int = 5, least: float = 0.8, seed: int = 42, words: int = 7, reach: int = 60) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id, null last.

    Documents are linked if the sets of their ``width``-word shingles have a Jaccard
    similarity of ``least`` or more, held exactly for each pair of candidates; this isn't
    the op4 query's rule. Candidates are found by operator 4's method: counts of two-bit
    segments of a SimHash of ``words`` words, a range join over grids of bands, the
    Manhattan bound, then at most ``reach`` differing bits of the first three words. Of
    pairs at 0.8 about one in 800,000 isn't found, of texts of few words one in 10,000. Sets are compared inside the candidates' components.
    Null and wordless texts are copies of each other. Columns stay as they are. Of a
    group's rows with that doc_id the one with the smallest hash of the text stays; of rows
    equal in both, any one.
    """
    sets = written(shingle_sets(docs, width=width, seed=seed, words=words), "shingle-sets")
    links = copy_roots(sets, least=least, reach=reach)
    found = sets.select("doc_id", "text_hash", "key").join(links.withColumnRenamed("v", "key"), "key", "left")
    return first_of_each(docs, found.withColumn("root", F.coalesce("root", "key")))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id, then hash of the text, of each group of ``found`` (doc_id, text_hash, root)."""
    keys = ["__none", "__id", "__text"]
    found = found.select("root", F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_hash").alias("__text"))
    best = written(found.groupBy("root").agg(F.min(F.struct(*keys)).alias("first")).select("first.*"), "first-rows")
    doc_id = F.col("doc_id").cast("long")
    own = packed(docs, doc_id.isNull().alias("__none"), F.coalesce(doc_id, F.lit(0)).alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__text"))
    # a row that is its group's first and the only one of its key stays where it is; the texts of the rest are shuffled
    counted = found.groupBy(*keys).agg(F.count("*").alias("__n")).join(best.withColumn("__best", F.lit(True)), keys, "left")
    unsure = written(counted.where("__n > 1 or __best is null").select(*keys), "unsure-rows")
    # not a semi join, which the optimiser moves below the bitmap, where all texts are shuffled
    settled = marked(own, unsure, keys, held=True).join(best, keys).dropDuplicates(keys)
    return marked(own, unsure, keys, held=False).unionAll(settled).select("__doc.*")
