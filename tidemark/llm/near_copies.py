"""Near copies by Jaccard similarity of word shingles: SimHash candidates by operator 4's method, every link checked exactly.

Texts become sets of shingle hashes, and sets become fingerprints of several words of 64
bits, embedded as the counts of set bits in segments of two bits. A band of segments is a
grid over its counts and over the sets' sizes, in which sets of similar size meet. Pairs of
a cell pass the Manhattan bound, then the exact distance of the fingerprints. A similarity
of 0.8 stands for an angle at which 15 % of the bits differ, so unlike operator 4's 4 of 64
bits no bands can hold each such pair for sure; there are so many that next to none is lost.
The linked sets' components are the clusters inside which sets are compared exactly. A
cluster gives the edges of a spanning forest of its links, so the output stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import marked, small_batches, written
from tidemark.llm.components import BOTH, LEFT, RIGHT, connected_components, dealt_parts, hub_join

#: Columns of a set's place in a grid; tree is 0 for a set that is a tree of its own. Last, the many zeros add next to nothing to a shuffle's compressed rows.
NAMES = ["cell", "side", "key", "w0", "w1", "w2", "tree"]


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; of a shorter text the hash of all words; none without words."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.unique(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)), np.uint64, len(words) - width + 1))


#: Lowest bits of bytes, and of segments of two bits.
_LANES, _ODD = np.uint64(0x0101010101010101), np.uint64(0x5555555555555555)
#: Words of a fingerprint by which a pair is checked; bands are cut from all words.
CHECKED = 3


def wide_fingerprint(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, a word of 64 bits for each of ``factors`` (odd): a bit is 1 if set in over half the mixed hashes."""
    counts = np.zeros((len(factors), 8, 8), np.int64)
    for at in range(0, len(own), 255 * 64):
        x = factors[:, None] * own[at : at + 255 * 64]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        # eight counters of a byte each are added up at once, and 255 hashes fill no byte
        edges = np.arange(0, x.shape[1], 255)
        for bit in range(8):
            lanes = np.add.reduceat((x >> np.uint64(bit)) & _LANES, edges, axis=1)
            counts[:, :, bit] += lanes.view(np.uint8).reshape(len(factors), len(edges), 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > len(own), axis=-1, bitorder="little").reshape(-1).view("<u8")


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The counts of set bits in segments of two bits, side by side in unary (00, 01, 11): their Manhattan distance is the number of differing bits."""
    high = fp >> np.uint64(1)
    return ((fp | high) & _ODD) | ((fp & high & _ODD) << np.uint64(1))


def shingle_sets(docs: DataFrame, *, width: int, seed: int, words: int) -> DataFrame:
    """doc_id, text_hash, key (a hash of the shingle set), shingles (binary), size (bytes of these) and fp (``words`` longs), a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    factors = np.random.default_rng(seed).integers(0, 2**64, words, np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, width, seed) for x in batch.column(2).to_pylist()]
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets), np.uint64, len(sets)).view(np.int64)
            fps = np.array([wide_fingerprint(s, factors) for s in sets], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.nbytes for s in sets], pa.int64()), pa.array(list(fps), pa.list_(pa.int64()))], ["doc_id", "text_hash", "key", "shingles", "size", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, key long, shingles binary, size long, fp array<long>")


def grid_rows(fp: np.ndarray, size: np.ndarray, least: float, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of fingerprints (a row each), and whether a cell is a probe: ``bands`` a word, then the same with the next greater size.

    Of two sets with a similarity of ``least`` or more the sizes' logarithms to the base
    1 / ``least`` differ by at most one, so the lesser one's probe is in the greater one's cell.
    """
    counts = unary_counts(fp)
    masks = [np.uint64(sum(3 << 2 * int(s) for s in band)) for band in np.array_split(np.arange(32), bands)]
    own = np.stack([counts[:, w] & mask for w in range(counts.shape[1]) for mask in masks], axis=1)
    step = np.floor(np.log(size) / (np.log(1 / least) * (1 + 1e-9))).astype(np.uint64)[:, None]

    def mixed(level: np.ndarray) -> np.ndarray:
        x = (own ^ (np.arange(own.shape[1], dtype=np.uint64) << np.uint64(8) | level) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    return np.concatenate([mixed(step), mixed(step + np.uint64(1))], axis=1), np.repeat([False, True], own.shape[1])


def set_cells(sets: DataFrame, *, least: float, bands: int, start: int, end: int) -> DataFrame:
    """Rows (cell, side, key, a word for each of those checked, tree) of ``sets`` (key, size in bytes, fp, tree): own cells and probes of the bands from ``start`` to ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.array(batch.column(2).to_pylist(), np.int64).view(np.uint64)
            cells, probe = grid_rows(fp, batch.column(1).to_numpy() // 8, least, bands)
            wanted = np.arange(len(probe)) % (len(probe) // 2)
            wanted = (wanted >= start) & (wanted < end)
            cells, probe = cells[:, wanted], probe[wanted]
            sides = np.tile(np.where(probe, RIGHT, BOTH).astype(np.int32), len(fp))
            columns = [cells.reshape(-1).view(np.int64), sides, *(np.repeat(x, cells.shape[1]) for x in (batch.column(0).to_numpy(), *fp.view(np.int64).T[:CHECKED], batch.column(3).to_numpy()))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], NAMES)

    return sets.where("size > 0").select("key", "size", "fp", "tree").mapInArrow(run, f"cell long, side int, key long, {', '.join(f'{c} long' for c in NAMES[3:])}")


def joining(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The places of pairs (i, j) of nodes that join separate trees of ``root`` (the tree of each node) without a circle; ``root`` then has the joined trees."""
    picked = [np.zeros(0, np.int64)]
    live = np.flatnonzero(root[i] != root[j])
    while len(live):
        # each tree takes its first pair: as no two pairs are the same one, only the two trees of a pair can form a circle
        first = np.full(len(root), len(i))
        np.minimum.at(first, root[i[live]], live)
        np.minimum.at(first, root[j[live]], live)
        own = np.flatnonzero(first < len(i))
        pick = first[own]
        x, y = root[i[pick]], root[j[pick]]
        to = np.arange(len(root))
        to[own] = np.where(x == own, y, x)
        mutual = own[(to[to[own]] == own) & (own < to[own])]
        to[mutual] = mutual
        while (to[to] != to).any():
            to = to[to]
        root[:] = to[root]
        picked.append(np.unique(pick))
        live = live[root[i[live]] != root[j[live]]]
    return np.concatenate(picked)


def near_links(node: np.ndarray, root: np.ndarray, fp: np.ndarray, side: np.ndarray, reach: int, most: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell whose links join what its links join: the bound of all pairs of separate trees, then the exact distance.

    ``node`` is each row's place in ``root`` (see ``joining``). Rows of the cell's largest tree aren't compared with each other.
    """
    counts = unary_counts(fp)
    tree = np.unique(root[node], return_inverse=True)[1]
    inner = tree == np.bincount(tree).argmax()
    left, right = (side & LEFT) > 0, (side & RIGHT) > 0
    pairs = []
    for own, others in ((left & ~inner, right), (left & inner, right & ~inner)):
        own, others = np.flatnonzero(own), np.flatnonzero(others)
        step = max(1, most // max(1, len(others)))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            i, j = np.nonzero(sum(np.bitwise_count(counts[part, None, w] ^ counts[others, w]) for w in range(fp.shape[1])) <= reach)
            i, j = part[i], others[j]
            apart = root[node[i]] != root[node[j]]
            i, j = i[apart], j[apart]
            hit = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= reach
            i, j = i[hit], j[hit]
            kept = joining(node[i], node[j], root)
            if len(kept):
                pairs.append((i[kept], j[kept]))
    return pairs


def small_links(run: np.ndarray, node: np.ndarray, root: np.ndarray, fp: np.ndarray, side: np.ndarray, reach: int, small: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same of many cells of at most ``small`` rows (the same ``run``) at a time, a row with the k-th after it for each k."""
    words = np.ascontiguousarray(fp.T)
    counts = unary_counts(words)
    own = (side & LEFT) > 0, (side & RIGHT) > 0
    pairs = []
    for k in range(1, small):
        same = run[k:] == run[:-k]
        if not same.any():
            break
        i = np.flatnonzero(same & (own[0][k:] & own[1][:-k] | own[0][:-k] & own[1][k:]) & (root[node[k:]] != root[node[:-k]]))
        bound = sum(np.bitwise_count(c[i] ^ c[i + k]) for c in counts)
        i = i[bound <= reach]
        i = i[sum(np.bitwise_count(w[i] ^ w[i + k]) for w in words) <= reach]
        i = i[joining(node[i], node[i + k], root)]
        if len(i):
            pairs.append((i, i + k))
    return pairs


def set_edges(cells: Iterator[pa.RecordBatch], reach: int, small: int = 64, rows_held: int = 65536) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of sets in the trees a < b, from rows (cell, part, side, key, words, tree) that come sorted, so that a cell's part stands together; the last, unfinished one is kept.

    Of the rows held at a time the edges join what all their links join, with no circle.
    """
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1])
        size = np.diff(np.append(starts, len(rows)))
        member = np.repeat(size, size)
        side, keys, fp = rows[:, 2], rows[:, 3], rows[:, 4 : 4 + CHECKED].view(np.uint64)
        trees, node = np.unique(np.where(rows[:, -1] == 0, keys, rows[:, -1]), return_inverse=True)
        root = np.arange(len(trees))
        few = np.flatnonzero((member > 1) & (member <= small))
        pairs = [(few[i], few[j]) for i, j in small_links(np.repeat(np.arange(len(size)), size)[few], node[few], root, fp[few], side[few], reach, small)]
        for at in np.flatnonzero(size > small).tolist():
            own = slice(starts[at], starts[at] + size[at])
            pairs += [(i + starts[at], j + starts[at]) for i, j in near_links(node[own], root, fp[own], side[own], reach)]
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (trees[node[i]], trees[node[j]], keys[i], keys[j])], ["a", "b", "u", "v"])

    for batch in cells:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]))
        if sum(map(len, held)) < rows_held or (held[0][0, :2] == held[-1][-1, :2]).all():
            continue  # few rows, or one cell fills all that is held
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1] + 1
        held = [rows[last:]]
        yield from done(rows[:last])
    if held:
        yield from done(np.concatenate(held))


def near_rounds(sets: DataFrame, *, least: float, reach: int, bands: int, hot: int, ahead: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (u, v) of the first ``ahead`` bands, the trees (v, root) that these make, and edges of the other bands, one at most for two trees.

    A group of near copies meets in most bands. Most of it is one tree after the first ones,
    so the other bands add few edges: their number follows the sets, not sets times bands.
    """

    def found(rows: DataFrame, start: int, end: int) -> DataFrame:
        dealt = dealt_parts(set_cells(rows, least=least, bands=bands, start=start, end=end), NAMES[2:], hot)
        edges = dealt.mapInArrow(lambda batches: set_edges(batches, reach), "a long, b long, u long, v long")
        return edges.groupBy("a", "b").agg(F.min(F.struct("u", "v")).alias("edge")).select("edge.u", "edge.v")

    words = sets.select(F.max(F.size("fp"))).first()[0] or 0
    rows = sets.select("key", "size", "fp")
    early = written(found(rows.withColumn("tree", F.lit(0).cast("long")), 0, ahead), "early-links")
    trees = connected_components(early)
    known = rows.join(trees.select(F.col("v").alias("key"), F.col("root").alias("tree")), "key", "left").withColumn("tree", F.coalesce("tree", F.lit(0)))
    return early, trees, written(found(known, ahead, words * bands), "late-links")


def near_sets(sets: DataFrame, *, least: float, reach: int, bands: int = 7, hot: int = 16384, ahead: int = 2) -> DataFrame:
    """Edges (u, v) that join what the links among ``sets`` (a row for each key, size, fp) join: at most ``reach`` differing bits in the checked words."""
    early, _, late = near_rounds(sets, least=least, reach=reach, bands=bands, hot=hot, ahead=ahead)
    return early.unionAll(late)


def near_clusters(sets: DataFrame, *, least: float, reach: int, bands: int = 7, hot: int = 16384, ahead: int = 2) -> DataFrame:
    """Rows (v, root) of the components of ``near_sets``: the trees of the first bands are not taken apart again."""
    _, trees, late = near_rounds(sets, least=least, reach=reach, bands=bands, hot=hot, ahead=ahead)
    return connected_components(trees.select(F.col("root").alias("u"), "v").unionAll(late))


def linked_sets(keys: list[int], sets: list[np.ndarray], sides: list[int], least: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with a Jaccard similarity of ``least`` or more: all pairs, or with both sides given those between them."""
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(codes.max()) + 1, np.int64)

    def similar(x: int, flat: np.ndarray, begins: np.ndarray, among: np.ndarray) -> np.ndarray:
        own = codes[ends[x] - size[x] : ends[x]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], begins)
        mark[own] = 0
        return common >= least * (size[among] + size[x] - common)

    def laid(among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([codes[ends[i] - size[i] : ends[i]] for i in among]), np.cumsum(size[among]) - size[among]

    edges = []
    if len(set(sides)) > 1:
        side = np.array(sides)
        right = np.flatnonzero(side == 1)
        tree, (flat, begins) = np.arange(len(right)), laid(right)
        for x in np.flatnonzero(side == 0):
            hit = np.flatnonzero(similar(x, flat, begins, right))
            touched, first = np.unique(tree[hit], return_index=True)
            edges.extend((keys[x], keys[y]) for y in right[hit[first]])
            if len(touched) > 1:
                joined = np.zeros(len(right), bool)
                joined[touched] = True
                tree[joined[tree]] = touched[0]
        return edges
    rest = np.arange(len(sets))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        flat, begins = laid(rest)
        while frontier and len(rest):
            x = frontier.pop()
            hit = similar(x, flat, begins, rest)
            if hit.any():
                edges.extend((keys[x], keys[y]) for y in rest[hit])
                frontier.extend(rest[hit].tolist())
                rest = rest[~hit]
                if len(rest):
                    flat, begins = laid(rest)
    return edges


def cluster_edges(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Edges from rows (cluster, part, side, key, shingles) that come sorted, so that a cluster's rows stand together."""
    now, keys, sets, sides = None, [], [], []
    out: list[tuple[int, int]] = []
    for batch in batches:
        for cluster, part, side, key, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (cluster, part) != now:
                out.extend(linked_sets(keys, sets, sides, least) if len(keys) > 1 else [])
                now, keys, sets, sides = (cluster, part), [], [], []
            keys.append(key)
            sets.append(np.frombuffer(own, np.uint64))
            sides.append(side)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["u", "v"])
            out = []
    out.extend(linked_sets(keys, sets, sides, least) if len(keys) > 1 else [])
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["u", "v"])


def compared(sets: DataFrame, dealt: DataFrame, least: float, name: str) -> DataFrame:
    """Edges (u, v) inside each part of ``dealt`` (key, cluster, part, side), with the shingles of ``sets``."""
    # most sets are in no cluster: their shingles aren't shuffled
    keys = written(dealt.select("key").distinct(), f"{name}-keys")
    own = marked(sets.select("key", "shingles"), keys, ["key"], held=True)
    own = own.join(keys, "key", "left_semi").groupBy("key").agg(F.min("shingles").alias("shingles"))
    rows = dealt.join(own, "key").select("cluster", "part", "side", "key", "shingles")
    ordered = rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return written(ordered.mapInArrow(lambda batches: cluster_edges(batches, least), "u long, v long"), name)


def first_deal(member: DataFrame) -> DataFrame:
    """Each set of ``member`` (key, cluster, n, blocks, b) in its own block, and about 16 sets of a cluster by hash in all its blocks, which ties these together."""
    tie = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("key", F.lit(11)), F.col("n")) < 16)
    parts = F.when(tie, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("b"))
    return member.select("key", "cluster", F.explode(parts).alias("part"), F.lit(0).alias("side"))


def second_deal(member: DataFrame, hot: int) -> DataFrame:
    """For clusters in several trees: the sets outside the largest tree against all sets, by pairs of blocks.

    ``member`` (key, cluster, blocks, b, tree). Sets of the largest tree are linked to each
    other already; they are repeated only as often as the others fill a block.
    """
    trees = member.groupBy("cluster", "tree").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    most = trees.groupBy("cluster").agg(F.max(F.struct("n", "tree")).alias("most"), F.sum("n").alias("all"), F.max("blocks").alias("blocks"), F.count("*").alias("trees")).where("trees > 1")
    outside = F.col("all") - F.col("most.n")
    # blocks that are small for their bytes are so on this side, too
    outer = F.greatest(F.ceil(outside * 2 / hot), F.floor(outside * F.col("blocks") / F.col("all"))).cast("int")
    most = most.select("cluster", F.col("most.tree").alias("largest"), outer.alias("outer"), F.col("all").alias("n"))
    dealt = hub_join(member, most, "cluster", "key", member.count()).where("largest is not null")
    outside = F.col("tree") != F.col("largest")
    own = F.pmod(F.xxhash64("key", F.lit(13)), F.col("outer")).cast("int")
    right = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: F.struct((o * F.col("blocks") + F.col("b")).alias("part"), F.lit(1).alias("side")))
    left = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct((own * F.col("blocks") + o).alias("part"), F.lit(0).alias("side")))
    return dealt.select("key", "cluster", F.inline(F.when(outside, F.concat(left, right)).otherwise(right))).select("key", "cluster", "part", "side")


def shared_cells(sets: DataFrame) -> DataFrame:
    """Edges (u, v) of the smallest key of each of the cells that ``sets`` (key, cells) give with all its keys."""
    # a set's own cells differ, so one row for each key suffices
    cells = sets.groupBy("key").agg(F.first("cells").alias("cells")).select("key", F.explode("cells").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("key").alias("u"), F.max("key").alias("most"), F.count("*").alias("n")).where("u < most")
    total = sets.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]
    stars = hub_join(cells, shared.select("cell", "u", "n"), "cell", "key", total).where("u is not null")
    return stars.select("u", F.col("key").alias("v")).distinct()


def copy_roots(sets: DataFrame, *, least: float = 0.8, reach: int = 60, hot: int = 1024, heavy: int = 256 << 20) -> DataFrame:
    """Rows (v, root) for each set key of ``sets`` (key, shingles, fp, size) that isn't its group's smallest.

    Candidates are linked by their fingerprints, or with a column ``cells`` for fp by
    sharing one of these. A cluster with more than ``hot`` sets or ``heavy`` bytes of shingles is cut into blocks
    of about half that many by hash. Without the column ``size`` the bytes are measured. Sets are compared inside their block first; then those outside a cluster's
    largest tree are compared with all of the cluster, so every pair is held or is joined
    already, and a large group of near copies costs in proportion to its sets.
    """
    size = F.col("size") if "size" in sets.columns else F.length("shingles")
    if "cells" in sets.columns:
        sized, clusters = sets.groupBy("key").agg(F.max(size).alias("size")), connected_components(shared_cells(sets))
    else:
        sized = written(sets.groupBy("key").agg(F.first("fp").alias("fp"), F.max(size).alias("size")), "distinct-sets")
        clusters = near_clusters(sized, least=least, reach=reach)
    member = clusters.unionAll(clusters.select(F.col("root").alias("v"), "root").distinct())
    member = member.withColumnRenamed("v", "key").withColumnRenamed("root", "cluster")
    member = written(member.join(sized.select("key", "size"), "key"), "candidate-clusters")
    sizes = member.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    fill = F.greatest(F.col("sets") / hot, F.col("bytes") / heavy)
    blocks = F.when(fill > 1, F.least(F.ceil(2 * fill), F.col("sets"))).otherwise(1).cast("int")
    member = hub_join(member, sizes.withColumn("sets", F.col("n")), "cluster", "key", member.count())
    member = member.select("key", "cluster", F.col("sets").alias("n"), blocks.alias("blocks"))
    member = written(member.withColumn("b", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")), "dealt-clusters")
    edges = compared(sets, first_deal(member), least, "block-edges")
    trees = connected_components(edges)
    large = member.where("blocks > 1").join(trees.withColumnRenamed("v", "key"), "key", "left")
    large = written(large.select("key", "cluster", "blocks", "b", F.coalesce("root", "key").alias("tree")), "large-clusters")
    if large.isEmpty():
        return trees
    across = compared(sets, second_deal(large, hot), least, "outer-edges")
    return connected_components(trees.select(F.col("root").alias("u"), "v").unionAll(across))
