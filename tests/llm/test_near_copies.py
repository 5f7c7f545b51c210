"""The pipeline's near-duplicate stage finds its candidates by operator 4's method."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.test_operators import joined
from tidemark.llm import near_copies, simhash

FACTORS = np.random.default_rng(42).integers(0, 2**64, 7, np.uint64) | np.uint64(1)


def pair(rng, size, common):
    """Two sets of ``size`` hashes that share ``common``."""
    h = rng.integers(0, 2**64, 2 * size - common, np.uint64)
    return np.unique(h[:size]), np.unique(np.concatenate([h[:common], h[size:]]))


def test_wide_fingerprint_is_the_bits_set_in_over_half():
    for n in (1, 2, 255, 256, 700, 17_000):
        own = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        x = own[:, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        want = [sum(1 << b for b in range(64) if 2 * int(((x[:, w] >> np.uint64(b)) & np.uint64(1)).sum()) > n) for w in range(7)]
        assert near_copies.wide_fingerprint(own, FACTORS).tolist() == want


@pytest.mark.parametrize("hot", [16, 16384])
def test_candidates_equal_brute_force_of_fingerprints(spark, hot):
    """Every pair at 0.8 is linked; what is joined is joined by links of at most ``reach`` bits, also in cut cells and large ones."""
    rng = np.random.default_rng(5)
    sets = [s for size in (9, 45, 180) for _ in range(40) for s in pair(rng, size, 8 * size // 9)]
    centre = rng.integers(0, 2**64, 100, np.uint64)
    sets += [np.unique(np.concatenate([centre[:95], rng.integers(0, 2**64, 5, np.uint64)])) for _ in range(90)]
    fp = np.array([near_copies.wide_fingerprint(s, FACTORS) for s in sets])
    df = spark.createDataFrame([(i, 8 * len(s), x.view(np.int64).tolist()) for i, (s, x) in enumerate(zip(sets, fp, strict=True))], "key long, size long, fp array<long>")
    links = [(r["u"], r["v"]) for r in near_copies.near_sets(df, least=0.8, reach=60, hot=hot).collect()]
    assert all(np.bitwise_count(fp[u, :3] ^ fp[v, :3]).sum() <= 60 for u, v in links)
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert len(similar) > 4000 and joined(range(len(sets)), links + similar) == joined(range(len(sets)), links)


def test_stage_links_by_the_distance_of_fingerprints(spark):
    """The reach in bits decides which near copies are candidates."""
    rng = random.Random(3)
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        near = [*words[:100], f"n{i}", *words[101:]]
        rows += [(i, " ".join(words)), (i + 1, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == list(range(0, 40, 2))
    assert simhash.keep_one(df, reach=0).count() == 40


def test_links_of_a_group_follow_its_sets(spark):
    """A group of near copies meets in nearly all bands; its links are about as many as its sets, and so are the ones of small cells."""
    rng = np.random.default_rng(9)
    sets = []
    for size in (400, 40, 40, 40):
        centre = rng.integers(0, 2**64, 120, np.uint64)
        sets += [np.unique(np.concatenate([centre[:114], rng.integers(0, 2**64, 6, np.uint64)])) for _ in range(size)]
    fp = np.array([near_copies.wide_fingerprint(s, FACTORS) for s in sets])
    df = spark.createDataFrame([(i, 8 * len(s), x.view(np.int64).tolist()) for i, (s, x) in enumerate(zip(sets, fp, strict=True))], "key long, size long, fp array<long>")
    links = [(r["u"], r["v"]) for r in near_copies.near_sets(df, least=0.8, reach=60).collect()]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if np.bitwise_count(fp[i, :3] ^ fp[j, :3]).sum() <= 60]
    assert joined(range(len(sets)), links) == joined(range(len(sets)), near)
    assert len(links) <= 4 * len(sets)
    assert all(np.bitwise_count(fp[u, :3] ^ fp[v, :3]).sum() <= 60 for u, v in links)


def test_joining_takes_no_circle():
    """The picked pairs join what all pairs join, one fewer than nodes in each tree; trees that are known aren't joined again."""
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (2, 3), (50, 30), (400, 2000)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        root = np.arange(n)
        picked = near_copies.joining(i, j, root)
        assert joined(range(n), zip(i[picked].tolist(), j[picked].tolist(), strict=True)) == joined(range(n), zip(i.tolist(), j.tolist(), strict=True))
        assert len(picked) == n - len(np.unique(root))
        assert len(near_copies.joining(i, j, root)) == 0
