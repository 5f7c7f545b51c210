"""The corpus pipeline, stage by stage, against brute force on its own input."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import BYTES, brute_counts, check_packing, clashing, library_ids, odd_docs
from tidemark.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], sf), name))
    return out


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.collect())


def test_stages_keep_the_columns_and_only_remove(stages):
    first = stages[0]
    for before, after in zip(stages[:4], stages[1:4], strict=False):
        assert after.columns == first.columns and not ids(after) - ids(before)
    assert stages[4].columns == first.columns


def test_quality_stage(stages):
    kept = ids(stages[2])
    for r in stages[1].collect():
        n = brute_counts(r["text"])
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert r["doc_id"] not in kept
    assert len(kept) > 0.7 * stages[1].count()


def shingle_set(t, width=5):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def test_one_of_each_near_duplicate_group_stays(stages):
    """Groups of five-word shingles at a Jaccard similarity of 0.8 or more, every pair held by brute force."""
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in stages[2].collect()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert ids(stages[3]) == collections.Counter({find(d) for d in sets})
    assert ids(stages[3]).total() < len(sets)


def test_mix_stage_takes_about_half_as_much_again(stages):
    def size(df):
        return sum(brute_counts(r["text"])[0] for r in df.collect())

    assert abs(size(stages[4]) / size(stages[3]) - 1.5) < 0.2 and max(ids(stages[4]).values()) <= 2


def test_packing_stage_holds_every_copy(stages):
    pieces = stages[5].collect()
    want = collections.Counter()
    for r in stages[4].collect():
        want[r["doc_id"]] += len(library_ids(BYTES, r["text"])) + 1
    got = collections.Counter()
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    assert got == want and check_packing(pieces, {}) == 0
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] for r in pieces)


def test_run_gives_the_stages_rows(spark, sf, stages):
    def bag(df):
        return collections.Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect())

    total = collections.Counter()
    for df, sign in ((corpus_pipeline.run(spark, sf), 1), (stages[5], -1)):
        for (d, _, n, _), k in bag(df).items():
            total[d] += sign * n * k
    assert not any(total.values())


def test_stages_on_odd_and_empty_tables(spark, sf):
    """Null ids, null, empty and long texts, repeated rows and columns of clashing names; then no row at all."""
    odd = clashing(odd_docs(spark).unionAll(odd_docs(spark)).withColumn("n_chars", F.lit(1)))
    for docs in (odd, odd.limit(0)):
        rows = collections.Counter(map(str, docs.collect()))
        for name, f in corpus_pipeline.STAGES[:4]:
            out = f(spark, docs, sf)
            got = collections.Counter(map(str, out.collect()))
            assert out.columns == docs.columns and set(got) <= set(rows), name
            assert name == "mixing" or not got - rows
        assert sum(r["length"] for r in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()) >= rows.total()
