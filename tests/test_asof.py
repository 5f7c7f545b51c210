"""As-of joins against brute force: ties, hot keys in many ranges, nulls, rows before the first."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tidemark.operators.asof import as_of_join
from tidemark.sources.workdir import work_folder


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_as_of_join_equals_brute_force(spark, strict, partitions):
    rng = random.Random(int(partitions))
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), rng.choice([None, *range(30)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(5, 30)]), rng.randrange(50)) for _ in range(300)]
    before, coalesce = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        l, r = spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, at int, v int")
        got = Counter((x["id"], x["k"], x["at"], tuple(x["m"]) if x["m"] else None) for x in as_of_join(l, r, ["k"], "at", "at", ties=["v"], strict=strict, name="m").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    want = Counter()
    for i, k, at in left:
        fits = [] if k is None or at is None else [x for x in right if x[0] == k and x[1] is not None and (x[1] < at or x[1] == at and not strict)]
        want[i, k, at, max(fits, key=lambda x: (x[1], x[2])) if fits else None] += 1
    assert got == want


def test_as_of_join_of_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1)], "k string, at int")
    assert [x["matched"] for x in as_of_join(rows, rows.limit(0), ["k"], "at", "at").collect()] == [None]
    assert as_of_join(rows.limit(0), rows, ["k"], "at", "at").count() == 0


def test_as_of_join_reads_its_tables_once_and_keeps_their_types(spark):
    paths = [work_folder(spark, n) for n in ("left", "right")]
    spark.sql("select cast(id as int) as id, if(id % 5 = 0, null, cast(id % 3 as int)) as k, cast(id as int) as at from range(40)").write.parquet(paths[0])
    spark.sql("select id % 3 as k, id as at, concat('v', id) as v from range(0, 40, 4)").write.parquet(paths[1])
    left, right = (spark.read.parquet(p) for p in paths)
    got = as_of_join(left, right, ["k"], "at", "at", ties=["v"])
    assert not [f for f in got.inputFiles() if "/left-" in f or "/right-" in f]  # rows without a key go with the others
    assert got.select(*left.columns).schema == left.schema and [f.dataType for f in got.schema["matched"].dataType] == [f.dataType for f in right.schema]
    want = {i: max((j for j in range(0, i + 1, 4) if i % 5 and j % 3 == i % 3), default=None) for i in range(40)}
    assert {r["id"]: r["matched"] and r["matched"]["at"] for r in got.collect()} == want
    assert as_of_join(left.select("k", "at"), right.select("k", "at"), ["k"], "at", "at").where("matched is not null").count() == sum(v is not None for v in want.values())
