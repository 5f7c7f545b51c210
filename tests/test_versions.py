"""Tables of versions: keys by value, concurrent commits, folding, skipping, the log's checkpoint and vacuum."""

from __future__ import annotations

import datetime as dt
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge, versions
from tidemark.plans import ingestion
from tidemark.sources import files
from tidemark.sources.workdir import work_folder


def table(spark, **options):
    return versions.VersionedTable(spark, work_folder(spark, "table"), **options)


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("stored,other,value", [("long", "int", 7), ("int", "long", 7), ("decimal(10,2)", "decimal(12,4)", Decimal("1.50")), ("date", "timestamp_ntz", dt.date(2026, 1, 2)), ("string", "int", "7")])
def test_keys_meet_by_value(spark, stored, other, value):
    t = table(spark, buckets=4)
    one = spark.createDataFrame([(str(value), "old")], "k string, v string")
    t.upsert(one.select(F.col("k").cast(stored).alias("k"), "v"), ["k"], "a")
    t.upsert(one.select(F.col("k").cast(stored).cast(other).alias("k"), F.lit("new").alias("v")), ["k"], "b")
    assert values(t.read(), "k", "v") == [(value, "new")]
    assert t.read().schema["k"].dataType == one.select(F.col("k").cast(stored).alias("k")).schema["k"].dataType


@pytest.mark.parametrize("stored,other", [("decimal(10,2)", "1.234"), ("date", "2026-01-02 03:00:00"), ("int", "99999999999"), ("long", "x")])
def test_keys_that_lose_their_value_are_errors(spark, stored, other):
    t = table(spark)
    t.upsert(spark.createDataFrame([], f"k {stored}, v string"), ["k"], "a")
    kind = {"decimal(10,2)": "decimal(12,4)", "date": "timestamp_ntz", "int": "long", "long": "string"}[stored]
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(other,)], "k string").select(F.col("k").cast(kind).alias("k"), F.lit("v").alias("v")), ["k"], "b")


def test_columns_that_need_a_wider_type_rewrite_the_table(spark):
    t = table(spark)
    t.upsert(spark.createDataFrame([(1, 5), (2, 6)], "k long, v int"), ["k"], "a")
    t.upsert(spark.createDataFrame([(1, 2**40)], "k long, v long"), ["k"], "b")
    assert values(t.read(), "k", "v") == [(1, 2**40), (2, 6)] and t.state().schema["v"].dataType.simpleString() == "bigint"
    t.upsert(spark.createDataFrame([(2, 9)], "k long, v int"), ["k"], "c")  # a narrower one is cast
    assert values(t.read(), "k", "v") == [(1, 2**40), (2, 9)]


def test_writers_at_once_lose_no_row(spark):
    t = table(spark, buckets=4)
    t.upsert(spark.range(10).withColumn("who", F.lit(-1)), ["id"], "base")
    errors = []

    def load(i):
        try:
            own = versions.VersionedTable(spark, t.path)
            own.upsert(spark.range(100 * i, 100 * i + 10).withColumn("who", F.lit(i)), ["id"], f"w{i}")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=load, args=(i,)) for i in range(1, 5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors and t.read().count() == 50
    assert {r["run_id"] for r in t.log().collect()} >= {"base", "w1", "w2", "w3", "w4"}


def test_first_writers_at_once(spark):
    t, other = table(spark), None
    other = versions.VersionedTable(spark, t.path)
    first = t.state
    t.state = lambda: (other.upsert(spark.range(5, 10), ["id"], "other"), setattr(t, "state", first), versions.State())[2]
    t.upsert(spark.range(5), ["id"], "mine")
    assert values(t.read(), "id") == [(i,) for i in range(10)]


def test_rows_computed_from_a_version_conflict_with_its_change(spark):
    t = table(spark, buckets=8)
    t.upsert(spark.range(100).withColumn("n", F.lit(0)), ["id"], "base")
    at = t.version()
    t.upsert(spark.createDataFrame([(3, 1)], "id long, n int"), ["id"], "a", compact=False)
    with pytest.raises(versions.CommitConflict):
        t.upsert(spark.createDataFrame([(3, 2)], "id long, n int"), ["id"], "b", expected=at)
    bucket = t.log().where("run_id = 'a'").first()["changed"][0]
    free = next(i for i in range(100) if i != 3 and spark.range(i, i + 1).select(t._bucket(["id"], 8)).first()[0] != bucket)
    t.upsert(spark.createDataFrame([(free, 2)], "id long, n int"), ["id"], "c", expected=at)  # another bucket: no conflict
    assert {r["id"]: r["n"] for r in t.read().where("n > 0").collect()} == {3: 1, free: 2}
    with pytest.raises(versions.CommitConflict):
        t.write(t.read(), "d", ["id"], expected=at)
    folds = versions.VersionedTable(spark, t.path)
    state = folds.state()
    t.write(spark.range(1).withColumn("n", F.lit(7)), "e", ["id"])
    folds.state = lambda: state
    assert folds.compact(everything=True) is None and t.read().count() == 1


def test_folding_keeps_rows_and_bounds_the_deltas(spark):
    t = table(spark, buckets=4, fold=3.0, fan=3)
    want = {i: -1 for i in range(60)} | {None: -1}
    t.upsert(spark.createDataFrame([(k, v, "x") for k, v in want.items()], "k long, v long, w string"), ["k"], "base")
    nulls = 1
    for day in range(12):
        keys = [k for k in range(80) if (k * 7 + day) % 9 == 0]
        t.upsert(spark.createDataFrame([(k, day, "y") for k in [*keys, None]], "k long, v long, w string"), ["k"], f"d{day}")
        want |= dict.fromkeys(keys, day)
        nulls += 1
        assert len(t.state().deltas) <= 6
    got = t.read()
    assert {r["k"]: r["v"] for r in got.where("k is not null").collect()} == {k: v for k, v in want.items() if k is not None}
    assert got.where("k is null").count() == nulls and got.count() == len(want) - 1 + nulls
    kinds = [r["kind"] for r in t.log().collect()]
    assert "fold" in kinds
    t.compact(everything=True)
    assert not t.state().deltas and t.read().count() == got.count()


def test_a_newer_delta_stays_above_an_older_fold(spark):
    t = table(spark, buckets=2)
    t.upsert(spark.range(9).withColumn("v", F.lit("base")), ["id"], "base")
    t.upsert(spark.createDataFrame([(1, "one")], "id long, v string"), ["id"], "one", compact=False)
    slow = versions.VersionedTable(spark, t.path)
    commit = slow._commit
    slow._commit = lambda entry, seen: (t.upsert(spark.createDataFrame([(1, "two"), (2, "two")], "id long, v string"), ["id"], "two", compact=False), commit(entry, seen))[1]
    assert slow.compact(everything=True)
    assert {r["id"]: r["v"] for r in t.read().where("id < 3").collect()} == {0: "base", 1: "two", 2: "two"}


def test_skipped_files_hold_no_key(spark):
    t = table(spark, buckets=4, cursors=("at",))
    rows = spark.range(4000).select((F.col("id") * 3).alias("a"), F.concat(F.lit("k"), F.col("id") % 7).alias("b"), (F.col("id") % 500).alias("at"))
    t.write(rows, "base", ["a", "b"], rows_per_file=100)
    t.upsert(rows.where("a % 300 = 0").withColumn("at", F.lit(1000).cast("long")), ["a", "b"], "delta", compact=False)
    present = t.stats().select("file").distinct().count()
    for wanted in (rows.where("a in (0, 300, 5997)"), rows.where("a = 1"), rows.where("a < 90"), rows):
        keys = wanted.select("b", "a")
        got = t.read_keys(keys)
        assert values(got, "a", "b", "at") == values(t.read().join(keys.distinct(), ["a", "b"], "left_semi"), "a", "b", "at")
    assert present >= 40 and sum(map(len, t.files_of(rows.where("a = 5997")).values())) <= 3
    assert t.files_of(spark.createDataFrame([(1, "k1"), (None, "k0")], "a int, b string")) == {} or present > 40
    assert t.mark("at") == 1000 and t.mark("a") == 11997
    assert table(spark).read_keys(rows) is None


def test_marks_of_each_type(spark):
    t = table(spark, cursors=("d", "s", "n", "x", "absent"))
    assert t.read() is None
    row = spark.sql("select 1 as k, date'2026-01-02' as d, timestamp_ntz'2026-01-02 03:04:05.000006' as s, cast(1.5 as decimal(5,2)) as n, 'b' as x")
    t.upsert(row, ["k"], "a")
    t.upsert(row.where("k = 0"), ["k"], "empty")
    assert (t.mark("d"), t.mark("s"), t.mark("n"), t.mark("x")) == (dt.date(2026, 1, 2), dt.datetime(2026, 1, 2, 3, 4, 5, 6), Decimal("1.50"), "b")


def test_checkpoints_and_vacuum_lose_nothing(spark):
    t = table(spark, buckets=2, checkpoint_every=4, fold=0.5)
    for i in range(11):
        t.upsert(spark.createDataFrame([(k, i) for k in range(i, i + 4)], "k long, v long"), ["k"], f"r{i}")
    want = {k: min(k, 10) for k in range(14)}
    assert {r["k"]: r["v"] for r in t.read().collect()} == want
    assert all(t.has_run(f"r{i}") for i in range(11)) and not t.has_run("r11")
    n = t.log().count()
    assert versions.numbered_files(spark, f"{t.path}/checkpoint")
    assert t.vacuum() == []  # nothing is old enough
    assert t.vacuum(older_than=dt.timedelta(0))
    assert {r["k"]: r["v"] for r in t.read().collect()} == want and t.log().count() == n and t.has_run("r0")
    t.upsert(spark.createDataFrame([(0, 99)], "k long, v long"), ["k"], "after")
    assert {r["k"]: r["v"] for r in t.read().collect()} == want | {0: 99}


def test_small_files_are_written_once(spark):
    folder = work_folder(spark, "once")
    assert versions.create_once(spark, f"{folder}/{1:012d}.json", "{}") and not versions.create_once(spark, f"{folder}/{1:012d}.json", "[]")
    assert versions.read_json(spark, f"{folder}/{1:012d}.json") == {} and list(versions.numbered_files(spark, folder)) == [1]


def test_upsert_reads_nothing_of_the_table(spark):
    """A delta's commit leaves the base's files as they are."""
    t = table(spark, buckets=2)
    t.upsert(spark.range(100).withColumn("v", F.lit(0)), ["id"], "base")
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").json(f"{t.path}/version=1")  # now unreadable as it was
    t.upsert(spark.createDataFrame([(3, 1)], "id long, v int"), ["id"], "delta", compact=False)
    assert t.state().deltas[0]["rows"] == 1


# --- runs


def test_a_failed_run_is_read_again_and_a_completed_one_is_not(spark):
    from tidemark import contracts

    root = work_folder(spark, "runs")
    rows = spark.createDataFrame([(i, i * 10, 1, 2, Decimal("3.00")) for i in range(5)], "id long, order_id long, product_id long, quantity int, unit_price decimal(12,2)")
    bad = rows.withColumn("quantity", F.expr("if(id >= 0, raise_error('lost'), 1)").cast("int"))
    states = [ingestion.run_sources(spark, [(contracts.ORDER_ITEMS, df)], root, "r").first()["status"] for df in (bad, rows, rows.limit(0))]
    assert states == ["failed", "completed", "completed"]
    paths = [r["path"] for r in spark.read.parquet(f"{root}/history/paths").collect()]
    assert len(paths) == 1 and spark.read.parquet(*paths).count() == 5
    assert merge.VersionedTable(spark, f"{root}/tables/order_items").read().count() == 5


def test_folders_of_past_days_are_not_listed(spark):
    import os

    root = work_folder(spark, "days").replace("file://", "")
    for name in ("2026-01-01/deep", "day=20260102", "20260103", "other"):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/a_2026010{1 if 'deep' in name else 2 if 'day' in name else 3}_000000.csv", "w") as f:
            f.write("x")
    assert [p.rpartition("/")[2] for p in files.dated_folders(spark, root, "20260102_000000")] == ["20260103", "day=20260102", "other"]
    assert files.dated_files(spark, root).count() == 4 and files.dated_files(spark, root, "20260103_120000").count() == 2
    assert files.dated_files(spark, f"{root}/none").count() == 0


def test_a_contract_prepares_its_own_dataset(spark):
    from dataclasses import replace

    from tidemark import contracts
    from tidemark.operators import clean

    own = replace(contracts.ORDER_ITEMS, prepare=lambda df: df.withColumn("quantity", F.col("quantity") * 2))
    rows = spark.createDataFrame([(1, 1, 1, 4, 2.0)], "id long, order_id long, product_id long, quantity int, unit_price double")
    assert clean.process(rows, own).first()["quantity"] == 8


def test_snapshots_replace_by_their_difference(spark):
    t = table(spark, buckets=16)
    first = spark.createDataFrame([(i, "x") for i in range(40)] + [(None, "n")], "k long, v string")
    kinds = lambda df: {r["kind"]: r["n_keys"] for r in df.collect()}
    assert kinds(t.replace(first, ["k"], "a")) == {"inserted": 41, "updated": 0, "deleted": 0, "unchanged": 0}
    t.upsert(spark.createDataFrame([(3, "delta"), (50, "delta")], "k long, v string"), ["k"], "b", compact=False)
    second = spark.createDataFrame([(i, "x" if i != 7 else "y") for i in range(1, 40)] + [(None, "n"), (60, "z")], "k int, v string")
    assert kinds(t.replace(second, ["k"], "c")) == {"inserted": 1, "updated": 2, "deleted": 2, "unchanged": 38}
    assert values(t.read(), "k", "v") == values(second, "k", "v")
    changed = t.log().where("run_id = 'c'").first()["changed"]
    assert 1 <= len(changed) <= 6
    assert kinds(t.replace(second, ["k"], "d")) == {"inserted": 0, "updated": 0, "deleted": 0, "unchanged": 41} and t.has_run("d")
    assert kinds(t.replace(second.limit(0), ["k"], "e"))["deleted"] == 41 and t.read().count() == 0
    assert kinds(t.replace(first.withColumn("more", F.lit(1)), ["k"], "f"))["inserted"] == 41 and t.read().columns == ["k", "v", "more"]


def test_a_bucket_that_two_snapshots_change_is_a_conflict(spark):
    t = table(spark, buckets=1)
    t.replace(spark.range(5), ["id"], "a")
    slow = versions.VersionedTable(spark, t.path)
    commit = slow._commit
    slow._commit = lambda entry, seen: (t.upsert(spark.range(7, 8), ["id"], "b"), commit(entry, seen))[1]
    with pytest.raises(versions.CommitConflict):
        slow.replace(spark.range(3), ["id"], "c")
    assert values(t.read(), "id") == [(0,), (1,), (2,), (3,), (4,), (7,)]


def test_a_snapshot_with_changes_in_all_buckets_leaves_the_other_rows_unwritten(spark):
    t = table(spark, buckets=16, fan=2)
    first = spark.range(4000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    kinds = lambda df: {r["kind"]: r["n_keys"] for r in df.collect()}
    t.replace(first, ["k"], "a")
    second = first.where("k % 50 <> 1").withColumn("v", F.when(F.col("k") % 60 == 2, "y").otherwise(F.col("v"))).unionByName(first.where("k % 70 = 3").withColumn("k", -F.col("k")))
    assert kinds(t.replace(second, ["k"], "b")) == {"inserted": 58, "updated": 67, "deleted": 80, "unchanged": 3853}
    log = t.log().where("run_id = 'b'").first()
    assert len(log["changed"]) == 16 and log["rows"] == 58 + 67 + 80
    assert values(t.read(), "k", "v") == values(second, "k", "v") and t.read().columns == ["k", "v"]
    wanted = spark.createDataFrame([(1,), (2,), (-3,), (4,)], "k long")
    assert values(t.read_keys(wanted), "k", "v") == [(-3, "x"), (2, "y"), (4, "x")]
    assert t.read_keys(wanted.where("k = 1")).columns == ["k", "v"] and t.read_keys(wanted.where("k = 1")).count() == 0
    # a deleted key comes again, and deltas are folded with their deletions in them
    third = second.where("k <> 9").unionByName(first.where("k = 51"))
    assert kinds(t.replace(third, ["k"], "c")) == {"inserted": 1, "updated": 0, "deleted": 1, "unchanged": 3977}
    assert t.upsert(first.where("k = 101"), ["k"], "d", compact=False) and t.compact() and len(t.state().deltas) == 2
    fourth = third.unionByName(first.where("k = 101"))
    assert values(t.read(), "k", "v") == values(fourth, "k", "v")
    assert t.compact(everything=True) and not t.state().deltas and values(t.read(), "k", "v") == values(fourth, "k", "v")


def test_a_snapshot_whose_changed_keys_are_null_or_repeat(spark):
    t = table(spark, buckets=4)
    rows = lambda extra: spark.createDataFrame([(i, i % 3, "x") for i in range(200)] + extra, "a int, kind int, v string")
    kinds = lambda df: {r["kind"]: r["n_keys"] for r in df.collect()}
    first, second, third = rows([(None, 1, "n"), (500, 1, "p"), (500, 1, "q")]), rows([(None, 1, "m"), (500, 1, "p"), (500, 1, "q")]), rows([(None, 1, "m"), (500, 1, "p"), (500, 1, "r"), (500, 1, "r")])
    t.replace(first, ["a", "kind"], "a")
    assert kinds(t.replace(second, ["a", "kind"], "b")) == {"inserted": 0, "updated": 1, "deleted": 0, "unchanged": 201}
    assert values(t.read(), "a", "kind", "v") == values(second, "a", "kind", "v")
    assert kinds(t.replace(third, ["a", "kind"], "c")) == {"inserted": 0, "updated": 1, "deleted": 0, "unchanged": 201} and t.log().where("run_id = 'c'").first()["rows"] == 3
    assert values(t.read(), "a", "kind", "v") == values(third, "a", "kind", "v")
