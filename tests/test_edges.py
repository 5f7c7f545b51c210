"""Hand-made rows for the rules that the driver's tables don't exercise."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Observation
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import contracts
from tidemark.functions import expressions as X
from tidemark.operators import clean, dedupe, merge, quality, rules, runlog
from tidemark.plans import marts, reports
from tidemark.sources import extract, files
from tidemark.sources.workdir import work_folder
from tidemark.streaming import ingest

D = dt.datetime


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_timestamps_in_text(spark):
    texts = ["2026-03-31 11:57:44.123456", "2026-03-31T10:51:07", " 2026-03-31T10:51:07Z ", "2026-03-31 10:51:07+02:00", "2026-03-31", "soon", "", None, "2026-02-31 10:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.parse_ts_lenient("t"), X.parse_ts_lenient("t", normalize_utc=True))
    got = {i: (a, b) for i, a, b in rows(df)}
    assert got[0][0] == D(2026, 3, 31, 11, 57, 44, 123456)
    assert got[1][0] == got[2][0] == got[3][0] == D(2026, 3, 31, 10, 51, 7)
    assert got[3][1] == D(2026, 3, 31, 8, 51, 7) and got[2][1] == got[2][0]
    assert all(got[i][0] is None for i in range(4, 9))


def test_clean_leads_aligns_filters_and_dedupes(spark):
    cols = "lead_id string, created_at string, company_name string, is_prospect string, industry string, contact_name string, contact_email string, lead_source string, estimated_annual_revenue string, country_code string, status string, status_updated_at string, surplus string, _extra string"
    base = ("2026-01-01 00:00:00", "Acme", "true", "x", "n", "e", "Webinar", "10.5", "ar", "New")
    data = [("a", *base, "2026-01-01 00:00:00", "s", "e1"), ("a", *base, "2026-01-02 00:00:00", "s", "e2"), ("a", *base, None, "s", "e3"), (None, *base, None, "s", "e4"), ("b", *base[:7], "many", *base[8:], None, "s", "e5")]
    seen = Observation()
    out = clean.process(spark.createDataFrame(data, cols), contracts.MARKETING_LEADS, bad=seen)
    got = out.collect()
    assert [(r["lead_id"], r["_extra"], r["country_code"], r["is_prospect"]) for r in got] == [("a", "e2", "AR", True)]
    assert "surplus" not in out.columns and out.columns[: len(contracts.MARKETING_LEADS.schema)] == contracts.MARKETING_LEADS.schema.fieldNames()
    assert seen.get == {"n_rows": 5, "n_bad": 2}


def test_dedupe_scope_nulls_and_partitioning(spark):
    df = spark.createDataFrame([("k", None, "f1", 1), ("k", 5, "f1", 2), ("k", 5, "f2", 3), (None, 1, "f1", 4), (None, 2, "f1", 5)], "k string, o int, f string, v int")
    assert {r["v"] for r in dedupe.keep_last(df, ["k"], ["o"], "f").collect()} == {2, 3, 5}
    once = [rows(dedupe.keep_last(df.repartition(n), ["k"], ["o"])) for n in (1, 3)]
    assert once[0] == once[1] and {r[3] for r in once[0]} == {3, 5}
    assert dedupe.keep_last(df.limit(0), ["k"], ["o"]).count() == 0


def test_weblog_lines(spark):
    path = work_folder(spark, "lines").replace("file://", "")
    import os

    os.makedirs(path)
    with open(f"{path}/access_20260101_000000.jsonl", "wb") as f:
        f.write(b'{"event_id":"a","timestamp":"2026-01-01T00:00:00","status_code":200}\n\n  \n{"broken\n[1]\n{"username":"u"}\n{"event_id":"","user_agent":"\xff"}\n{"event_id":"z"}')
    seen = Observation()
    got = {r["_source_line"]: r for r in files.scan_weblogs_jsonl(spark, [path], "r", "t", seen).collect()}
    assert sorted(got) == [0, 5, 6, 7] and got[0]["event_id"] == "a" and got[7]["event_id"] == "z"
    assert got[5]["event_id"].endswith("access_20260101_000000.jsonl:5") and got[6]["user_agent"] == "�"
    assert seen.get == {"n_lines": 6, "n_bad": 2}
    listed = files.glob_sources(spark, [f"{path}/*", f"{path}/*.jsonl"]).collect()
    assert [r["file_ts"] for r in listed] == ["20260101_000000"]


def test_line_numbers_across_splits(spark):
    path = work_folder(spark, "splits").replace("file://", "")
    import os

    os.makedirs(path)
    for name, n in (("a.txt", 3000), ("b.txt", 10)):
        with open(f"{path}/{name}", "w") as f:
            f.write("".join(f"{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        wrong = files.numbered_lines(spark, [path]).where(F.col("raw").cast("string").cast("long") != F.col("line")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert wrong == 0


def test_new_files(spark):
    paths = ["/d/daily/a_20260101_000000.csv", "/d/daily/b_20260101_000000.csv", "/d/seed/a_20260102_000000.csv", "/d/daily/a_20251231_000000.csv", "/d/zz.csv", "/d/aa.csv", "/d/daily/a_20260101_000000.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").distinct().withColumn("file_ts", files.file_ts_key("path"))
    got = {r["path"] for r in files.new_files(df, "/d/daily/a_20260101_000000.csv", "20260101_000000").collect()}
    assert got == {"/d/daily/b_20260101_000000.csv", "/d/seed/a_20260102_000000.csv", "/d/zz.csv"}
    assert files.new_files(df, None, None).count() == df.count()


def test_windows_of_a_cursor(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, D(2026, 1, 1), D(2026, 1, 2), D(2026, 1, 3)])], "i int, at timestamp_ntz")
    assert [r["i"] for r in extract.scan_incremental_timestamp(df, "at", D(2026, 1, 2), D(2026, 1, 1)).collect()] == [2]
    assert [r["i"] for r in extract.scan_incremental_timestamp(df, "at", D(2026, 1, 2)).collect()] == [1, 2]
    assert extract.scan_incremental_timestamp(df, "at", None).count() == 0
    assert extract.next_watermark(None, 7) == 7


def test_upsert_null_keys_and_new_columns(spark):
    target = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    source = spark.createDataFrame([(9, "a", "x"), (8, None, "y")], "v int, k string, extra string")
    out = {(r["k"], r["v"], r["extra"]) for r in merge.upsert(target, source, ["k"]).collect()}
    assert out == {("a", 9, "x"), (None, 8, "y"), (None, 2, None), ("b", 3, None)}
    files_ = spark.createDataFrame([("a", 5, "f2"), ("a", 6, "f1"), (None, 7, "f1")], "k string, v int, _source_file string")
    got = {(r["k"], r["v"]) for r in merge.upsert_files(files_.limit(0), files_, ["k"]).collect()}
    assert got == {("a", 5), (None, 7)}
    newest = {(r["k"], r["v"]) for r in merge.upsert_files(files_.limit(0), files_, ["k"], newest=[F.desc("v")]).collect()}
    assert newest == {("a", 6), (None, 7)}


def test_snapshot_only_after_a_completed_capture(spark):
    target = spark.createDataFrame([("a",)], "k string")
    assert merge.replace_snapshot(target, target.limit(0)).count() == 0
    assert merge.replace_snapshot(target, target.limit(0), "failed").count() == 1


def test_versions_switch_after_the_write(spark):
    t = merge.VersionedTable(spark, work_folder(spark, "versions"))
    assert t.read() is None
    t.write(spark.range(3), "r1")
    spark.range(9).write.parquet(f"{t.path}/version=2")  # a write that never was committed
    assert t.read().count() == 3
    t.write(spark.range(5), "r2")
    assert t.read().count() == 5 and t.version() == 2


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark):
    t = merge.VersionedTable(spark, work_folder(spark, "buckets"), buckets=8)
    t.upsert(spark.range(100).withColumn("v", F.lit("a")), ["id"], "r1")
    t.upsert(spark.createDataFrame([(3, "b"), (200, "b")], "id long, v string"), ["id"], "r2")
    changed = t.log().where("run_id = 'r2'").first()["changed"]
    assert 1 <= len(changed) <= 2
    assert {r["__bucket"] for r in spark.read.parquet(f"{t.path}/version=2").select("__bucket").distinct().collect()} == set(changed)
    want = {i: "b" if i in (3, 200) else "a" for i in [*range(100), 200]}
    assert {r["id"]: r["v"] for r in t.read().collect()} == want
    t.upsert(spark.createDataFrame([], "id long, v string"), ["id"], "r3")
    assert t.has_run("r3") and {r["id"]: r["v"] for r in t.read().collect()} == want
    t.upsert(spark.createDataFrame([(3, "c", 1.5), (None, "n", None)], "id long, v string, more double"), ["id"], "r4")  # a new column, a null key
    got = t.read()
    assert got.columns == ["id", "v", "more"] and got.count() == 102
    assert got.where("id = 3").first()["more"] == 1.5 and got.where("id = 4").first()["more"] is None
    t.upsert(spark.createDataFrame([(9, "a", 0.0)], "id long, v string, more double"), ["v"], "r5")  # another key: written whole
    assert {r["v"] for r in t.read().collect()} == {"a", "b", "c", "n"} and t.read().where("v = 'a'").count() == 1
    t.write(t.read().limit(0), "r6", ["v"])
    assert t.read().count() == 0


def test_log_lines_of_a_stream_keep_their_numbers(spark):
    path, state = work_folder(spark, "equal-lines"), work_folder(spark, "state")
    spark.createDataFrame([("{}",), ("{}",), ("{}",), ("no",)], "value string").coalesce(1).write.text(path)
    t = merge.VersionedTable(spark, work_folder(spark, "equal-table"))
    for _ in range(2):  # the second run finds no new file
        ingest.upsert_stream(ingest.stream_weblogs(spark, path), t, ["event_id"], lambda b: ingest.parsed_weblogs(b, "r", "").select("event_id", "event_ts"), ["event_ts"], state).awaitTermination()
    assert t.read().count() == 3 and t.version() == 1


def test_late_rows_by_either_policy(spark):
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, None), (4, 8)], "id int, at int")
    current = spark.createDataFrame([(9, 7)], "id int, at int")
    assert [r["id"] for r in ingest.after_mark("at")(rows, current).collect()] == [4]
    assert [r["id"] for r in ingest.after_mark("at", inclusive=True)(rows, current).collect()] == [2, 4]
    assert ingest.after_mark("at")(rows, current.limit(0)).count() == 4


def test_work_folder_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    with pytest.raises(ValueError):
        work_folder(type("Session", (), {"conf": Conf()})(), "x")


def test_incremental_equals_full_on_slices(spark):
    old = spark.createDataFrame([(1, D(2026, 1, 1), "x"), (2, D(2026, 1, 2), "x")], "id int, at timestamp_ntz, v string")
    new = spark.createDataFrame([(1, D(2026, 1, 1), "x"), (2, D(2026, 1, 2), "tie"), (3, D(2026, 1, 3), "x"), (0, D(2025, 1, 1), "late")], "id int, at timestamp_ntz, v string")
    cursor = F.col("at")
    inclusive = merge.incremental_merge(old, new, ["id"], lambda d: d, cursor=cursor, target_cursor=cursor)
    exclusive = merge.incremental_merge(old, new, ["id"], lambda d: d, cursor=cursor, target_cursor=cursor, inclusive=False)
    assert {(r["id"], r["v"]) for r in inclusive.collect()} == {(1, "x"), (2, "tie"), (3, "x")}
    assert {(r["id"], r["v"]) for r in exclusive.collect()} == {(1, "x"), (2, "x"), (3, "x")}
    empty = merge.incremental_merge(old.limit(0), new, ["id"], lambda d: d, cursor=cursor, target_cursor=cursor, floor="1900-01-01 00:00:00")
    assert empty.count() == 4
    again = merge.incremental_merge(inclusive, new, ["id"], lambda d: d, cursor=cursor, target_cursor=cursor)
    assert rows(again) == rows(inclusive)


def test_companies_by_name(spark):
    df = spark.createDataFrame([("s", "Acme", "Supplier", D(2027, 1, 1), None), ("c1", "ACME", "Client", D(2026, 1, 1), None), ("c2", "acme", "Client", None, None)], "company_cuit string, company_name string, company_type string, updated_at timestamp_ntz, created_at timestamp_ntz")
    assert [(r["name_key"], r["company_cuit"]) for r in marts.company_by_name(df).collect()] == [("acme", "c1")]


def test_device_families_and_status_classes(spark):
    agents = {"Googlebot/2.1": "Bot/Crawler", "Mozilla (iPhone; like Mac OS X)": "iPhone", "Mozilla (Linux; Android 14)": "Android", "iPad": "Tablet", "Windows NT": "Windows Desktop", "Mac OS X": "Mac Desktop", "X11; Linux": "Linux Desktop", "curl": "Other", "-": "Unknown", "": "Unknown", None: "Unknown"}
    df = spark.createDataFrame([(a,) for a in agents], "a string").select("a", X.device_family("a").alias("f"))
    assert {r["a"]: r["f"] for r in df.collect()} == agents
    codes = {99: "other", 199: "other", 200: "2xx", 299: "2xx", 300: "3xx", 404: "4xx", 500: "5xx", 599: "5xx", 600: "other", None: "other"}
    df = spark.createDataFrame([(c,) for c in codes], "c int").select("c", X.status_class("c").alias("s"), X.is_error("c").alias("e"))
    got = df.collect()
    assert {r["c"]: r["s"] for r in got} == codes and {r["c"]: r["e"] for r in got}[None] is False and {r["c"]: r["e"] for r in got}[600] is True


def test_calendar_without_dates(spark):
    empty = spark.createDataFrame([], "at timestamp_ntz")
    out = marts.dim_datetime([(empty, "at"), (empty, "at")], F.lit("2026-06-15"))
    assert out.count() == 731
    r = out.where("date_key = 20260615").first()
    assert (r["iso_day_of_week"], r["is_weekend"], r["month_name"], r["day_end_ts"]) == (1, False, "June", D(2026, 6, 15, 23, 59, 59))


def test_monthly_sales_drops_or_keeps_empty_months(spark):
    df = spark.createDataFrame([(dt.date(2026, 6, 1), "COMPLETED", 10.0), (dt.date(2026, 5, 1), "RETURNED", 3.0)], "order_date date, order_status string, order_total double")
    assert reports.monthly_sales(df, F.lit("2026-06-15")).count() == 1
    assert reports.monthly_sales(df, F.lit("2026-06-15"), keep_empty=True).count() == 12


def test_quality_checks_find_each_fault(spark):
    c = spark.createDataFrame([("a", "Client"), ("b", "Odd"), ("b", None), (None, "Client")], "cuit string, type string")
    assert quality.not_null(c, "cuit").count() == 1 and quality.unique(c, "cuit").count() == 1
    assert quality.accepted_values(c, "type", quality.COMPANY_TYPES).count() == 1 and quality.accepted_values(c, "type", quality.COMPANY_TYPES, True).count() == 2
    child = spark.createDataFrame([("a",), ("z",), (None,)], "fk string")
    assert quality.relationships(child, ["fk"], c, ["cuit"]).count() == 1 and quality.missing_or_wrong(child, "fk", c, "cuit").count() == 2
    assert quality.missing_tables({"orders": c}, ("orders", "items")) == ["items"]


def test_lead_rules(spark):
    at = X.ts("2026-01-10 00:00:00")
    schema = "lead_id string, company_name string, contact_name string, contact_email string, contact_phone string, is_prospect boolean, status string, lead_source string, estimated_annual_revenue double, country_code string, created_at timestamp_ntz, status_updated_at timestamp_ntz, last_activity_at timestamp_ntz"
    data = [
        ("1", " ACME ", "Ann, Lee Roe", "x@e.com", " 1 ", True, "New", "Referral", 500000.0, "ar", D(2026, 1, 9), None, None),
        ("2", "Nobody", "Bo", "X@e.com", "", False, "Lost", None, None, None, None, None, None),
        ("3", "Twice", None, None, None, True, "Qualified", "other", -5.0, "us", D(2025, 1, 1), None, None),
    ]
    leads = spark.createDataFrame(data, schema)
    companies = spark.createDataFrame([("c1", "Acme", "Client", "ar"), ("c2", "twice", "Client", "us"), ("c3", "Twice ", "Client", "us")], "cuit string, name string, type string, country_code string")
    assert {r["name_key"] for r in rules.name_index(companies).collect()} == {"acme"}
    assert [r["lead_id"] for r in rules.lead_candidates(leads, at).collect()] == ["1"]
    score = {r["lead_id"]: r["s"] for r in leads.select("lead_id", rules.lead_score(at).alias("s")).collect()}
    assert abs(score["1"] - 0.002 * 1.35 * 1.1 * 1.15) < 1e-12 and score["2"] == 0.0 and abs(score["3"] - 0.03 * 0.8 * 0.55) < 1e-12
    made = {r["lead_id"]: r for r in rules.customers_from_leads(leads, spark.createDataFrame([("q@e.com",)], "email string")).collect()}
    assert (made["1"]["first_name"], made["1"]["last_name"], made["1"]["phone_number"], made["1"]["email"]) == ("Ann", "Lee Roe", "1", "x@e.com")
    assert (made["2"]["first_name"], made["2"]["last_name"], made["2"]["email"]) == ("Bo", None, None) and made["3"]["first_name"] is None
    again = {r["lead_id"]: r for r in rules.lead_reconcile(leads, companies, at).collect()}
    assert (again["1"]["status"], again["1"]["company_name"], again["1"]["is_prospect"], again["1"]["status_updated_at"]) == ("Converted", "Acme", False, D(2026, 1, 10))
    assert again["2"]["status"] == "Lost" and again["3"]["status"] == "Qualified"
    ledger = spark.createDataFrame([("1", D(2026, 1, 1))], "lead_id string, converted_at timestamp_ntz")
    new = spark.createDataFrame([("1", None, "c"), ("2", D(2026, 1, 3), "c"), ("2", D(2026, 1, 2), "c")], "lead_id string, converted_at timestamp_ntz, company_cuit string")
    one = rules.append_conversions(ledger, new)
    assert one.count() == 2 and rules.append_conversions(one, new).count() == 2


def test_trade_lanes_and_cohorts(spark):
    df = spark.createDataFrame([("US", "us"), ("US", "BR"), ("US", "CN"), (None, "ZZ"), ("", "US")], "a string, b string").select(X.trade_lane("a", "b"))
    assert [r[0] for r in df.collect()] == ["domestic", "regional", "global", "regional", "global"]
    df = spark.createDataFrame([(D(2026, 1, 9),), (D(2020, 1, 1),), (None,)], "at timestamp_ntz").select(X.user_cohort("at", X.ts("2026-01-10 00:00:00"), 7))
    assert [r[0] for r in df.collect()] == ["new", "returning", "returning"]


def test_run_history(spark):
    at = [D(2026, 1, 1, i) for i in range(3)]
    runs = runlog.run_row(spark, "r1", "db", "orders", "raw", "started", at[0]).unionAll(runlog.run_row(spark, "r1", "db", "orders", "raw", "completed", at[1], records=5)).unionAll(runlog.run_row(spark, "r2", "db", "items", "raw", "failed", at[2], error="x"))
    marks = spark.createDataFrame([("db", "orders", "raw", "r1", "7", at[1]), ("db", "items", "raw", "r2", "8", at[2])], runlog.WATERMARKS)
    assert [(r["dataset"], r["records"]) for r in runlog.latest_completed_manifest(runs, marks).collect()] == [("orders", 5)]
    assert runlog.require_coherence(runs, warn_only=True) is False
    snap = runlog.schema_snapshot(runs.limit(0), 0)
    assert snap.count() == len(runs.columns)
    assert isinstance(runs.schema["records"].dataType, T.LongType)
