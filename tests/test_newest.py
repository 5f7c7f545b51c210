"""The newest row of each key in a stream: a table as the state, and the stateful operator for other sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.versions import VersionedTable
from tidemark.sources.workdir import work_folder
from tidemark.streaming import newest

SCHEMA = "k string, at timestamp, v int"


def _rows(spark, *rows):
    day = dt.datetime(2026, 1, 10)
    return spark.createDataFrame([(k, None if h is None else day + dt.timedelta(hours=h), v) for k, h, v in rows], SCHEMA)


def test_batches_are_held_against_the_table(spark):
    path, checkpoint = work_folder(spark, "in"), work_folder(spark, "state")
    t = VersionedTable(spark, work_folder(spark, "table"), cursors=("at",))

    def send(*rows):
        _rows(spark, *rows).write.mode("append").parquet(path)
        query = newest.upsert_newest(spark.readStream.schema(SCHEMA).parquet(path), t, "k", "at", checkpoint, dt.timedelta(hours=10))
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]  # no state of keys beside the table, and no row through Python
        return sorted((r["k"], r["h"], r["v"]) for r in t.read().select("k", F.timestamp_diff("HOUR", F.lit("2026-01-10").cast("timestamp"), "at").alias("h"), "v").collect())

    assert send(("a", 1, 1), ("a", 3, 2), ("b", 2, 1), (None, 5, 1), ("c", None, 1), ("d", 20, 1)) == [("a", 3, 2), ("b", 2, 1), ("d", 20, 1)]
    # b is older, d's row of the same time is larger, e is 10 hours before d and so is too late, f isn't yet
    assert send(("b", 1, 9), ("d", 20, 2), ("e", 10, 1), ("f", 11, 1), ("a", 30, None)) == [("a", 30, None), ("b", 2, 1), ("d", 20, 2), ("f", 11, 1)]
    # a row of the same time with a value comes after the one without; the smaller one doesn't
    assert send(("a", 30, 0), ("d", 20, 1)) == [("a", 30, 0), ("b", 2, 1), ("d", 20, 2)] + [("f", 11, 1)]


def test_the_stateful_operator_emits_newer_rows(spark):
    path, checkpoint, out = (work_folder(spark, n) for n in ("in", "state", "out"))
    for rows in ([("a", 1, 1), ("a", 3, 2), ("b", 2, 1)], [("a", 2, 9), ("b", 4, 2)]):
        _rows(spark, *rows).write.mode("append").parquet(path)
        stream = newest.newest_events(spark.readStream.schema(SCHEMA).parquet(path), "k", "at", dt.timedelta(days=1))
        stream.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 1), ("b", 2)]
