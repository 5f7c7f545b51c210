"""File streams: each file once, batches loaded by keyed upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.expressions import ts
from tidemark.operators.dedupe import keep_last
from tidemark.operators.versions import CommitConflict, VersionedTable
from tidemark.sources.files import LEADS_TEXT, number_lines, parse_weblogs, raw_lines
from tidemark.sources.workdir import staged


def stream_leads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New lead files as text columns; the query's checkpoint is the file cursor."""
    return spark.readStream.schema(LEADS_TEXT).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path).select("*", F.col("_metadata.file_path").alias("_source_file"))


def stream_weblogs(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New log lines (raw, file, start); a file comes in one batch, where its lines are numbered and parsed."""
    return raw_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def parsed_weblogs(lines: DataFrame, run_id: str, ingested_at: str) -> DataFrame:
    """Good log rows of a batch; lines without an id get one from file and line number, as in batch reading."""
    return parse_weblogs(number_lines(lines), run_id, ingested_at).where(~F.col("_bad")).drop("_bad")


def count_bad_lines(path: str) -> Callable[[DataFrame, str], None]:
    """An audit of log batches: lines and bad lines by file, under ``path``; a repeated batch replaces its own counts."""

    def audit(batch: DataFrame, run_id: str) -> None:
        rows = parse_weblogs(number_lines(batch), run_id, "")
        counts = rows.groupBy("_source_file").agg(F.count("*").alias("n_lines"), F.sum(F.col("_bad").cast("long")).alias("n_bad"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={run_id.replace('/', '-')}")

    return audit


def after_mark(column: str, inclusive: bool = False) -> Callable[[DataFrame, DataFrame | VersionedTable], DataFrame]:
    """The late-data policy of a cursor: rows from the table's high-water mark on; exclusive, ties at the mark are late, too.

    The mark of a versioned table that keeps the cursor is read from its log. Late rows, and
    rows without a value, are left out; all rows of the first batch are taken.
    """

    def late(rows: DataFrame, current: DataFrame | VersionedTable) -> DataFrame:
        mark = current.agg(F.max(column)).first()[0] if isinstance(current, DataFrame) else current.mark(column)
        if mark is None:
            return rows
        at = ts(str(mark)) if hasattr(mark, "isoformat") else F.lit(mark)
        return rows.where(F.col(column) >= at if inclusive else F.col(column) > at)

    return late


def upsert_stream(
    stream: DataFrame, table: VersionedTable, keys: list[str], prepare: Callable[[DataFrame], DataFrame], order: list[str], checkpoint: str,
    late: Callable[[DataFrame, VersionedTable], DataFrame] | None = None, audit: Callable[[DataFrame, str], None] | None = None,
) -> StreamingQuery:
    """Loads all files there are, then ends. A batch that is repeated is skipped: its run id is in the table's log.

    The run id is the id of the query, which its checkpoint keeps, with the batch's number:
    several streams may load one table, also at once, and a new checkpoint starts anew. In
    a batch the newest row of a key counts; between batches the newest by ``order`` does,
    too, so a late older row doesn't replace a newer one: a batch reads the table's files
    that may hold its keys, and is held again if another writer changed these meanwhile.
    ``late`` picks the batch's rows that the table takes, given the table; ``audit`` gets
    each batch before it is loaded.
    """
    spark = stream.sparkSession

    def load(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{spark.read.json(f'{checkpoint}/metadata').first()['id']}/{batch_id}"
        if table.has_run(run_id):
            return
        if audit:
            audit(batch, run_id)
        rows = staged(keep_last(prepare(batch), keys, order), "batch")
        for attempt in range(10):
            version, own = table.version() or 0, rows
            if version:
                own = late(rows, table) if late else rows
                older = table.read_keys(own.select(*keys))
                own = staged(keep_last(older.unionByName(own, allowMissingColumns=True), keys, order), "batch")
            try:
                table.upsert(own, keys, run_id, expected=version)
                return
            except CommitConflict:
                if attempt == 9:
                    raise

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_event_dedupe(stream: DataFrame, time: str = "event_ts", delay: str = "1 hour", key: str = "event_id") -> DataFrame:
    """One row of each event within the delay: the first to arrive, where the batch rule keeps the newest."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
