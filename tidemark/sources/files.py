"""File sources: leads as CSV, access logs as JSON lines; file cursors; partitioned Parquet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col, stripped
from tidemark.operators.clean import add_provenance

#: Fixed value: files without a time in their name sort last.
NO_TS = "99999999_999999"

LEADS_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in (
    "lead_id", "created_at", "company_name", "is_prospect", "industry", "contact_name", "contact_email", "contact_phone", "lead_source",
    "estimated_annual_revenue", "country_code", "status", "status_updated_at", "last_activity_at",
)])
LOG_LINE = "event_id string, remote_host string, username string, timestamp string, user_agent string, request_path string, status_code string, _corrupt string"


def file_ts_key(path: Column | str) -> Column:
    """The time in a file's base name, yyyymmdd_hhmmss; files without one sort last."""
    base = F.substring_index(col(path), "/", -1)
    return F.coalesce(F.nullif(F.regexp_extract(base, r"\d{8}_\d{6}", 0), F.lit("")), F.lit(NO_TS))


def glob_sources(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Distinct files (path, file_ts) of all patterns; contents aren't read. No match gives no row."""
    found = None
    for p in patterns:
        try:
            own = spark.read.format("binaryFile").load(p).select("path")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = own if found is None else found.unionAll(own)
    if found is None:
        found = spark.createDataFrame([], "path string")
    return found.distinct().withColumn("file_ts", file_ts_key("path"))


def dated_folders(spark: SparkSession, root: str, since: str | None = None) -> list[str]:
    """The folders under ``root`` that may hold files from ``since`` (a time as in file names) on.

    A folder named by a day (yyyymmdd, yyyy-mm-dd, or such a day after =) before that of
    ``since`` is left out; folders of other names always stay. Only ``root`` itself is
    listed here: a name for each day.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(place) if fs.exists(place) else []:
        name = s.getPath().getName()
        day = re.fullmatch(r"(?:[^=]*=)?(\d{4})-?(\d{2})-?(\d{2})", name)
        if s.isDirectory() and not name.startswith(("_", ".")) and not (day and since and since != NO_TS and "".join(day.groups()) < since[:8]):
            found.append(s.getPath().toString())
    return sorted(found)


def dated_files(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Files (path, file_ts) in the folders of ``dated_folders``, at any depth; those of earlier days aren't listed.

    Spark lists many folders in tasks (``spark.sql.sources.parallelPartitionDiscovery.threshold``),
    so a run's listing grows with its new folders and not with all that there ever were.
    """
    folders = dated_folders(spark, root, since)
    if not folders:
        return spark.createDataFrame([], "path string, file_ts string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
    return listed.select("path").withColumn("file_ts", file_ts_key("path"))


def new_files(files: DataFrame, last_path: str | None, last_ts: str | None) -> DataFrame:
    """Files after the cursor: a later time, or the same time and a greater base name or path in its folder.

    Without a last file all are new; a file or a cursor without a time is held against the
    last path alone.
    """
    if last_path is None:
        return files
    base = F.substring_index("path", "/", -1)
    last_base, last_folder = last_path.rpartition("/")[2], last_path.rpartition("/")[0]
    same_folder = F.substring_index("path", "/", last_path.count("/")) == last_folder
    after = F.when(same_folder, F.col("path") > last_path).otherwise((base > last_base) | ((base == last_base) & (F.col("path") != last_path)))
    if not last_ts or last_ts == NO_TS:
        return files.where(F.col("path") > last_path)
    return files.where(F.when(F.col("file_ts") == NO_TS, F.col("path") > last_path).otherwise((F.col("file_ts") > last_ts) | ((F.col("file_ts") == last_ts) & after)))


def latest_file(files: DataFrame) -> DataFrame:
    return files.agg(F.max("path").alias("path"))


def scan_leads_csv(spark: SparkSession, paths: list[str], run_id: str, ingested_at: str) -> DataFrame:
    """Leads as text columns with provenance; empty files give no row."""
    return add_provenance(spark.read.schema(LEADS_TEXT).option("header", True).option("multiLine", False).csv(paths), run_id, ingested_at)


def raw_lines(lines: DataFrame) -> DataFrame:
    """Lines of a text reader, of files or of a stream of files, with their file and the start of their split."""
    return lines.select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines (raw, file, start) to (raw, file, line): each one's place in its file from 0, blank ones included.

    Lines get an id that rises within a split; each split's lines are counted, and the
    running sum over a file's splits (a row for each split, not for each line) is added.
    """
    lines = lines.select("raw", "file", "start", F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", (before - F.col("least")).alias("shift"))
    return lines.join(splits, ["file", "start"]).select("raw", "file", (F.col("id") + F.col("shift")).alias("line"))


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line (raw, file, line) of the files."""
    return number_lines(raw_lines(spark.read.text(paths)))


def parse_weblogs(lines: DataFrame, run_id: str, ingested_at: str) -> DataFrame:
    """Lines (raw, file, line) to log rows and a column ``_bad`` for lines that aren't JSON objects; blank ones go."""
    text = stripped(F.expr("make_valid_utf8(cast(raw as string))"))
    parsed = lines.select("file", "line", text.alias("t")).where(F.col("t") != "")
    parsed = parsed.select("file", "line", F.from_json("t", LOG_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    event_id = F.coalesce(F.nullif(F.col("j.event_id"), F.lit("")), F.concat_ws(":", "file", F.col("line").cast("string")))
    return parsed.select(
        event_id.alias("event_id"), "j.remote_host", "j.username", F.col("j.timestamp").alias("event_ts"), "j.user_agent", "j.request_path", "j.status_code",
        F.col("file").alias("_source_file"), F.col("line").alias("_source_line"), F.lit(run_id).alias("_ingestion_run_id"), F.lit(ingested_at).alias("_ingested_at"),
        (F.col("j").isNull() | F.col("j._corrupt").isNotNull()).alias("_bad"),
    )


def scan_weblogs_jsonl(spark: SparkSession, paths: list[str], run_id: str, ingested_at: str, bad=None) -> DataFrame:
    """Good lines of JSON files; the observation ``bad`` gets n_lines and n_bad when the result is written."""
    rows = parse_weblogs(numbered_lines(spark, paths), run_id, ingested_at)
    if bad is not None:
        rows = rows.observe(bad, F.count("*").alias("n_lines"), F.coalesce(F.sum(F.col("_bad").cast("int")), F.lit(0)).alias("n_bad"))
    return rows.where(~F.col("_bad")).drop("_bad")


def scan_manifest(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Exactly the listed Parquet files, once each; no list gives no row."""
    paths = sorted(set(paths))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_partitioned(df: DataFrame, path: str, source: str, dataset: str, run_date: str, run_hour: str, run_id: str, rows_per_file: int = 50_000) -> None:
    """Parquet under source=/dataset=/run_date=/run_hour=/run_id=; a rerun of a run id replaces its own partition."""
    keys = {"source": source, "dataset": dataset, "run_date": run_date, "run_hour": run_hour, "run_id": run_id}
    rows = df.withColumns({k: F.lit(v) for k, v in keys.items()})
    rows.write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).mode("overwrite").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """JSON lines whose files, by name, are in the order of a column: ranges of it are sorted apart, not all rows in one task."""
    df.orderBy(order).write.mode("overwrite").json(path)
