"""One ingestion run: each dataset is processed and loaded, and its outcome is a row of the run history."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import Contract
from tidemark.operators import clean, runlog
from tidemark.operators.merge import VersionedTable, replace_snapshot
from tidemark.sources import extract, files


def _attempt_folder(root: str, kind: str, dataset: str, run_id: str) -> str:
    """A folder that no other attempt of the run writes to."""
    return f"{root}/{kind}/dataset={dataset}/run_id={run_id}/attempt={uuid.uuid4().hex[:12]}"


def load_dataset(spark: SparkSession, contract: Contract, raw: DataFrame, root: str, run_id: str) -> dict:
    """Processes a dataset's raw rows and loads its targets; gives the counts of rows and of bad ones.

    The processed rows are written once under processed/ and read for every target, as a
    target's write must not compute them again. Each attempt of a run writes a folder of its own.
    """
    seen = Observation()
    path = _attempt_folder(root, "processed", contract.name, run_id)
    clean.process(clean.prep_decimal(raw), contract, bad=seen).write.option("maxRecordsPerFile", 50_000).parquet(path)
    rows = spark.read.parquet(path)
    for target, key in (contract.targets or {contract.name: contract.key}).items():
        table = VersionedTable(spark, f"{root}/tables/{target}")
        if contract.mode == "full_snapshot":
            table.replace(replace_snapshot(None, rows), list(key), run_id)
        else:
            table.upsert(rows, list(key), run_id)
    return {"records": seen.get["n_rows"] - seen.get["n_bad"], "bad_records": seen.get["n_bad"]}


def _attempt(spark: SparkSession, root: str, run_id: str, key: tuple, at: dt.datetime, work: Callable[[], dict], fail_fast: bool) -> None:
    """Does one dataset's work between a started row and a completed or failed one."""
    history = f"{root}/history/runs"
    runlog.append(runlog.run_row(spark, run_id, *key, "started", at), history)
    try:
        outcome = {"status": "completed", **work()}
    except Exception as e:
        if fail_fast:
            raise
        outcome = {"status": "failed", "error": str(e)[:2000]}
    status = outcome.pop("status")
    runlog.append(runlog.run_row(spark, run_id, *key, status, at + dt.timedelta(milliseconds=1), **outcome), history)


def _states(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return runlog.run_states(spark.read.schema(runlog.RUNS).parquet(f"{root}/history/runs")).where(f"run_id = '{run_id}'")


def completed(spark: SparkSession, root: str, run_id: str, key: tuple) -> bool:
    """Whether this part of the run has been done: it isn't done again."""
    try:
        runs = spark.read.schema(runlog.RUNS).parquet(f"{root}/history/runs")
    except Exception as e:  # no run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    own = dict(zip(("run_id", "source", "dataset", "stage", "status"), (run_id, *key, "completed"), strict=True))
    for column, value in own.items():
        runs = runs.where(F.col(column) == value)
    return not runs.isEmpty()


def run(spark: SparkSession, raw: list[tuple[Contract, DataFrame]], root: str, run_id: str, now: dt.datetime | None = None, fail_fast: bool = False) -> DataFrame:
    """Loads datasets in turn; one that fails leaves its tables as they were and a failed row, and the rest go on.

    Gives the run's newest row for each dataset. Repeating a run id does only what isn't completed.
    """
    at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    for i, (contract, df) in enumerate(raw):
        key = ("files" if contract.mode == "files" else "db", contract.name, "load")
        if completed(spark, root, run_id, key):
            continue
        _attempt(spark, root, run_id, key, at + dt.timedelta(milliseconds=2 * i), lambda c=contract, d=df: load_dataset(spark, c, d, root, run_id), fail_fast)
    return _states(spark, root, run_id)


def stored_mark(spark: SparkSession, root: str, dataset: str, source: str = "db") -> str | None:
    """The newest stored cursor value of a dataset; None before its first run."""
    try:
        marks = spark.read.schema(runlog.WATERMARKS).parquet(f"{root}/history/watermarks")
    except Exception as e:  # no mark yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    row = runlog.watermark_states(marks).where((F.col("source") == source) & (F.col("dataset") == dataset) & (F.col("stage") == "raw")).first()
    return row["value"] if row else None


def _record(spark: SparkSession, root: str, run_id: str, source: str, dataset: str, path: str, rows: DataFrame, mark: str | None, at: dt.datetime) -> None:
    """What a loaded part leaves in the history: its path, its schema, and last its mark."""
    listed = runlog.run_row(spark, run_id, source, dataset, "raw", "completed", at).withColumn("paths", F.array(F.lit(path)))
    runlog.append(runlog.paths_to_rows(listed, "paths", "raw_path"), f"{root}/history/paths")
    columns = runlog.schema_snapshot(rows, rows.count()).select(F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), "*")
    runlog.append(columns, f"{root}/history/schemas")
    if mark is not None:
        runlog.append(spark.createDataFrame([(source, dataset, "raw", run_id, mark, at)], runlog.WATERMARKS), f"{root}/history/watermarks")


def capture(spark: SparkSession, contract: Contract, source: DataFrame, root: str, run_id: str, at: dt.datetime) -> dict:
    """One dataset from its source: the window from the stored mark to the source's frozen mark, written, loaded, then recorded.

    Raw rows lie in a folder of this attempt, in the order of the cursor inside each file.
    Path, schema and mark are stored after the load only, so a failed run is read again
    and what an earlier attempt wrote stays as it is; an empty window keeps the mark.
    """
    path, low, high = _attempt_folder(root, "raw", contract.name, run_id), None, None
    rows = extract.scan_full_snapshot(source)
    if contract.cursor:
        low, high = stored_mark(spark, root, contract.name), extract.high_watermark(source, contract.cursor).first()[0]
        kind = "id" if contract.mode == "incremental_id" else "timestamp"
        rows = extract.scan_window(source, contract.cursor, high, low, kind).sortWithinPartitions(contract.cursor)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    outcome = load_dataset(spark, contract, rows, root, run_id)
    after = extract.next_watermark(high, low)
    after = None if after is None else str(after)
    _record(spark, root, run_id, "db", contract.name, path, rows, after, at)
    return {**outcome, "watermark_before": low, "watermark_after": after}


def run_sources(spark: SparkSession, sources: list[tuple[Contract, DataFrame]], root: str, run_id: str, now: dt.datetime | None = None, fail_fast: bool = False) -> DataFrame:
    """A run over whole source tables, each read from its stored mark on; gives the run's newest row for each dataset.

    A dataset that the run has completed is left alone when the run is repeated.
    """
    at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    for i, (contract, df) in enumerate(sources):
        own, key = at + dt.timedelta(milliseconds=2 * i), ("db", contract.name, "raw")
        if not completed(spark, root, run_id, key):
            _attempt(spark, root, run_id, key, own, lambda c=contract, d=df, t=own: capture(spark, c, d, root, run_id, t), fail_fast)
    return _states(spark, root, run_id)


Reader = Callable[[SparkSession, list[str], str, str], DataFrame]


def capture_files(spark: SparkSession, contract: Contract, folder: str, read: Reader, root: str, run_id: str, at: dt.datetime) -> dict:
    """A dataset's files after its stored cursor, in dated folders: listed, read, written as raw rows, loaded, then recorded.

    The cursor is the time and the path of the last file by time and path; the files of a
    run are rows of the history (dataset, run_id, path), so what was read can be told.
    """
    before = stored_mark(spark, root, contract.name, "files")
    last_ts, _, last_path = (before or "").partition(" ")
    listed = files.dated_files(spark, folder, last_ts or None)
    new = files.new_files(listed, last_path or None, last_ts or None)
    found = sorted((r["file_ts"], r["path"]) for r in new.collect())  # one row a new file, which the reader takes as a list
    if not found:
        return {"records": 0, "bad_records": 0, "watermark_before": before, "watermark_after": before}
    path = _attempt_folder(root, "raw", contract.name, run_id)
    rows = read(spark, [p for _, p in found], run_id, at.isoformat(sep=" "))
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    outcome = load_dataset(spark, contract, rows, root, run_id)
    after = " ".join(found[-1])
    history = spark.createDataFrame([(contract.name, run_id, p) for _, p in found], "dataset string, run_id string, path string")
    runlog.append(history, f"{root}/history/files")
    _record(spark, root, run_id, "files", contract.name, path, rows, after, at)
    return {**outcome, "watermark_before": before, "watermark_after": after}


def run_files(spark: SparkSession, sources: list[tuple[Contract, str, Reader]], root: str, run_id: str, now: dt.datetime | None = None, fail_fast: bool = False) -> DataFrame:
    """A run over folders of files, each read from its stored cursor on; gives the run's newest row for each dataset."""
    at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    for i, (contract, folder, read) in enumerate(sources):
        own, key = at + dt.timedelta(milliseconds=2 * i), ("files", contract.name, "raw")
        if not completed(spark, root, run_id, key):
            _attempt(spark, root, run_id, key, own, lambda c=contract, d=folder, r=read, t=own: capture_files(spark, c, d, r, root, run_id, t), fail_fast)
    return _states(spark, root, run_id)
