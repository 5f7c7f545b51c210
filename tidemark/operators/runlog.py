"""Ingestion history as append-only tables: runs, their paths, cursors and schemas; state is the newest row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN_KEY = ["run_id", "source", "dataset", "stage"]
WATERMARK_KEY = ["source", "dataset", "stage"]
RUNS = "run_id string, source string, dataset string, stage string, status string, records long, bad_records long, watermark_before string, watermark_after string, error string, updated_at timestamp"
WATERMARKS = "source string, dataset string, stage string, run_id string, value string, updated_at timestamp"


def latest_per_key(history: DataFrame, keys: list[str], by: str = "updated_at") -> DataFrame:
    """The newest row of each key; ties are settled by all other columns, so reruns agree."""
    rest = [F.col(c).desc_nulls_last() for c in sorted(set(history.columns) - {*keys, by})]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *rest))
    return history.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def append(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").parquet(path)


def run_row(spark: SparkSession, run_id: str, source: str, dataset: str, stage: str, status: str, at, **more) -> DataFrame:
    """One row of the run table: status started, completed or failed."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    values = {"run_id": run_id, "source": source, "dataset": dataset, "stage": stage, "status": status, "updated_at": at} | more
    return spark.createDataFrame([tuple(values.get(n) for n in names)], RUNS)


def run_states(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs, RUN_KEY)


def watermark_states(watermarks: DataFrame) -> DataFrame:
    return latest_per_key(watermarks, WATERMARK_KEY)


def paths_to_rows(runs: DataFrame, column: str, kind: str) -> DataFrame:
    """A list column of run rows to rows (key, path_kind, path_index, path)."""
    return runs.select(*RUN_KEY, F.lit(kind).alias("path_kind"), F.posexplode(column).alias("path_index", "path"))


def rows_to_paths(paths: DataFrame) -> DataFrame:
    """The ordered list of each run and kind; a run's list has its files, a bounded number."""
    listed = F.sort_array(F.collect_list(F.struct("path_index", "path")))
    return paths.groupBy(*RUN_KEY, "path_kind").agg(F.transform(listed, lambda x: x["path"]).alias("paths"))


def latest_completed_manifest(runs: DataFrame, watermarks: DataFrame) -> DataFrame:
    """The run that set each current cursor, if it is completed."""
    current = watermark_states(watermarks).select(*WATERMARK_KEY, "run_id", F.col("value").alias("watermark"))
    return current.join(run_states(runs), [*WATERMARK_KEY, "run_id"]).where(F.col("status") == "completed")


def run_coherence(manifests: DataFrame) -> DataFrame:
    """One row: number of run ids among manifests, and whether they are one run's."""
    return manifests.agg(F.countDistinct("run_id").alias("n_runs")).withColumn("coherent", F.col("n_runs") <= 1)


def require_coherence(manifests: DataFrame, warn_only: bool = False) -> bool:
    row = run_coherence(manifests).first()
    if not row["coherent"] and not warn_only:
        raise ValueError(f"manifests of {row['n_runs']} runs are mixed")
    return row["coherent"]


def manifest_metrics(runs: DataFrame) -> DataFrame:
    """Datasets, records and bad records by run and stage."""
    return run_states(runs).groupBy("run_id", "stage").agg(F.countDistinct("dataset").alias("datasets"), F.sum(F.coalesce("records", F.lit(0))).alias("records"), F.sum(F.coalesce("bad_records", F.lit(0))).alias("bad_records"))


def schema_snapshot(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Rows (column_index, name, dtype, nullable, n_rows) of a frame's schema."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, n_rows) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_index int, name string, dtype string, nullable boolean, n_rows long")
