"""The cleaning stage between raw capture and load."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import Contract
from tidemark.functions.expressions import parse_ts_lenient
from tidemark.operators.dedupe import keep_last

LEAD_TIMES = ("created_at", "status_updated_at", "last_activity_at", "_ingested_at")


def align_to_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The contract's columns in its order, absent ones null; then columns that begin with _; others go."""
    named = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    own = {f.name for f in schema.fields}
    return df.select(*named, *[c for c in df.columns if c.startswith("_") and c not in own])


def has_required(required: list[str]):
    return reduce(and_, [F.col(c).isNotNull() for c in required], F.lit(True))


def required_filter(df: DataFrame, required: list[str], bad: Observation | None = None) -> DataFrame:
    """Rows whose required columns are all set; the observation gets n_rows and n_bad when the result is written."""
    if bad is not None:
        df = df.observe(bad, F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(has_required(required), 0).otherwise(1)), F.lit(0)).alias("n_bad"))
    return df.where(has_required(required))


def _with(df: DataFrame, columns: dict) -> DataFrame:
    return df.withColumns({k: v for k, v in columns.items() if k in df.columns})


def prep_leads(df: DataFrame) -> DataFrame:
    """Leads as captured (text) to their types; values that can't be read give null."""
    return _with(df, {
        "lead_id": F.col("lead_id").cast("string"), **{c: parse_ts_lenient(F.col(c).cast("string")) for c in LEAD_TIMES if c in df.columns},
        "estimated_annual_revenue": F.col("estimated_annual_revenue").try_cast("double"), "country_code": F.upper("country_code"),
        "is_prospect": F.col("is_prospect").try_cast("boolean"),
    })


def prep_weblogs(df: DataFrame) -> DataFrame:
    made = {
        "event_id": F.col("event_id").cast("string"), "event_ts": parse_ts_lenient(F.col("event_ts").cast("string")),
        "status_code": F.col("status_code").try_cast("bigint"), "_source_line": F.col("_source_line").try_cast("bigint") if "_source_line" in df.columns else F.lit(None),
    }
    if "_ingested_at" in df.columns:
        made["_ingested_at"] = parse_ts_lenient(F.col("_ingested_at").cast("string"))
    return _with(df, made)


def prep_decimal(df: DataFrame) -> DataFrame:
    """Decimals become doubles, as at capture."""
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields])


def add_provenance(df: DataFrame, run_id: str, ingested_at: str, source_file=None) -> DataFrame:
    """Source file (by default the file that Spark read), run id and capture time as text."""
    file = F.col("_metadata.file_path") if source_file is None else source_file
    return df.select("*", file.alias("_source_file"), F.lit(run_id).alias("_ingestion_run_id"), F.lit(ingested_at).alias("_ingested_at"))


def process(df: DataFrame, contract: Contract, *, file_column: str = "_source_file", bad: Observation | None = None) -> DataFrame:
    """One dataset's raw rows to clean ones: prepare, align, drop bad records, deduplicate by the contract's scope."""
    preparation = PREPARATIONS.get(contract.name) or contract.prepare
    ready = align_to_contract(preparation(df) if preparation else df, contract.schema)
    ready = required_filter(ready, contract.required, bad)
    file = file_column if contract.scope == "file" and file_column in ready.columns else None
    return keep_last(ready, list(contract.key), list(contract.order), file)


#: Preparation by dataset; add a name here for a dataset of your own.
PREPARATIONS = {"marketing_leads": prep_leads, "webserver_logs": prep_weblogs}
