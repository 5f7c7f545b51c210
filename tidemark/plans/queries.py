"""The registered queries over the fixture views; each uses the operators as a user would."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import contracts
from tidemark.functions.expressions import cents, first_set, parse_ts_lenient, tolerant_bool, trade_lane, ts, user_cohort
from tidemark.operators import asof, audit, clean, dedupe, merge, quality, rollup, rules, runlog
from tidemark.plans import ingestion, marts, reports, staging, warehouse
from tidemark.plans.fixtures import dataset, table
from tidemark.sources import extract, files
from tidemark.sources.workdir import staged, work_folder
from tidemark.streaming import ingest, newest

#: The day of the reports: the last order date at every scale; and what loaded_at is set to.
AS_OF = "2001-08-01"
LOADED = "2001-08-01 12:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
CUT = "1998-06-01 00:00:00"
EVENT_CUT = "2024-01-15 00:00:00"
RUN = "run-1"
INGESTED = "2024-02-01 00:00:00"

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class Models:
    """Staging models and marts of one input folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def source(self, name: str) -> DataFrame:
        return dataset(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = MODELS[name](self)
        return self.made[name]


def _loaded():
    return ts(LOADED)


MODELS = {
    "stg_ref_countries": lambda m: staging.stg_ref_countries(m.source("ref_countries")),
    "stg_companies": lambda m: staging.stg_companies(m.source("companies")),
    "stg_products": lambda m: staging.stg_products(m.source("products")),
    "stg_company_catalogs": lambda m: staging.stg_company_catalogs(m.source("company_catalogs")),
    "stg_customers": lambda m: staging.stg_customers(m.source("customers")),
    "stg_orders": lambda m: staging.stg_orders(m.source("src_orders")),
    "stg_order_items": lambda m: staging.stg_order_items(m.source("order_items"), m["stg_orders"]),
    "stg_leads": lambda m: staging.stg_marketing_leads(m.source("leads")),
    "stg_webserver_logs": lambda m: staging.stg_webserver_logs(m.source("webserver_logs")),
    "dim_countries": lambda m: marts.dim_countries(m["stg_ref_countries"]),
    "dim_companies": lambda m: marts.dim_companies(m["stg_companies"], m["dim_countries"]),
    "dim_customers": lambda m: marts.dim_customers(m["stg_customers"], m["dim_companies"]),
    "dim_products": lambda m: marts.dim_products(m["stg_products"], m["dim_companies"], m["stg_company_catalogs"]),
    "dim_datetime": lambda m: marts.dim_datetime([(m["stg_orders"], "order_ts"), (m["stg_webserver_logs"], "event_ts"), *[(m["stg_leads"], c) for c in ("created_at", "status_updated_at", "last_activity_at")]], F.lit(AS_OF)),
    "fct_orders": lambda m: marts.fct_orders(m["stg_orders"], m["stg_order_items"], _loaded()),
    "fct_order_items": lambda m: marts.fct_order_items(m["stg_order_items"], m["stg_orders"], m["stg_products"], _loaded()),
    "fct_catalog_prices": lambda m: marts.fct_company_catalog_prices(m["stg_company_catalogs"], _loaded()),
    "fct_leads_current": lambda m: marts.fct_marketing_leads_current(m["stg_leads"], m["dim_companies"], _loaded()),
    "fct_leads_history": lambda m: marts.fct_marketing_leads_history(m["stg_leads"], _loaded()),
    "fct_webserver_logs": lambda m: marts.fct_webserver_logs(m["stg_webserver_logs"], _loaded()),
}
#: Sums of doubles depend on their order in the last digits, so they are compared in cents.
MONEY = {"fct_orders": ["total_line_amount"], "fct_order_items": ["estimated_base_cost", "estimated_margin", "line_amount", "unit_price"], "stg_order_items": ["unit_price", "line_amount"], "stg_company_catalogs": ["sale_price"], "fct_catalog_prices": ["current_sale_price"]}


def in_cents(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns({c: cents(c) for c in MONEY.get(name, [])})


for _name in MODELS:
    QUERIES[_name] = lambda spark, sf_dir, name=_name: in_cents(Models(spark, sf_dir)[name], name)


# --- incremental models: a target of the rows up to a cut, then a merge of the whole source


# A target that differs from its source shows which rows a merge replaces: some of its rows are changed, some are missing.


@query
def inc_orders(spark, sf_dir):
    """Rows at the mark are taken again; changed rows below it stay as they are, missing ones stay away."""
    m = Models(spark, sf_dir)
    old = marts.fct_orders(m["stg_orders"].where(F.col("updated_at") <= ts(CUT)), m["stg_order_items"], _loaded()).where(F.col("order_id") % 7 != 0)
    old = old.withColumn("order_status", F.when(F.col("order_id") % 3 == 0, "STALE").otherwise(F.col("order_status")))
    out = merge.incremental_merge(
        old, m["stg_orders"], ["order_id"], lambda d: marts.fct_orders(d, m["stg_order_items"], _loaded(), delta=True),
        cursor=first_set("updated_at", "order_ts"), target_cursor=F.coalesce("source_updated_at", "order_ts"), floor="1900-01-01 00:00:00",
    )
    return in_cents(out, "fct_orders")


@query
def inc_order_items(spark, sf_dir):
    """Loaded items are frozen and late ids stay away: only ids above the mark are taken."""
    m = Models(spark, sf_dir)
    source = staged(m["stg_order_items"], "order-items")  # read four times, and its ids come from a window over the whole table
    half = source.agg(F.max("order_item_id")).first()[0] // 2
    items = source.where((F.col("order_item_id") <= half) & (F.col("order_item_id") % 7 != 0))
    old = marts.fct_order_items(items, m["stg_orders"], m["stg_products"], _loaded())
    old = old.withColumn("quantity", F.when(F.col("order_item_id") % 3 == 0, 0).otherwise(F.col("quantity")).cast(old.schema["quantity"].dataType))
    out = merge.incremental_merge(
        old, source, ["order_item_id"], lambda d: marts.fct_order_items(d, m["stg_orders"], m["stg_products"], _loaded()),
        cursor=F.col("order_item_id"), target_cursor=F.col("order_item_id"), inclusive=False, floor=0,
    )
    return in_cents(out, "fct_order_items")


@query
def inc_catalog_prices(spark, sf_dir):
    m = Models(spark, sf_dir)
    old = marts.fct_company_catalog_prices(m["stg_company_catalogs"].where(F.col("updated_at") <= ts(CUT)), _loaded())
    out = merge.incremental_merge(
        old, m["stg_company_catalogs"], ["company_cuit", "product_id"], lambda d: marts.fct_company_catalog_prices(d, _loaded()),
        cursor=first_set("updated_at", "created_at"), target_cursor=F.coalesce("updated_at", "created_at"), floor="1900-01-01 00:00:00",
    )
    return in_cents(out, "fct_catalog_prices")


@query
def inc_leads_current(spark, sf_dir):
    """Each run takes the whole source: changed rows are replaced, and leads that the source no longer has stay."""
    m = Models(spark, sf_dir)
    now = m["fct_leads_current"]
    gone = now.where(F.col("lead_id").endswith("3")).withColumn("lead_id", F.concat(F.lit("X"), "lead_id"))
    old = marts.fct_marketing_leads_current(m["stg_leads"].where(F.col("_ingested_at") <= ts(EVENT_CUT)), m["dim_companies"], _loaded()).unionByName(gone).withColumn("status", F.lit("STALE"))
    return merge.incremental_merge(old, m["stg_leads"], ["lead_id"], lambda d: marts.fct_marketing_leads_current(d, m["dim_companies"], _loaded()))


@query
def inc_leads_history(spark, sf_dir):
    m = Models(spark, sf_dir)
    old = marts.fct_marketing_leads_history(m["stg_leads"].where(F.col("_ingested_at") <= ts(EVENT_CUT)), _loaded())
    return merge.incremental_merge(
        old, m["stg_leads"], ["lead_id", "_ingestion_run_id"], lambda d: marts.fct_marketing_leads_history(d, _loaded()),
        cursor=first_set("_ingested_at", "created_at"), target_cursor=F.coalesce("_ingested_at", "created_at"), inclusive=False, floor="1900-01-01 00:00:00",
    )


@query
def inc_webserver_logs(spark, sf_dir):
    """Events that are sent again after the mark replace their rows; changed and missing events up to the mark stay so."""
    m = Models(spark, sf_dir)
    logs, n = m["stg_webserver_logs"], F.substr("event_id", F.lit(2)).cast("long")
    again = logs.where((F.col("_ingested_at") <= ts(EVENT_CUT)) & (n % 17 == 0)).withColumns({"_ingested_at": ts("2024-02-05 00:00:00"), "status_code": F.lit(503)})
    old = marts.fct_webserver_logs(logs.where((F.col("_ingested_at") <= ts(EVENT_CUT)) & (n % 7 != 0)), _loaded())
    old = old.withColumn("request_path", F.when(n % 3 == 0, "/stale").otherwise(F.col("request_path")))
    return merge.incremental_merge(
        old, logs.unionByName(again), ["event_id"], lambda d: marts.fct_webserver_logs(d, _loaded()),
        cursor=first_set("_ingested_at", "event_ts"), target_cursor=F.coalesce("_ingested_at", "event_ts"), inclusive=False, floor="1900-01-01 00:00:00",
    )


# --- reports


@query
def monthly_sales(spark, sf_dir):
    m = Models(spark, sf_dir)
    return reports.monthly_sales(m["fct_orders"], F.lit(AS_OF))


@query
def top_devices(spark, sf_dir):
    return reports.top_devices(Models(spark, sf_dir)["fct_webserver_logs"])


@query
def top_products_in_top_country(spark, sf_dir):
    m = Models(spark, sf_dir)
    return reports.top_products_in_top_country(m["fct_webserver_logs"], m["dim_customers"], m["dim_companies"], m["fct_order_items"], m["fct_orders"], m["dim_products"])


# --- extraction


@query
def window_timestamp(spark, sf_dir):
    return extract.scan_incremental_timestamp(dataset(spark, sf_dir, "src_orders"), "updated_at", "1999-01-01 00:00:00", CUT)


@query
def window_id(spark, sf_dir):
    items = dataset(spark, sf_dir, "order_items").select("id", "order_id", "product_id", "quantity")
    return extract.scan_incremental_id(items, "id", 2_000_000, 1_000_000)


@query
def window_empty(spark, sf_dir):
    return extract.scan_incremental_timestamp(dataset(spark, sf_dir, "src_orders"), "updated_at", None, CUT)


@query
def full_snapshot(spark, sf_dir):
    return extract.scan_full_snapshot(dataset(spark, sf_dir, "ref_countries"))


@query
def high_watermark(spark, sf_dir):
    return extract.high_watermark(dataset(spark, sf_dir, "src_orders"), "updated_at")


# --- cleaning


def _time_texts(spark, sf_dir) -> DataFrame:
    """Event times as text in seven forms, by event_id."""
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    forms = [plain, F.replace(plain, F.lit(" "), F.lit("T")), F.concat(F.lit("  "), plain, F.lit(".250000 ")), F.concat(plain, F.lit("Z")), F.concat(F.replace(plain, F.lit(" "), F.lit("T")), F.lit("+02:00")), F.date_format("ts", "yyyy-MM-dd"), F.lit("soon")]
    events = table(spark, sf_dir, "events")
    return events.withColumn("text", F.element_at(F.array(*forms), (F.col("event_id") % 7 + 1).cast("int")))


@query
def parse_ts(spark, sf_dir):
    return _time_texts(spark, sf_dir).select("event_id", parse_ts_lenient("text").alias("parsed"), parse_ts_lenient("text", normalize_utc=True).alias("parsed_utc"))


@query
def required_filter_counts(spark, sf_dir):
    rows = _time_texts(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), parse_ts_lenient("text").alias("event_ts"), "event_type")
    flagged = rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.sum(F.when(clean.has_required(["event_id", "event_ts"]), 0).otherwise(1)).alias("n_bad"))
    good = clean.required_filter(rows, ["event_id", "event_ts"]).groupBy("event_type").agg(F.count("*").alias("n_good"))
    return flagged.join(good, "event_type", "left")


@query
def align_contract(spark, sf_dir):
    raw = dataset(spark, sf_dir, "companies").drop("country_code").withColumn("surplus", F.lit(1)).withColumn("_source_file", F.lit("x"))
    return clean.align_to_contract(raw, contracts.COMPANIES.schema)


@query
def decimals_to_double(spark, sf_dir):
    return clean.prep_decimal(dataset(spark, sf_dir, "products").select("id", F.col("base_price").cast("decimal(12,2)").alias("base_price")))


def _leads_text(spark, sf_dir) -> DataFrame:
    leads = dataset(spark, sf_dir, "leads")
    texts = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "status_updated_at", "last_activity_at")}
    texts |= {"is_prospect": F.col("is_prospect").cast("string"), "estimated_annual_revenue": F.round(F.col("estimated_annual_revenue")).cast("long").cast("string"), "contact_name": F.lit("Ann Lee"), "company_name": F.when(F.substring("lead_id", -1, 1) == "7", None).otherwise(F.col("company_name"))}
    return leads.withColumns(texts).select(*files.LEADS_TEXT.fieldNames())


def _clean_lead_columns(df: DataFrame) -> DataFrame:
    return df.select("lead_id", "created_at", "company_name", "is_prospect", "lead_source", "estimated_annual_revenue", "country_code", "status", "status_updated_at")


@query
def clean_leads(spark, sf_dir):
    return _clean_lead_columns(clean.process(_leads_text(spark, sf_dir), contracts.MARKETING_LEADS))


@query
def clean_weblogs(spark, sf_dir):
    logs = dataset(spark, sf_dir, "webserver_logs")
    raw = logs.select("event_id", "remote_host", "username", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_ts"), "user_agent", "request_path", F.when(F.col("status_code") == 201, "n/a").otherwise(F.col("status_code").cast("string")).alias("status_code"), "_source_file", "_source_line")
    return clean.process(raw, contracts.WEBSERVER_LOGS).select("event_id", "username", "event_ts", "user_agent", "request_path", "status_code", "_source_line")


@query
def database_window(spark, sf_dir):
    """Order items into a database through a staging table, swapped in twice, and a window of them read back by even ranges."""
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex[:12]};create=true"
    items = dataset(spark, sf_dir, "order_items").select("id", "order_id", "product_id", "quantity")
    extract.swap_jdbc(items.limit(10), url, "order_items")
    extract.swap_jdbc(items.coalesce(4), url, "order_items")
    high = items.agg(F.max("order_id")).first()[0] // 2
    rows = extract.read_jdbc_evenly(spark, url, "order_items", "id", partitions=5, cursor="order_id", high=high, low=high // 4)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    return rows.withColumn("even", F.lit(len(sizes) == 5 and max(sizes) < 2 * min(sizes)))


# --- files


def _log_lines(spark, sf_dir) -> DataFrame:
    """Events as JSON lines; after some a broken line, a list, or a blank one; some without an id."""
    logs = dataset(spark, sf_dir, "webserver_logs").withColumn("n", F.col("_source_line"))
    event_id = F.when(F.col("n") % 11 == 0, F.lit("")).otherwise(F.col("event_id"))
    line = F.to_json(F.struct(event_id.alias("event_id"), "username", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "request_path", F.col("status_code").cast("string").alias("status_code"), "user_agent", F.lit("GET").alias("request_method")))
    lines = F.filter(F.array(line, F.when(F.col("n") % 50 == 0, F.lit('{"event_id": ')), F.when(F.col("n") % 70 == 0, F.lit("  ")), F.when(F.col("n") % 90 == 0, F.lit("[1]"))), lambda x: x.isNotNull())
    return logs.select(F.explode(lines).alias("value"))


def _written_log_lines(spark, sf_dir) -> str:
    path = work_folder(spark, "access-logs")
    _log_lines(spark, sf_dir).write.text(path)
    return path


@query
def capture_weblogs_jsonl(spark, sf_dir):
    rows = files.scan_weblogs_jsonl(spark, [_written_log_lines(spark, sf_dir)], RUN, INGESTED)
    made = F.col("event_id") == F.concat_ws(":", "_source_file", F.col("_source_line").cast("string"))
    return rows.select(F.when(made, "made").otherwise(F.col("event_id")).alias("event_id"), "username", parse_ts_lenient("event_ts").alias("event_ts"), "request_path", "status_code", "user_agent", "_ingestion_run_id", "_ingested_at")


@query
def bad_line_count(spark, sf_dir):
    rows = files.parse_weblogs(files.numbered_lines(spark, [_written_log_lines(spark, sf_dir)]), RUN, INGESTED)
    return rows.agg(F.count("*").alias("n_lines"), F.sum(F.col("_bad").cast("long")).alias("n_bad"))


@query
def source_line_numbers(spark, sf_dir):
    """All lines, blank ones too, and whether each file's numbers are 0 to its lines less one."""
    lines = files.numbered_lines(spark, [_written_log_lines(spark, sf_dir)])
    by_file = lines.groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last"), F.sum("line").alias("total"), F.min("line").alias("first"))
    dense = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("total") == F.col("n") * (F.col("n") - 1) / 2)
    return by_file.agg(F.sum("n").alias("n_lines"), F.min(dense).alias("dense"))


@query
def capture_leads_csv(spark, sf_dir):
    path = work_folder(spark, "leads-csv")
    files.write_csv(_leads_text(spark, sf_dir), path)
    return _clean_lead_columns(clean.process(files.scan_leads_csv(spark, [path], RUN, INGESTED), contracts.MARKETING_LEADS))


def _file_names(spark, sf_dir) -> DataFrame:
    """File names by event: dated, dated alike in two folders, and undated."""
    day = F.date_format("ts", "yyyyMMdd'_'HHmm'00'")
    name = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("/in/seed/access_"), F.col("event_id").cast("string"), F.lit(".jsonl"))).otherwise(F.concat(F.lit("/in/daily/access_"), day, F.lit(".jsonl")))
    return table(spark, sf_dir, "events").select(name.alias("path")).distinct().withColumn("file_ts", files.file_ts_key("path"))


@query
def new_files_after_cursor(spark, sf_dir):
    return files.new_files(_file_names(spark, sf_dir), "/in/daily/access_20240115_120000.jsonl", "20240115_120000")


@query
def file_listing(spark, sf_dir):
    """Number of files and of files without a time among written ones; the paths differ by run."""
    path = _written_log_lines(spark, sf_dir)
    listed = files.glob_sources(spark, [f"{path}/part-*", f"{path}/*.txt", f"{path}/none-*"])
    return listed.agg((F.count("*") > 0).alias("found"), (F.count("*") == F.countDistinct("path")).alias("distinct_paths"), F.max(F.col("file_ts") != files.NO_TS).alias("any_dated"))


@query
def manifest_read(spark, sf_dir):
    """Orders written by status as a partitioned raw set; one partition's files are read by their list."""
    path = work_folder(spark, "raw")
    orders = dataset(spark, sf_dir, "src_orders")
    for hour, status in (("00", "COMPLETED"), ("01", "RETURNED")):
        files.write_partitioned(orders.where(F.col("status") == status), path, "db", "orders", "2024-02-01", hour, RUN)
    raw = spark.read.parquet(path).where("run_hour = 1").select(F.col("_metadata.file_path").alias("p")).distinct()
    return files.scan_manifest(spark, [r["p"] for r in raw.collect()], orders.schema)


@query
def latest_file(spark, sf_dir):
    return files.latest_file(_file_names(spark, sf_dir))


# --- deduplication and loads


@query
def dedupe_latest_lineitem(spark, sf_dir):
    return dedupe.keep_last(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"], tiebreak=["l_partkey", "l_suppkey", "l_extendedprice"])


@query
def dedupe_per_file(spark, sf_dir):
    logs = table(spark, sf_dir, "events").withColumn("_source_file", F.col("event_type"))
    return dedupe.keep_last(logs, ["user_id"], ["ts"], "_source_file", ["event_id"]).select("user_id", "_source_file", "event_id")


def _order_batch(orders: DataFrame) -> DataFrame:
    """Every tenth order changed, and as many new ones."""
    tenth = orders.where(F.col("id") % 10 == 0)
    return tenth.withColumn("status", F.lit("CANCELLED")).unionByName(tenth.withColumn("id", -F.col("id") - 1))


@query
def upsert_orders(spark, sf_dir):
    orders = dataset(spark, sf_dir, "src_orders")
    return merge.upsert(orders, _order_batch(orders), ["id"])


@query
def upsert_versions(spark, sf_dir):
    """The same through a versioned table: create, upsert, and the upsert again."""
    orders = dataset(spark, sf_dir, "src_orders")
    t = merge.VersionedTable(spark, work_folder(spark, "orders-table"))
    t.upsert(orders, ["id"], "run-0")
    for run in ("run-1", "run-1-again"):
        t.upsert(_order_batch(orders), ["id"], run)
    return t.read()


@query
def upsert_by_path(spark, sf_dir):
    """Lines of two files; a key's rows come from the later file."""
    items = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("_source_file"))
    return merge.upsert_files(items.limit(0), items, ["user_id"]).select("event_id", "user_id", "_source_file")


@query
def replace_snapshot(spark, sf_dir):
    countries = dataset(spark, sf_dir, "ref_countries")
    return merge.replace_snapshot(countries, countries.where(F.col("code") != "N1")).unionByName(merge.replace_snapshot(countries, countries.limit(0), "failed").where("code = 'N1'"))


@query
def multi_target_leads(spark, sf_dir):
    leads = dataset(spark, sf_dir, "leads").select("lead_id", "_ingestion_run_id", "status_updated_at", "status", "last_activity_at", "estimated_annual_revenue")
    newest = dedupe.keep_last(leads, ["lead_id", "_ingestion_run_id"], ["status_updated_at"])
    current = dedupe.keep_last(newest, ["lead_id"], ["status_updated_at"])
    empty = leads.limit(0)
    loaded = merge.multi_target(newest, {"history": (empty, ["lead_id", "_ingestion_run_id"])}) | merge.multi_target(current, {"current": (empty, ["lead_id"])})
    parts = [df.groupBy().agg(F.count("*").alias("n_rows"), F.countDistinct("lead_id").alias("n_leads"), F.max("status_updated_at").alias("newest")).select(F.lit(name).alias("target"), "*") for name, df in loaded.items()]
    return parts[0].unionAll(parts[1])


# --- quality


def _sources(spark, sf_dir) -> dict[str, DataFrame]:
    names = {"orders": "src_orders"}
    return {n: dataset(spark, sf_dir, names.get(n, n)) for n in ("ref_countries", "companies", "products", "company_catalogs", "customers", "orders", "order_items")}


@query
def dq_business(spark, sf_dir):
    return audit.run_audits(audit.business_audits(_sources(spark, sf_dir)))


@query
def dq_business_broken(spark, sf_dir):
    """The same checks over sources with rows taken out and values changed."""
    t = _sources(spark, sf_dir)
    t["companies"] = t["companies"].where("cuit not in ('C1', 'S1')").withColumn("type", F.when(F.col("cuit") == "C2", "Partner").when(F.col("cuit") == "C3", "Supplier").otherwise(F.col("type")))
    t["products"] = t["products"].where("id % 100 <> 0")
    t["orders"] = t["orders"].where("id % 1000 <> 0").withColumn("total_amount", F.when(F.col("id") % 500 == 1, 0.0).otherwise(F.col("total_amount")))
    t["customers"] = t["customers"].withColumn("email", F.when(F.col("id") % 50 == 0, "x@example.com").otherwise(F.col("email"))).where("id <> 5")
    return audit.run_audits(audit.business_audits(t))


@query
def dq_generic(spark, sf_dir):
    m = Models(spark, sf_dir)
    models = {n: m[n] for n in ("dim_countries", "dim_companies", "dim_customers", "dim_products", "dim_datetime", "fct_orders", "fct_order_items", "fct_webserver_logs")}
    return audit.run_audits(audit.warehouse_audits(models | {"fct_marketing_leads_current": m["fct_leads_current"]}))


@query
def dq_row_counts(spark, sf_dir):
    return quality.row_counts(_sources(spark, sf_dir))


@query
def dq_country_share(spark, sf_dir):
    return quality.top_share(dataset(spark, sf_dir, "companies"), "country_code", ("N1", "N2", "N3", "N4", "N5"), 0.2)


@query
def dq_lead_status(spark, sf_dir):
    leads = dataset(spark, sf_dir, "leads")
    odd = leads.withColumn("status", F.when(F.col("status") == "Lost", "lost").otherwise(F.concat(F.lit(" "), "status")))
    return quality.run_checks({"lead_status": quality.lead_statuses(leads), "lead_status_odd": quality.lead_statuses(odd)})


@query
def dq_lead_alignment(spark, sf_dir):
    return quality.lead_alignment(dataset(spark, sf_dir, "leads"), dataset(spark, sf_dir, "companies"))


@query
def dq_weblog_country(spark, sf_dir):
    logs = dataset(spark, sf_dir, "webserver_logs").where("username <> '-'").withColumn("country_code", F.concat(F.lit("N"), (F.substring("username", 2, 9).cast("long") % 25).cast("string")))
    homes = dataset(spark, sf_dir, "customers").join(dataset(spark, sf_dir, "companies").select(F.col("cuit").alias("company_cuit"), "country_code"), "company_cuit").select("username", "country_code")
    return quality.country_alignment(logs.select("username", "country_code"), homes, "username")


@query
def dq_weblog_mix(spark, sf_dir):
    return quality.weblog_mix(dataset(spark, sf_dir, "webserver_logs"))


# --- business rules


@query
def name_index(spark, sf_dir):
    return rules.name_index(dataset(spark, sf_dir, "companies").withColumn("name", F.when(F.col("cuit").endswith("7"), F.concat(F.lit(" CUSTOMER#"), F.substring("cuit", 2, 1))).otherwise(F.col("name"))))


@query
def lead_candidates(spark, sf_dir):
    leads = dataset(spark, sf_dir, "leads")
    converted = leads.where("status = 'Converted' and right(lead_id, 1) in ('3', '4')").select("lead_id")
    return rules.lead_candidates(leads, ts(EVENTS_AS_OF), converted=converted).select("lead_id", "created_at", "status")


@query
def lead_score(spark, sf_dir):
    leads = dataset(spark, sf_dir, "leads")
    score = rules.lead_score(ts(EVENTS_AS_OF))
    return leads.select("lead_id", "created_at", "status", "lead_source", "estimated_annual_revenue", (F.round(score * 1e9)).cast("long").alias("score_e9"))


@query
def lead_company_match(spark, sf_dir):
    out = rules.lead_company_match(dataset(spark, sf_dir, "leads"), dataset(spark, sf_dir, "companies"), dataset(spark, sf_dir, "ref_countries"))
    return out.select("lead_id", "created_at", "company_cuit", "matched_country")


@query
def customer_from_lead(spark, sf_dir):
    leads = dataset(spark, sf_dir, "leads").select("lead_id", "contact_name", "contact_email", "contact_phone")
    return rules.customers_from_leads(leads, dataset(spark, sf_dir, "customers"))


@query
def price_cascade(spark, sf_dir):
    out = rules.price_cascade(dataset(spark, sf_dir, "company_catalogs"), dataset(spark, sf_dir, "products"), "S1", 1.1)
    return out.withColumn("sale_price", cents("sale_price"))


@query
def returns_window(spark, sf_dir):
    return rules.returns_window(dataset(spark, sf_dir, "src_orders"), ts("2000-01-10 00:00:00")).select("id", "order_date")


@query
def trade_lanes(spark, sf_dir):
    """Lanes between customers' and suppliers' countries, named by codes of the region table."""
    codes = F.array(*[F.lit(c) for c in ("US", "ca", "GB", "DE", "CN", "JP", "ZZ", "")])
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 8).alias("a"), (F.col("l_suppkey") % 8).alias("b"))
    pairs = items.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.get(codes, F.col("a").cast("int")).alias("client"), F.get(codes, F.col("b").cast("int")).alias("supplier"), "n")
    return pairs.groupBy(trade_lane("client", "supplier").alias("lane")).agg(F.sum("n").alias("n"))


@query
def user_cohorts(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return first.select("user_id", user_cohort("last_seen", ts(EVENTS_AS_OF), 3).alias("cohort"))


@query
def lead_reconcile(spark, sf_dir):
    out = rules.lead_reconcile(dataset(spark, sf_dir, "leads"), dataset(spark, sf_dir, "companies"), ts(EVENTS_AS_OF))
    return out.select("lead_id", "created_at", "company_name", "country_code", "is_prospect", "status", "status_updated_at", "last_activity_at")


@query
def orderable_customers(spark, sf_dir):
    return rules.orderable_customers(dataset(spark, sf_dir, "customers"), dataset(spark, sf_dir, "company_catalogs")).select("id", "company_cuit")


@query
def conversion_ledger(spark, sf_dir):
    leads = dataset(spark, sf_dir, "leads").where("status = 'Converted'")
    made = leads.select("lead_id", "company_name", F.col("status_updated_at").alias("converted_at")).withColumn("company_cuit", F.lit(None).cast("string"))
    first = rules.append_conversions(made.limit(0), made.where(F.col("converted_at") < ts(EVENT_CUT)))
    return rules.append_conversions(first, made).select("lead_id", "converted_at")


# --- run history, made from the events as runs: a user's day is a run


def _history(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").otherwise("completed")
    return e.select(
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.lit("db").alias("source"), F.concat(F.lit("d"), (F.col("user_id") % 9).cast("string")).alias("dataset"), F.lit("raw").alias("stage"),
        status.alias("status"), F.col("event_id").alias("records"), (F.col("event_id") % 5).alias("bad_records"), F.col("ts").alias("updated_at"), F.col("event_id").cast("string").alias("value"),
    )


@query
def latest_watermark(spark, sf_dir):
    return runlog.watermark_states(_history(spark, sf_dir)).select("source", "dataset", "stage", "run_id", "value")


@query
def latest_run_state(spark, sf_dir):
    return runlog.run_states(_history(spark, sf_dir)).select("run_id", "dataset", "status", "records")


@query
def latest_completed_run(spark, sf_dir):
    h = _history(spark, sf_dir)
    marks = h.where("status = 'completed'").select("source", "dataset", "stage", "run_id", "value", "updated_at")
    return runlog.latest_completed_manifest(h.drop("value"), marks).select("dataset", "run_id", "watermark", "records")


@query
def run_coherence(spark, sf_dir):
    h = _history(spark, sf_dir)
    one = h.where(F.col("run_id") == "run-20240110")
    return runlog.run_coherence(h).unionAll(runlog.run_coherence(one))


@query
def manifest_metrics(spark, sf_dir):
    return runlog.manifest_metrics(_history(spark, sf_dir))


@query
def run_paths(spark, sf_dir):
    """Path lists of runs to rows and back."""
    h = runlog.run_states(_history(spark, sf_dir)).withColumn("paths", F.transform(F.sequence(F.lit(0), F.col("bad_records").cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string"))))
    back = runlog.rows_to_paths(runlog.paths_to_rows(h, "paths", "raw_path"))
    return back.select("run_id", "dataset", "path_kind", F.array_join("paths", ",").alias("paths"))


@query
def schema_snapshot(spark, sf_dir):
    orders = dataset(spark, sf_dir, "src_orders")
    return runlog.schema_snapshot(orders, orders.count()).select("column_index", "name", "n_rows")


# --- streams: two sets of files, loaded one after the other


#: The second set of files holds the clicks again.
LOG_PARTS = ("value not like '%/view%'", "value like '%/view%' or value like '%/click%'")


def _log_rows(batch: DataFrame) -> DataFrame:
    return ingest.parsed_weblogs(batch, RUN, INGESTED).select("event_id", "username", parse_ts_lenient("event_ts").alias("event_ts"), "request_path", "status_code")


@query
def stream_weblogs_upsert(spark, sf_dir):
    """Lines without an id get one of their file and line, so such a line is a row of its own in each file."""
    path, table_path, checkpoint = (work_folder(spark, n) for n in ("stream-logs", "logs-table", "stream-state"))
    t = merge.VersionedTable(spark, table_path)
    for part in LOG_PARTS:
        _log_lines(spark, sf_dir).where(part).write.mode("append").text(path)
        ingest.upsert_stream(ingest.stream_weblogs(spark, path), t, ["event_id"], _log_rows, ["event_ts"], checkpoint).awaitTermination()
    return t.read().withColumn("event_id", F.when(F.col("event_id").contains(":"), "made").otherwise(F.col("event_id")))


@query
def stream_bad_lines(spark, sf_dir):
    """Lines and bad lines of all batches, as their audit wrote them."""
    path, table_path, checkpoint, audit = (work_folder(spark, n) for n in ("stream-logs", "logs-table", "stream-state", "bad-lines"))
    t = merge.VersionedTable(spark, table_path)
    for part in LOG_PARTS:
        _log_lines(spark, sf_dir).where(part).write.mode("append").text(path)
        ingest.upsert_stream(ingest.stream_weblogs(spark, path), t, ["event_id"], _log_rows, ["event_ts"], checkpoint, audit=ingest.count_bad_lines(audit)).awaitTermination()
    return spark.read.parquet(audit).agg(F.sum("n_lines").alias("n_lines"), F.sum("n_bad").alias("n_bad"), F.countDistinct("batch").alias("batches"))


@query
def stream_two_into_one(spark, sf_dir):
    """Two streams with checkpoints of their own load one table; both begin at batch 0. Lines without an id are rows of their own, by file and line."""
    t = merge.VersionedTable(spark, work_folder(spark, "logs-table"))
    for part in LOG_PARTS:
        path, checkpoint = work_folder(spark, "stream-logs"), work_folder(spark, "stream-state")
        _log_lines(spark, sf_dir).where(part).write.text(path)
        ingest.upsert_stream(ingest.stream_weblogs(spark, path), t, ["event_id"], _log_rows, ["event_ts"], checkpoint).awaitTermination()
    return t.read().withColumn("event_id", F.when(F.col("event_id").contains(":"), "made").otherwise(F.col("event_id")))


@query
def stream_late_rows(spark, sf_dir):
    """Files of a second load hold rows up to the table's mark, too: by the exclusive policy these are late and left out."""
    path, table_path, checkpoint = (work_folder(spark, n) for n in ("stream-events", "events-table", "stream-state"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("event_ts"), "event_type")
    t = merge.VersionedTable(spark, table_path, cursors=("event_ts",))
    early = (F.col("event_ts") <= ts(EVENT_CUT)) & (F.col("event_id") % 4 != 0)
    for part in (early, ~early):
        events.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        ingest.upsert_stream(stream, t, ["event_id"], lambda d: d, ["event_ts"], checkpoint, late=ingest.after_mark("event_ts")).awaitTermination()
    return t.read().select("event_id", "event_type")


@query
def stream_leads_current(spark, sf_dir):
    path, table_path, checkpoint = (work_folder(spark, n) for n in ("stream-leads", "leads-table", "stream-state"))
    leads = _leads_text(spark, sf_dir)
    t = merge.VersionedTable(spark, table_path)

    def prepare(batch: DataFrame) -> DataFrame:
        return _clean_lead_columns(clean.required_filter(clean.align_to_contract(clean.prep_leads(batch), contracts.MARKETING_LEADS.schema), contracts.MARKETING_LEADS.required))

    for part in ("status in ('New', 'Lost')", "status not in ('New', 'Lost')"):
        leads.where(part).write.mode("append").option("header", True).csv(path)
        ingest.upsert_stream(ingest.stream_leads(spark, path), t, ["lead_id"], prepare, ["status_updated_at"], checkpoint).awaitTermination()
    return t.read()


@query
def stream_events_once(spark, sf_dir):
    """Events that arrive twice, deduplicated within the watermark's delay and written as files."""
    path, out, checkpoint = (work_folder(spark, n) for n in ("stream-events", "events-once", "stream-state"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("event_ts"), "event_type")
    events.unionAll(events).write.parquet(path)
    stream = ingest.stream_event_dedupe(spark.readStream.schema(events.schema).parquet(path), delay="40 days")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select("event_id", "event_type")


@query
def stream_newest_events(spark, sf_dir):
    """Events that come three times, the newest in the middle: the stream's table ends as the batch rule has it."""
    path, checkpoint = work_folder(spark, "stream-events"), work_folder(spark, "stream-state")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("event_ts"), "event_type")
    t = merge.VersionedTable(spark, work_folder(spark, "newest-table"), cursors=("event_ts",))
    for hours in (F.lit(0).cast("long"), 2 + F.col("event_id") % 3, F.lit(1).cast("long")):
        later = events.withColumn("event_ts", F.timestamp_add("HOUR", hours, "event_ts")).withColumn("event_type", F.concat_ws("+", "event_type", hours.cast("string")))
        later.write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        newest.upsert_newest(stream, t, "event_id", "event_ts", checkpoint, dt.timedelta(days=40)).awaitTermination()
    return t.read().select("event_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "event_type")


# --- whole runs


@query
def warehouse_build(spark, sf_dir):
    """All models, then their tests."""
    names = {"orders": "src_orders", "marketing_leads": "leads"}
    t = {n: dataset(spark, sf_dir, names.get(n, n)) for n in ("ref_countries", "companies", "products", "company_catalogs", "customers", "orders", "order_items", "marketing_leads", "webserver_logs")}
    return warehouse.build(spark, t, as_of=F.lit(AS_OF), loaded_at=_loaded())


@query
def ingestion_run(spark, sf_dir):
    """Two runs and a repeat of the second; a dataset without its key's column fails and leaves the others alone."""
    root = work_folder(spark, "ingestion")
    orders = dataset(spark, sf_dir, "src_orders")
    items = dataset(spark, sf_dir, "order_items").withColumn("quantity", F.when(F.col("id") % 10 == 1, None).otherwise(F.col("quantity")).cast("int"))
    odd = dataset(spark, sf_dir, "companies").withColumn("type", F.when(F.col("cuit").endswith("5"), None).otherwise(F.col("type")))
    broken = orders.select(F.raise_error(F.lit("no source")).cast("string").alias("code"), F.lit("x").alias("name"))
    ingestion.run(spark, [(contracts.ORDERS, orders.where(F.col("id") % 2 == 0)), (contracts.COMPANIES, odd)], root, "run-1")
    for _ in range(2):
        states = ingestion.run(spark, [(contracts.ORDERS, orders), (contracts.REF_COUNTRIES, broken), (contracts.ORDER_ITEMS, items)], root, "run-2")
    loaded = quality.row_counts({n: merge.VersionedTable(spark, f"{root}/tables/{n}").read() for n in ("orders", "companies", "order_items")})
    outcome = states.select(F.col("dataset").alias("table"), "status", "records", "bad_records")
    return loaded.join(outcome, "table", "full_outer")


@query
def ingestion_cursor_runs(spark, sf_dir):
    """Three runs over the sources from stored marks: a part of the rows, then all, then nothing new."""
    root = work_folder(spark, "cursor-runs")
    orders, items, countries = dataset(spark, sf_dir, "src_orders"), dataset(spark, sf_dir, "order_items").withColumn("quantity", F.col("quantity").cast("int")), dataset(spark, sf_dir, "ref_countries")
    first = [(contracts.ORDERS, orders.where(F.col("updated_at") <= ts(CUT))), (contracts.ORDER_ITEMS, items.where(F.col("id") <= 1_000_000)), (contracts.REF_COUNTRIES, countries)]
    whole = [(contracts.ORDERS, orders), (contracts.ORDER_ITEMS, items), (contracts.REF_COUNTRIES, countries)]
    states = None
    for run_id, sources in (("run-1", first), ("run-2", whole), ("run-3", whole)):
        one = ingestion.run_sources(spark, sources, root, run_id)
        one = ingestion.run_sources(spark, sources, root, run_id)  # repeated, it changes nothing
        states = one if states is None else states.unionAll(one)
    loaded = quality.row_counts({n: merge.VersionedTable(spark, f"{root}/tables/{n}").read() for n in ("orders", "order_items", "ref_countries")})
    paths = spark.read.parquet(f"{root}/history/paths").groupBy("run_id", "dataset").agg(F.count("*").alias("n_paths"))
    columns = spark.read.parquet(f"{root}/history/schemas").groupBy("run_id", "dataset").agg(F.count("*").alias("n_columns"))
    out = states.select("run_id", "dataset", "status", "records", "watermark_before", "watermark_after").join(paths, ["run_id", "dataset"]).join(columns, ["run_id", "dataset"])
    return out.join(loaded.select(F.col("table").alias("dataset"), "n_rows"), "dataset")


@query
def mart_tables(spark, sf_dir):
    """Marts as tables of a database, read back by name; a table that is asked for and absent is listed with no rows."""
    m, database = Models(spark, sf_dir), f"marts_{uuid.uuid4().hex[:12]}"
    location = work_folder(spark, "mart-tables")
    for name in ("dim_countries", "dim_companies", "fct_orders"):
        warehouse.materialize_table(m[name], name, database, location)
    made = {n: extract.warehouse_source(spark, n, database) for n in ("dim_countries", "dim_companies", "fct_orders")}
    missing = quality.missing_tables(made, (*made, "dim_absent"))
    return quality.row_counts({**made, **{n: warehouse.head_rows(made["dim_countries"], 0) for n in missing}, "peek": warehouse.head_rows(made["fct_orders"], 5)})


@query
def dq_conversions(spark, sf_dir):
    """Purchases as lead conversions, some with an unknown company, country or no time."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    side = F.when(F.col("event_id") % 5 == 0, "S").otherwise("C")
    c = e.select(
        F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("lead_id"), F.concat(side, F.col("user_id").cast("string")).alias("company_cuit"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("N"), (F.col("user_id") % 30).cast("string"))).alias("country_code"), F.when(F.col("event_id") % 10 != 1, F.col("ts")).alias("converted_at"),
    )
    return audit.run_audits(audit.business_audits({**_sources(spark, sf_dir), "lead_conversions": c})[-1:])


@query
def tolerant_flags(spark, sf_dir):
    texts = F.element_at(F.array(*[F.lit(x) for x in (" Yes ", "T", "1", "true", "no", None, "0", "yess")]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", tolerant_bool(texts).alias("flag"))


@query
def ingestion_runs_repeated(spark, sf_dir):
    """Raw rows and paths of two runs after each was repeated: those of the first time."""
    root = work_folder(spark, "repeated-runs")
    orders = dataset(spark, sf_dir, "src_orders")
    for run_id, df in (("run-1", orders.where(F.col("updated_at") <= ts(CUT))), ("run-1", orders), ("run-2", orders), ("run-1", orders), ("run-2", orders.limit(0))):
        ingestion.run_sources(spark, [(contracts.ORDERS, df)], root, run_id)
    paths = spark.read.parquet(f"{root}/history/paths")
    rows = files.scan_manifest(spark, [r["path"] for r in paths.collect()], orders.schema).select("id", "*", F.regexp_extract("_metadata.file_path", "run_id=([^/]+)", 1).alias("run_id"))
    counts = rows.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.sum("id").alias("ids"))
    return counts.join(paths.groupBy("run_id").agg(F.count("*").alias("n_paths")), "run_id")


def _named_file(lines: DataFrame, path: str) -> None:
    """Lines as one file of a given name."""
    beside = work_folder(lines.sparkSession, "named-file")
    lines.coalesce(1).write.text(beside)
    of = lines.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = of(beside).getFileSystem(lines.sparkSession._jsc.hadoopConfiguration())
    fs.mkdirs(of(path).getParent())
    fs.rename(fs.globStatus(of(f"{beside}/part-*"))[0].getPath(), of(path))


@query
def ingestion_file_runs(spark, sf_dir):
    """Log files in dated folders, read by runs from the stored cursor: two days, then the third, then nothing new; folders of past days aren't listed."""
    root, folder = work_folder(spark, "file-runs"), work_folder(spark, "dated-logs")
    record = F.struct(F.concat(F.lit("e"), "event_id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.concat(F.lit("/"), "event_type").alias("request_path"))
    lines = table(spark, sf_dir, "events").select("event_id", F.to_json(record).alias("value"))
    new = {"run-1": [(0, "2024-01-01"), (1, "day=20240102")], "run-2": [(2, "2024-01-03")], "run-3": []}
    states = None
    for run_id, days in new.items():
        for third, day in days:
            _named_file(lines.where(F.col("event_id") % 3 == third).select("value"), f"{folder}/{day}/access_2024010{third + 1}_000000.jsonl")
        one = ingestion.run_files(spark, [(contracts.WEBSERVER_LOGS, folder, files.scan_weblogs_jsonl)], root, run_id)
        states = one if states is None else states.unionAll(one)
    runs = states.select("run_id", "status", "records", F.substring_index("watermark_after", " ", 1).alias("cursor"))
    read = spark.read.parquet(f"{root}/history/files").groupBy("run_id").agg(F.count("*").alias("n_files"))
    n_rows = merge.VersionedTable(spark, f"{root}/tables/webserver_logs").read().count()
    listed = files.dated_files(spark, folder, "20240103_000000").count()
    return runs.join(read, "run_id", "left").withColumn("n_rows", F.lit(n_rows)).withColumn("listed", F.lit(listed))


@query
def write_sorted_lines(spark, sf_dir):
    """Log rows dumped as JSON lines in the order of a column, and read back: each file's first row follows the file before."""
    path = work_folder(spark, "sorted-lines")
    logs = dataset(spark, sf_dir, "webserver_logs").select("_source_line", "event_id")
    files.write_jsonl(logs, path, "_source_line")
    rows = spark.read.schema("_source_line long, event_id string").json(path).select("*", F.input_file_name().alias("file"))
    ranges = rows.groupBy("file").agg(F.min("_source_line").alias("low"), F.max("_source_line").alias("high"), F.count("*").alias("n"))
    ordered = ranges.withColumn("after", F.col("low") > F.coalesce(F.lag("high").over(W.orderBy("file")), F.lit(-1).cast("long")))
    return ordered.agg(F.sum("n").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("after").alias("in_order"))


# --- tables of versions


@query
def upsert_key_types(spark, sf_dir):
    """Upserts whose keys have another width, scale or type than the stored ones meet them by value."""
    orders = dataset(spark, sf_dir, "src_orders").select("id", "status", "order_date")
    out = None
    stored = {"bigint": "int", "decimal(12,2)": "decimal(18,4)", "date": "timestamp_ntz"}
    for i, (own, other) in enumerate(stored.items()):
        key = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")) if own == "date" else F.col("id")
        t = merge.VersionedTable(spark, work_folder(spark, "typed-table"))
        t.upsert(orders.select(key.cast(own).alias("k"), "id", "status"), ["k"], "first")
        t.upsert(orders.where("id % 10 = 0").select(key.cast(other).alias("k"), "id", F.lit("CHANGED").alias("status")), ["k"], "second")
        one = t.read().select(F.lit(i).alias("kind"), "id", "status")
        out = one if out is None else out.unionAll(one)
    return out


class _Interleaved(merge.VersionedTable):
    """A writer that another one overtakes between the writing of its rows and its commit."""

    meanwhile = None

    def _commit(self, entry, seen):
        if self.meanwhile:
            work, self.meanwhile = self.meanwhile, None
            work()
        return super()._commit(entry, seen)


@query
def upsert_two_writers(spark, sf_dir):
    """Three writers at once: two blind upserts follow one another, one whose rows were read is told, and reads again."""
    path = work_folder(spark, "shared-table")
    orders = dataset(spark, sf_dir, "src_orders").select("id", "status", F.lit(0).alias("times"))
    late, other = _Interleaved(spark, path), merge.VersionedTable(spark, path)
    late.meanwhile = lambda: other.upsert(orders.where("id % 4 = 1"), ["id"], "creates too")
    late.upsert(orders.where("id % 4 = 0"), ["id"], "creates")
    late.meanwhile = lambda: other.upsert(orders.where("id % 4 = 2"), ["id"], "second")
    late.upsert(orders.where("id % 4 = 3"), ["id"], "first")
    conflicts = 0
    late.meanwhile = lambda: other.upsert(other.read().where("id % 3 = 0").withColumn("times", F.col("times") + 1), ["id"], "counts")
    for _ in range(3):
        version = late.version()
        try:
            late.upsert(late.read().where("id % 2 = 0").withColumn("times", F.col("times") + 1), ["id"], "counts too", expected=version)
            break
        except merge.CommitConflict:
            conflicts += 1
    return late.read().withColumn("conflicts", F.lit(conflicts))


@query
def merge_on_read(spark, sf_dir):
    """Five daily deltas over a base: the rows before folding, with like deltas folded, and all in the base."""
    orders = dataset(spark, sf_dir, "src_orders").select("id", "status", "total_amount", "order_date")
    t = merge.VersionedTable(spark, work_folder(spark, "daily-table"), fold=9.0)
    t.upsert(orders, ["id"], "base")
    for day in range(5):
        t.upsert(orders.where(F.col("id") % (11 + day) == 0).select("id", F.lit(f"DAY{day}").alias("status"), "total_amount", "order_date"), ["id"], f"day-{day}", compact=False)
    out = t.read().withColumn("phase", F.lit("deltas"))
    assert t.compact() and len(t.state().deltas) == 1, "deltas of like sizes weren't folded"
    out = out.unionAll(t.read().withColumn("phase", F.lit("folded")))
    assert t.compact(everything=True) and not t.state().deltas, "deltas weren't folded into the base"
    return out.unionAll(t.read().withColumn("phase", F.lit("base")))


@query
def snapshot_difference(spark, sf_dir):
    """A snapshot replaces another by its difference: counts of each kind, and rows without a change are left unwritten."""
    customers = dataset(spark, sf_dir, "customers").select("id", "username", "email", "created_at")
    t = merge.VersionedTable(spark, work_folder(spark, "snapshot-table"), buckets=256)
    t.replace(customers, ["id"], "first")
    second = customers.where("id % 50 <> 1").withColumn("email", F.when(F.col("id") % 60 == 2, "new@example.com").otherwise(F.col("email"))).unionByName(customers.where("id % 70 = 3").withColumn("id", -F.col("id")))
    counts = t.replace(second, ["id"], "second")
    written = t.log().where("run_id = 'second'").first()["rows"]
    same = t.read().exceptAll(second).isEmpty() and second.exceptAll(t.read()).isEmpty()
    return counts.select("*", F.lit(same).alias("equal"), F.lit(written < second.count()).alias("some_left"))


@query
def file_skipping(spark, sf_dir):
    """The rows of some keys, with the number of files that were opened for them and of those there are."""
    items = dataset(spark, sf_dir, "order_items").select("id", "order_id", "quantity")
    t = merge.VersionedTable(spark, work_folder(spark, "skipping-table"), buckets=8)
    t.write(items, "whole", ["id"], rows_per_file=max(1, items.count() // 160))
    t.upsert(items.where("id % 97 = 0").withColumn("quantity", F.lit(0).cast("long")), ["id"], "delta")
    wanted = items.select(F.min("id").alias("id")).unionAll(items.select(F.max("id")))
    opened = sum(map(len, t.files_of(wanted).values()))
    present = t.stats().select("file").distinct().count()
    rows = t.read_keys(wanted)
    return rows.select("*", F.lit(opened <= 8).alias("few_opened"), F.lit(present >= 100).alias("many_present"))


# --- matches in time


@query
def price_then_valid(spark, sf_dir):
    """For each item the price of its company and product at the time of its order, from all that were ever listed."""
    m = Models(spark, sf_dir)
    items = m["stg_order_items"].join(m["stg_orders"].select("order_id", "company_cuit", "order_ts"), "order_id")
    listed = m["stg_company_catalogs"].withColumn("listed_at", F.when(F.col("product_id") % 3 == 0, F.col("updated_at")).otherwise(F.col("created_at")))
    items, listed = items.select("order_item_id", "company_cuit", "product_id", "order_ts"), listed.select("company_cuit", "product_id", "listed_at", "sale_price")
    found = asof.as_of_join(items, listed, ["company_cuit", "product_id"], "order_ts", "listed_at", ties=["sale_price"])
    return found.select("order_item_id", F.round(F.col("matched.sale_price") * 100).alias("sale_price"), F.col("matched.listed_at").alias("listed_at"))


@query
def last_view_before_purchase(spark, sf_dir):
    """For each purchase the user's last view before it; purchases before the first view have none."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views, purchases = (e.where(F.col("event_type") == t).drop("event_type") for t in ("view", "purchase"))
    found = asof.as_of_join(purchases, views, ["user_id"], "ts", "ts", ties=["event_id"], strict=True)
    return found.select("event_id", "user_id", F.col("matched.event_id").alias("view_id"), F.col("matched.ts").cast("timestamp_ntz").alias("viewed_at"))


@query
def eligible_customers(spark, sf_dir):
    """For each order how many of its company's users were known by then: the running number of the last one that is."""
    orders = Models(spark, sf_dir)["stg_orders"].select("order_id", "company_cuit", "order_ts")
    known = orders.select("company_cuit", F.add_months("order_ts", 6).cast("timestamp_ntz").alias("since"), F.col("order_id").alias("user_id"))
    numbered = known.withColumn("n", F.row_number().over(W.partitionBy("company_cuit").orderBy("since", "user_id")))
    found = asof.as_of_join(orders, numbered, ["company_cuit"], "order_ts", "since", ties=["user_id"])
    return found.select("order_id", F.coalesce("matched.n", F.lit(0)).alias("n_eligible"))


# --- reports kept by deltas


def _changed_orders(orders: DataFrame) -> DataFrame:
    """Every eleventh order cancelled, every thirteenth a month later, every seventeenth with the next customer's company."""
    i = F.col("order_id")
    moved = F.when(i % 17 == 0, F.concat(F.lit("C"), (F.col("customer_id") % 100 + 1).cast("string"))).otherwise(F.col("company_cuit"))
    status, date = F.when(i % 11 == 0, "CANCELLED").otherwise(F.col("order_status")), F.when(i % 13 == 0, F.add_months("order_date", 1)).otherwise(F.col("order_date"))
    return orders.where((i % 11 == 0) | (i % 13 == 0) | (i % 17 == 0)).withColumns({"order_status": status, "order_date": date, "company_cuit": moved})


def _reports_by_deltas(spark, sf_dir, *, logs: bool = False, sales: bool = False) -> tuple[rollup.ReportStore, Models]:
    """Reports after three merges: a half, the other half, and changes to both; the last one is repeated."""
    store, m = rollup.ReportStore(spark, work_folder(spark, "report-store")), Models(spark, sf_dir)
    orders, items, requests = m["stg_orders"], m["stg_order_items"], m["stg_webserver_logs"]
    if logs:
        changed = requests.where("_source_line % 5 = 0").withColumn("user_agent", F.lit("curl/9")).withColumn("username", F.when(F.col("_source_line") % 10 == 0, "-").otherwise(F.col("username")))
        for run, df in (("a", requests.where("_source_line % 2 = 0")), ("b", requests.where("_source_line % 2 = 1")), ("c", changed), ("c", changed)):
            store.merge_logs(df, run)
    if sales:
        items = staged(items, "order-items")  # its ids come from a window over the whole table
        for run, df in (("a", items.where("order_item_id % 3 <> 0")), ("b", items.where("order_item_id % 3 = 0"))):
            store.merge_items(df, run)
    if sales or not logs:
        for run, df in (("a", orders.where("order_id % 2 = 0")), ("b", orders.where("order_id % 2 = 1")), ("c", _changed_orders(orders)), ("c", _changed_orders(orders))):
            store.merge_orders(df, run)
    if sales:
        fewer = items.where("order_item_id % 7 = 0").withColumns({"quantity": F.col("quantity") + 1, "line_amount": F.col("line_amount") / 2})
        for _ in range(2):
            store.merge_items(fewer, "c")
    return store, m


@query
def monthly_sales_by_deltas(spark, sf_dir):
    store, _ = _reports_by_deltas(spark, sf_dir)
    return store.monthly_sales(F.lit(AS_OF))


@query
def top_devices_by_deltas(spark, sf_dir):
    store, _ = _reports_by_deltas(spark, sf_dir, logs=True)
    return store.top_devices()


@query
def top_products_by_deltas(spark, sf_dir):
    store, m = _reports_by_deltas(spark, sf_dir, logs=True, sales=True)
    return store.top_products_in_top_country(m["dim_customers"], m["dim_companies"], m["dim_products"])
