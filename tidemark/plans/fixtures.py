"""The source datasets as views over the driver's tables: one SQL text for Spark and for DuckDB.

Names in braces are the driver's tables; {ts} is the type of a timestamp without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "ref_countries": "select concat('N', cast(n_nationkey as varchar(10))) as code, n_name as name from {nation}",
    "companies": """
select concat('S', cast(s_suppkey as varchar(20))) as cuit, s_name as name, 'Supplier' as type, concat('N', cast(s_nationkey as varchar(10))) as country_code,
  cast('1995-01-01 00:00:00' as {ts}) as created_at, cast('1995-01-01 00:00:00' as {ts}) as updated_at from {supplier}
union all
select concat('C', cast(c_custkey as varchar(20))), c_name, 'Client', concat('n', cast(c_nationkey as varchar(10))),
  cast('1995-01-01 00:00:00' as {ts}), cast('1995-01-01 00:00:00' as {ts}) from {customer}""",
    "products": """
select p_partkey as id, p_name as name, concat('S', cast(ps.suppkey as varchar(20))) as supplier_cuit, p_retailprice as base_price,
  cast('1995-01-01 00:00:00' as {ts}) as created_at, cast('1995-01-01 00:00:00' as {ts}) as updated_at
from {part} left join (select l_partkey, min(l_suppkey) as suppkey from {lineitem} group by l_partkey) ps on l_partkey = p_partkey""",
    "company_catalogs": """
select concat('C', cast(o_custkey as varchar(20))) as company_cuit, l_partkey as product_id, l_extendedprice / l_quantity as sale_price,
  o_orderdate as created_at, l_shipdate as updated_at from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "customers": """
select c_custkey as id, concat('C', cast(c_custkey as varchar(20))) as company_cuit, concat('D', cast(c_custkey as varchar(20))) as document_number,
  concat('u', cast(c_custkey as varchar(20))) as username, c_mktsegment as first_name, c_name as last_name,
  concat('u', cast(c_custkey as varchar(20)), '@example.com') as email, cast(null as varchar(20)) as phone_number,
  cast('1980-01-01' as date) as birth_date, cast('1995-01-01 00:00:00' as {ts}) as created_at from {customer}""",
    "src_orders": """
select o_orderkey as id, concat('C', cast(o_custkey as varchar(20))) as company_cuit, o_custkey as customer_id,
  case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RETURNED' else 'CANCELLED' end as status,
  o_orderdate as order_date, o_totalprice as total_amount, o_orderdate as created_at, o_orderdate as updated_at from {orders}""",
    "order_items": """
select l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as id,
  l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity, l_extendedprice / l_quantity as unit_price from {lineitem}""",
    "webserver_logs": """
select concat('e', cast(event_id as varchar(20))) as event_id, ts as event_ts, cast(null as varchar(40)) as remote_host,
  case when event_type = 'signup' then '-' else concat('u', cast(user_id as varchar(20))) end as username, concat('/', event_type) as request_path,
  case when event_type = 'error' then (case when event_id % 2 = 0 then 500 else 404 end) when event_type = 'purchase' then 201 else 200 end as status_code,
  case event_id % 9 when 0 then '-' when 1 then 'Mozilla/5.0 (Windows NT 10.0)' when 2 then 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)'
    when 3 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X)' when 4 then 'Mozilla/5.0 (Linux; Android 14)'
    when 5 then 'Mozilla/5.0 (X11; Linux x86_64)' when 6 then 'Googlebot/2.1' when 7 then 'iPad tablet' else 'curl/8' end as user_agent,
  concat('run-', cast(cast(ts as date) as varchar(10))) as _ingestion_run_id, cast(cast(ts as date) as {ts}) as _ingested_at,
  'access.jsonl' as _source_file, event_id as _source_line from {events}""",
    "leads": """
select concat('L', cast(user_id as varchar(20))) as lead_id, ts as created_at, concat('Customer#', lpad(cast(user_id as varchar(20)), 9, '0')) as company_name,
  event_type <> 'purchase' as is_prospect, 'Retail' as industry, concat(' Ann  ', event_type) as contact_name,
  concat('u', cast(user_id * 7 as varchar(20)), '@example.com') as contact_email, cast(null as varchar(20)) as contact_phone,
  case event_id % 4 when 0 then 'Referral' when 1 then 'Webinar' when 2 then 'Cold Call' else 'Google Search' end as lead_source,
  value * 10000 as estimated_annual_revenue, concat('n', cast(user_id % 25 as varchar(10))) as country_code,
  case event_type when 'view' then 'New' when 'click' then 'Contacted' when 'signup' then 'Qualified' when 'error' then 'Lost' else 'Converted' end as status,
  ts as status_updated_at, ts as last_activity_at, 'leads.csv' as _source_file,
  concat('run-', cast(cast(ts as date) as varchar(10))) as _ingestion_run_id, cast(cast(ts as date) as {ts}) as _ingested_at from {events}""",
}

#: The key of a view's window over a table.
DEALT = {("order_items", "lineitem"): "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source dataset as a DataFrame.

    Tables of ``DEALT`` are dealt out before the view's window: else its results are
    shuffled beside the columns they are made from, and again for a join on the renamed key.
    """
    text = VIEWS[name].replace("{ts}", "timestamp_ntz")
    tables = {t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", text))}
    return spark.sql(text, **{t: df.repartition(DEALT[name, t]) if (name, t) in DEALT else df for t, df in tables.items()})


def duckdb_view(name: str) -> str:
    return re.sub(r"{(\w+)}", r"\1", VIEWS[name].replace("{ts}", "timestamp"))
