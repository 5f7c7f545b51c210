"""The same results in SQL, written apart from the DataFrame code and run by another engine (DuckDB)."""

from __future__ import annotations

import re

from tidemark.plans.fixtures import VIEWS, duckdb_view

T = "timestamp"
LOADED = "timestamp '2001-08-01 12:00:00'"


def money(expression: str) -> str:
    return f"round(({expression}) * 100) / 100"


MODELS = {
    "stg_ref_countries": "select trim(code) as country_code, trim(name) as country_name from ref_countries",
    "stg_companies": "select cuit as company_cuit, name as company_name, type as company_type, upper(country_code) as country_code, created_at, updated_at from companies",
    "stg_products": "select id::bigint as product_id, name as product_name, supplier_cuit, base_price::double as base_price, base_price::double as product_price, created_at, updated_at, false as is_food_item, false as is_drink_item from products",
    "stg_company_catalogs": "select company_cuit, product_id::bigint as product_id, sale_price::double as sale_price, created_at, updated_at from company_catalogs",
    "stg_customers": "select id::bigint as customer_id, company_cuit, document_number, username, first_name, last_name, trim(first_name || ' ' || last_name) as customer_name, email, phone_number, birth_date, created_at from customers",
    "stg_orders": "select id::bigint as order_id, company_cuit, customer_id, status as order_status, order_date as order_ts, order_date::date as order_date, total_amount as order_total, total_amount as subtotal, 0::double as tax_paid, created_at, updated_at from src_orders",
    "stg_order_items": "select id as order_item_id, order_id, product_id, quantity, unit_price, quantity * unit_price as line_amount from order_items where exists (select 1 from stg_orders o where o.order_id = order_items.order_id)",
    "stg_leads": "select lead_id, created_at, company_name, is_prospect, industry, contact_name, contact_email, contact_phone, lead_source, estimated_annual_revenue, upper(country_code) as country_code, status, status_updated_at, last_activity_at, _source_file, _ingestion_run_id, _ingested_at from leads",
    "stg_webserver_logs": "select event_id, event_ts, event_ts::date as event_date, remote_host, username, request_path, status_code::integer as status_code, user_agent, _source_file, _source_line, _ingestion_run_id, _ingested_at from webserver_logs",
    "dim_countries": "select country_code, country_name from stg_ref_countries",
    "dim_companies": "select s.company_cuit, s.company_name, s.company_type, s.country_code, d.country_name, s.created_at, s.updated_at from stg_companies s left join dim_countries d using (country_code)",
    "dim_customers": "select c.customer_id, c.company_cuit, d.company_name as customer_company_name, c.document_number, c.username, c.first_name, c.last_name, c.customer_name, c.email, c.phone_number, c.birth_date, c.created_at from stg_customers c left join dim_companies d using (company_cuit)",
    "dim_products": f"""select p.product_id, p.product_name, p.supplier_cuit, d.company_name as supplier_name, {money('p.base_price')} as base_price, {money('p.product_price')} as product_price,
  s.n as listed_by_company_count, {money('s.low')} as min_catalog_sale_price, {money('s.high')} as max_catalog_sale_price, {money('s.mean')} as avg_catalog_sale_price, p.created_at, p.updated_at
  from stg_products p left join dim_companies d on d.company_cuit = p.supplier_cuit
  left join (select product_id, count(distinct company_cuit) as n, min(sale_price) as low, max(sale_price) as high, avg(sale_price) as mean from stg_company_catalogs group by product_id) s on s.product_id = p.product_id""",
    "dim_datetime": """select strftime(d, '%Y%m%d')::bigint as date_key, d as date_day, year(d)::integer as year_num, quarter(d)::integer as quarter_num, month(d)::integer as month_num, monthname(d) as month_name,
  day(d)::integer as day_of_month, dayofyear(d)::integer as day_of_year, isodow(d)::integer as iso_day_of_week, dayname(d) as day_name, weekofyear(d)::integer as iso_week_of_year, isodow(d) > 5 as is_weekend,
  date_trunc('month', d)::date as month_start_date, date_trunc('year', d)::date as year_start_date, d::timestamp as day_start_ts, d::timestamp + interval 86399 second as day_end_ts
  from (select unnest(generate_series(least((select min(order_date) from stg_orders), (select min(event_date) from stg_webserver_logs))::timestamp,
    greatest((select max(order_date) from stg_orders), (select max(event_date) from stg_webserver_logs))::timestamp, interval 1 day))::date as d)""",
    "fct_orders": f"""select o.order_id, o.customer_id, o.company_cuit, o.order_status, o.order_ts, o.order_date, o.order_total, count(i.order_item_id) as order_item_count,
  coalesce(sum(i.quantity), 0)::bigint as total_quantity, {money('coalesce(sum(i.line_amount), 0)')} as total_line_amount, o.updated_at as source_updated_at, {LOADED} as loaded_at
  from stg_orders o left join stg_order_items i on i.order_id = o.order_id group by all""",
    "fct_order_items": f"""select i.order_item_id, i.order_id, o.order_ts, o.order_date, o.customer_id, o.company_cuit, i.product_id, p.product_name, p.supplier_cuit, i.quantity, {money('i.unit_price')} as unit_price, {money('i.line_amount')} as line_amount,
  {money('coalesce(i.quantity * p.base_price, 0)')} as estimated_base_cost, {money('i.line_amount - coalesce(i.quantity * p.base_price, 0)')} as estimated_margin, {LOADED} as loaded_at
  from stg_order_items i left join stg_orders o on o.order_id = i.order_id left join stg_products p on p.product_id = i.product_id""",
    "fct_catalog_prices": f"""select distinct on (company_cuit, product_id) company_cuit, product_id, {money('sale_price')} as current_sale_price, created_at, updated_at, {LOADED} as loaded_at
  from stg_company_catalogs order by company_cuit, product_id, coalesce(updated_at, created_at) desc, created_at desc, sale_price desc""",
    "name_company": "select distinct on (lower(company_name)) lower(company_name) as k, company_cuit, company_type from dim_companies order by lower(company_name), company_type <> 'Client', updated_at desc, created_at desc, company_cuit",
    "fct_leads_current": f"""select l.lead_id, l.company_name, c.company_cuit, c.company_type, l.is_prospect, l.industry, l.contact_name, l.contact_email, l.contact_phone, l.lead_source, l.estimated_annual_revenue, l.country_code,
  l.status, l.created_at, l.status_updated_at, l.last_activity_at, l._ingestion_run_id, l._ingested_at, {LOADED} as loaded_at
  from (select distinct on (lead_id) * from stg_leads order by lead_id, _ingested_at desc, _ingestion_run_id desc, status_updated_at desc, created_at desc, status desc, estimated_annual_revenue desc, lead_source desc) l
  left join name_company c on c.k = lower(l.company_name)""",
    "fct_leads_history": f"select lead_id, company_name, is_prospect, industry, contact_name, contact_email, contact_phone, lead_source, estimated_annual_revenue, country_code, status, created_at, status_updated_at, last_activity_at, _ingestion_run_id, _ingested_at, {LOADED} as loaded_at from stg_leads",
    "fct_webserver_logs": f"""select event_id, event_ts, event_date, remote_host, username, request_path, status_code, case when status_code >= 200 and status_code < 600 then (status_code // 100)::varchar || 'xx' else 'other' end as status_class,
  coalesce(status_code >= 400, false) as is_error, user_agent, _ingestion_run_id, _ingested_at, {LOADED} as loaded_at from stg_webserver_logs""",
}
CTES = {**{n: duckdb_view(n) for n in VIEWS}, **MODELS}


def full(body: str, extra: dict[str, str] | None = None) -> str:
    """The body with the views and models that it names, directly or not, as common table expressions."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str, own: str = "") -> None:
        for n in known:
            if n not in needed and n != own and re.search(rf"\b{n}\b", text):
                needed.add(n)
                visit(known[n], n)

    visit(body)
    order: list[str] = []

    def place(n: str) -> None:
        if n not in order:
            for k in known:
                if k != n and k in needed and re.search(rf"\b{k}\b", known[n]):
                    place(k)
            order.append(n)

    for n in known:
        if n in needed:
            place(n)
    return ("with " + ",\n".join(f"{n} as ({known[n]})" for n in order) + "\n" if order else "") + body


STAGED_MONEY = {"stg_order_items": ["unit_price", "line_amount"], "stg_company_catalogs": ["sale_price"]}
ORACLE: dict[str, str] = {}
for _n in MODELS:
    if _n != "name_company":
        cols = STAGED_MONEY.get(_n)
        ORACLE[_n] = full(f"select * replace ({', '.join(f'{money(c)} as {c}' for c in cols)}) from {_n}" if cols else f"select * from {_n}")

CUT = "timestamp '1998-06-01 00:00:00'"
EVENT_CUT = "timestamp '2024-01-15 00:00:00'"
DAY = "timestamp '2024-01-31 00:00:00'"
# A merge: the rows from the target's mark on, and the target's other rows, of which some are changed and some missing.
MERGED = "select * from delta union all select * from old where not exists (select 1 from delta d where d.{key} = old.{key})"
ORACLE["inc_orders"] = full(f"""
, old as (select * replace (case when order_id % 3 = 0 then 'STALE' else order_status end as order_status) from fct_orders where source_updated_at <= {CUT} and order_id % 7 <> 0),
delta as (select * from fct_orders where source_updated_at >= (select max(source_updated_at) from old))
{MERGED.format(key='order_id')}""")
ORACLE["inc_order_items"] = full(f"""
, old as (select * replace (case when order_item_id % 3 = 0 then 0 else quantity end as quantity) from fct_order_items
  where order_item_id <= (select max(order_item_id) // 2 from stg_order_items) and order_item_id % 7 <> 0),
delta as (select * from fct_order_items where order_item_id > (select max(order_item_id) from old))
{MERGED.format(key='order_item_id')}""")
ORACLE["inc_catalog_prices"] = full(f"""
, mark as (select max(updated_at) as top from stg_company_catalogs where updated_at <= {CUT}),
old as (select distinct on (company_cuit, product_id) * from stg_company_catalogs where updated_at <= {CUT} order by company_cuit, product_id, updated_at desc, created_at desc, sale_price desc),
delta as (select distinct on (company_cuit, product_id) * from stg_company_catalogs where updated_at >= (select top from mark) order by company_cuit, product_id, updated_at desc, created_at desc, sale_price desc),
merged as (select * from delta union all select * from old where not exists (select 1 from delta d where d.company_cuit = old.company_cuit and d.product_id = old.product_id))
select company_cuit, product_id, {money('sale_price')} as current_sale_price, created_at, updated_at, {LOADED} as loaded_at from merged""")
ORACLE["inc_leads_current"] = full("select * from fct_leads_current union all select * replace ('X' || lead_id as lead_id, 'STALE' as status) from fct_leads_current where lead_id like '%3'")
ORACLE["inc_leads_history"] = full(f"""
, mark as (select max(_ingested_at) as top from stg_leads where _ingested_at <= {EVENT_CUT})
select * from fct_leads_history where _ingested_at <= {EVENT_CUT} union all select * from fct_leads_history where _ingested_at > (select top from mark)""")
ORACLE["inc_webserver_logs"] = full(f"""
, numbered as (select *, substr(event_id, 2)::bigint as n from fct_webserver_logs),
old as (select * exclude (n) replace (case when n % 3 = 0 then '/stale' else request_path end as request_path) from numbered where _ingested_at <= {EVENT_CUT} and n % 7 <> 0),
delta as (select * exclude (n) from numbered where _ingested_at > (select max(_ingested_at) from old)
  union all select * exclude (n) replace (timestamp '2024-02-05' as _ingested_at, 503 as status_code, '5xx' as status_class, true as is_error) from numbered where _ingested_at <= {EVENT_CUT} and n % 17 = 0)
{MERGED.format(key='event_id')}""")

ORACLE["monthly_sales"] = full(f"""
, s as (select date_trunc('month', order_date)::date as month_start, sum(order_total) filter (order_status = 'COMPLETED') as g, coalesce(sum(order_total) filter (order_status = 'RETURNED'), 0) as r,
  count(*) filter (order_status = 'COMPLETED') as completed_orders, count(*) filter (order_status = 'RETURNED') as returned_orders, count(*) filter (order_status = 'CANCELLED') as cancelled_orders
  from fct_orders where order_date >= date '2000-09-01' and order_date < date '2001-09-01' group by 1)
select month_start, {money('g')} as gross_sales_amount, {money('r')} as returned_amount, {money('g - r')} as net_sales_amount, completed_orders, returned_orders, cancelled_orders from s where g > 0""")
ORACLE["top_devices"] = full("""
, f as (select username, case when coalesce(trim(user_agent), '') in ('', '-') then 'Unknown' when regexp_matches(lower(user_agent), 'bot|crawler|spider') then 'Bot/Crawler' when user_agent ilike '%iphone%' then 'iPhone'
  when user_agent ilike '%android%' then 'Android' when regexp_matches(lower(user_agent), 'ipad|tablet') then 'Tablet' when user_agent ilike '%windows%' then 'Windows Desktop'
  when regexp_matches(lower(user_agent), 'macintosh|mac os') then 'Mac Desktop' when user_agent ilike '%linux%' then 'Linux Desktop' else 'Other' end as device_family from fct_webserver_logs where username <> '-')
select device_family, count(*) as request_count, count(distinct username) as unique_users from f group by 1 order by 2 desc, 3 desc, 1 limit 5""")
ORACLE["top_products_in_top_country"] = full(f"""
, c as (select coalesce(d.country_name, 'Unknown') as country_name, count(*) as n, count(distinct l.username) as u from fct_webserver_logs l join dim_customers k on k.username = l.username left join dim_companies d on d.company_cuit = k.company_cuit group by 1),
best as (select country_name from c order by n desc, u desc, country_name limit 1)
select d.country_name, i.product_id, i.product_name, sum(i.quantity)::bigint as total_units_sold, {money('sum(s.line_amount)')} as total_sales_amount, count(distinct i.order_id) as order_count
from fct_order_items i join stg_order_items s on s.order_item_id = i.order_item_id join fct_orders o on o.order_id = i.order_id join dim_companies d on d.company_cuit = o.company_cuit join best b on b.country_name = d.country_name
group by 1, 2, 3 order by 4 desc, 5 desc, 3, 2 limit 10""")

ORACLE["window_timestamp"] = full(f"select * from src_orders where updated_at > {CUT} and updated_at <= timestamp '1999-01-01'")
ORACLE["window_id"] = full("select id, order_id, product_id, quantity from order_items where id between 1000001 and 2000000")
ORACLE["window_empty"] = full("select * from src_orders where false")
ORACLE["full_snapshot"] = full("select * from ref_countries")
ORACLE["high_watermark"] = full("select max(updated_at) as high_watermark from src_orders")

SECOND = "date_trunc('second', ts)"
PARSED = f"case event_id % 7 when 2 then {SECOND} + interval 250 millisecond when 5 then null when 6 then null else {SECOND} end"
ORACLE["parse_ts"] = f"select event_id, {PARSED} as parsed, case when event_id % 7 = 4 then {SECOND} - interval 2 hour else {PARSED} end as parsed_utc from events"
ORACLE["required_filter_counts"] = "select event_type, count(*) as n_rows, count(*) filter (event_id % 7 >= 5) as n_bad, nullif(count(*) filter (event_id % 7 < 5), 0) as n_good from events group by 1"
ORACLE["align_contract"] = full("select cuit, name, type, null::varchar as country_code, created_at, updated_at, 'x' as _source_file from companies")
ORACLE["decimals_to_double"] = full("select id, base_price::decimal(12,2)::double as base_price from products")
CLEAN_LEADS = """
, t as (select lead_id, date_trunc('second', created_at) as created_at, company_name, is_prospect, industry, lead_source, round(estimated_annual_revenue)::double as estimated_annual_revenue, upper(country_code) as country_code, status, date_trunc('second', status_updated_at) as status_updated_at, contact_email, date_trunc('second', last_activity_at) as last_activity_at from leads where right(lead_id, 1) <> '7')
select distinct on (lead_id) lead_id, created_at, company_name, is_prospect, lead_source, estimated_annual_revenue, country_code, status, status_updated_at from t
order by lead_id, status_updated_at desc, company_name desc, contact_email desc, country_code desc, created_at desc, estimated_annual_revenue desc, industry desc, is_prospect desc, last_activity_at desc, lead_source desc, status desc"""
ORACLE["clean_leads"] = full(CLEAN_LEADS)
ORACLE["capture_leads_csv"] = full(CLEAN_LEADS)
ORACLE["clean_weblogs"] = full("select event_id, username, date_trunc('second', event_ts) as event_ts, user_agent, request_path, nullif(status_code, 201)::bigint as status_code, _source_line from webserver_logs")
ORACLE["capture_weblogs_jsonl"] = full("select case when _source_line % 11 = 0 then 'made' else event_id end as event_id, username, date_trunc('second', event_ts) as event_ts, request_path, status_code::varchar as status_code, user_agent, 'run-1' as _ingestion_run_id, '2024-02-01 00:00:00' as _ingested_at from webserver_logs")
ORACLE["bad_line_count"] = "select count(*) + count(*) filter (event_id % 50 = 0) + count(*) filter (event_id % 90 = 0) as n_lines, count(*) filter (event_id % 50 = 0) + count(*) filter (event_id % 90 = 0) as n_bad from events"
ORACLE["source_line_numbers"] = "select count(*) + count(*) filter (event_id % 50 = 0) + count(*) filter (event_id % 70 = 0) + count(*) filter (event_id % 90 = 0) as n_lines, true as dense from events"
NAMES = """
, p as (select distinct case when event_id % 10 = 0 then '/in/seed/access_' || event_id || '.jsonl' else '/in/daily/access_' || strftime(ts, '%Y%m%d_%H%M') || '00.jsonl' end as path from events),
f as (select path, coalesce(nullif(regexp_extract(parse_filename(path), '[0-9]{8}_[0-9]{6}'), ''), '99999999_999999') as file_ts from p)
"""
ORACLE["new_files_after_cursor"] = "with" + NAMES.replace(", p as", " p as", 1) + "select * from f where case when file_ts = '99999999_999999' then path > '/in/daily/access_20240115_120000.jsonl' else file_ts > '20240115_120000' end"
ORACLE["latest_file"] = "with" + NAMES.replace(", p as", " p as", 1) + "select max(path) as path from f"
ORACLE["file_listing"] = "select true as found, true as distinct_paths, false as any_dated"
ORACLE["manifest_read"] = full("select * from src_orders where status = 'RETURNED'")

ORACLE["dedupe_latest_lineitem"] = "select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_discount desc, l_linestatus desc, l_quantity desc, l_returnflag desc, l_tax desc"
ORACLE["dedupe_per_file"] = "select user_id, event_type as _source_file, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id, event_type"
ORACLE["upsert_orders"] = full(", t as (select * from src_orders where id % 10 = 0), b as (select * replace ('CANCELLED' as status) from t union all select * replace (-id - 1 as id) from t)\nselect * from b union all select * from src_orders o where not exists (select 1 from b where b.id = o.id)")
ORACLE["upsert_versions"] = ORACLE["upsert_orders"]
ORACLE["upsert_by_path"] = "with e as (select event_id, user_id, case when event_id % 2 = 0 then 'a' else 'b' end as _source_file from events) select event_id, user_id, _source_file from e where _source_file = (select max(_source_file) from e x where x.user_id = e.user_id)"
ORACLE["replace_snapshot"] = full("select * from ref_countries")
ORACLE["multi_target_leads"] = full("select 'history' as target, count(distinct (lead_id, _ingestion_run_id)) as n_rows, count(distinct lead_id) as n_leads, max(status_updated_at) as newest from leads union all select 'current', count(distinct lead_id), count(distinct lead_id), max(status_updated_at) from leads")

CHECKS = {
    "company_country": "select 1 from companies where upper(country_code) is null or upper(country_code) not in (select code from ref_countries)",
    "company_type": "select 1 from companies where type is null or type not in ('Supplier', 'Client')",
    "product_supplier": "select 1 from products where not exists (select 1 from companies where cuit = supplier_cuit)",
    "product_supplier_type": "select 1 from products p join companies c on c.cuit = p.supplier_cuit where c.type <> 'Supplier'",
    "customer_company": "select 1 from customers where not exists (select 1 from companies where cuit = company_cuit)",
    "customer_company_type": "select 1 from customers k join companies c on c.cuit = k.company_cuit where c.type <> 'Client'",
    "catalog_company": "select 1 from company_catalogs where not exists (select 1 from companies where cuit = company_cuit)",
    "catalog_company_type": "select 1 from company_catalogs k join companies c on c.cuit = k.company_cuit where c.type <> 'Client'",
    "catalog_product": "select 1 from company_catalogs k where not exists (select 1 from products p where p.id = k.product_id)",
    "order_customer": "select 1 from src_orders o where not exists (select 1 from customers c where c.id = o.customer_id)",
    "order_company": "select 1 from src_orders where not exists (select 1 from companies where cuit = company_cuit)",
    "order_company_is_customers": "select 1 from src_orders o join customers c on c.id = o.customer_id where c.company_cuit <> o.company_cuit",
    "order_status": "select 1 from src_orders where status is null or status not in ('COMPLETED', 'CANCELLED', 'RETURNED')",
    "order_total_positive": "select 1 from src_orders where not coalesce(total_amount > 0, false)",
    "item_order": "select 1 from order_items i where not exists (select 1 from src_orders o where o.id = i.order_id)",
    "item_product": "select 1 from order_items i where not exists (select 1 from products p where p.id = i.product_id)",
    "item_quantity_positive": "select 1 from order_items where not coalesce(quantity > 0, false)",
    "item_price_positive": "select 1 from order_items where not coalesce(unit_price > 0, false)",
    "item_in_catalog": "select 1 from order_items i join src_orders o on o.id = i.order_id where not exists (select 1 from company_catalogs k where k.company_cuit = o.company_cuit and k.product_id = i.product_id)",
    "order_total_is_items": f"select 1 from src_orders o join (select order_id, {money('sum(quantity * unit_price)')} as t from order_items group by 1) i on i.order_id = o.id where abs(o.total_amount - i.t) > 0.05",
    "username_unique": "select 1 from customers group by username having count(*) > 1",
    "email_unique": "select 1 from customers group by email having count(*) > 1",
    "no_time_travel": "select 1 from src_orders o join customers c on c.id = o.customer_id where o.order_date < c.created_at",
}


def checks(bodies: dict[str, str]) -> str:
    rows = " union all ".join(f"select '{k}' as check, (select count(*) from ({v})) as issues" for k, v in bodies.items())
    return f"select *, issues = 0 as ok from ({rows})"


ORACLE["dq_business"] = full(checks(CHECKS))
BROKEN = {
    "companies": f"select * replace (case cuit when 'C2' then 'Partner' when 'C3' then 'Supplier' else type end as type) from ({duckdb_view('companies')}) where cuit not in ('C1', 'S1')",
    "products": f"select * from ({duckdb_view('products')}) where id % 100 <> 0",
    "src_orders": f"select * replace (case when id % 500 = 1 then 0 else total_amount end as total_amount) from ({duckdb_view('src_orders')}) where id % 1000 <> 0",
    "customers": f"select * replace (case when id % 50 = 0 then 'x@example.com' else email end as email) from ({duckdb_view('customers')}) where id <> 5",
}
ORACLE["dq_business_broken"] = full(checks(CHECKS), BROKEN)
GENERIC = {}
for _m, _k in {"dim_companies": "company_cuit", "dim_customers": "customer_id", "dim_products": "product_id", "dim_datetime": "date_key", "dim_countries": "country_code", "fct_orders": "order_id", "fct_order_items": "order_item_id", "fct_leads_current": "lead_id", "fct_webserver_logs": "event_id"}.items():
    shown = _m.replace("fct_leads_current", "fct_marketing_leads_current")
    GENERIC[f"{shown}.{_k}.not_null"] = f"select 1 from {_m} where {_k} is null"
    GENERIC[f"{shown}.{_k}.unique"] = f"select 1 from {_m} where {_k} is not null group by {_k} having count(*) > 1"
for _c, _f, _p, _k in [("dim_companies", "country_code", "dim_countries", "country_code"), ("dim_customers", "company_cuit", "dim_companies", "company_cuit"), ("dim_products", "supplier_cuit", "dim_companies", "company_cuit"), ("fct_orders", "customer_id", "dim_customers", "customer_id"), ("fct_orders", "company_cuit", "dim_companies", "company_cuit"), ("fct_order_items", "order_id", "fct_orders", "order_id"), ("fct_order_items", "product_id", "dim_products", "product_id"), ("fct_leads_current", "company_cuit", "dim_companies", "company_cuit")]:
    shown = _c.replace("fct_leads_current", "fct_marketing_leads_current")
    GENERIC[f"{shown}.{_f}.in.{_p}"] = f"select 1 from {_c} a where a.{_f} is not null and not exists (select 1 from {_p} b where b.{_k} = a.{_f})"
GENERIC["dim_companies.company_type.accepted"] = "select 1 from dim_companies where company_type not in ('Supplier', 'Client')"
ORACLE["dq_generic"] = full(checks(GENERIC))
ORACLE["dq_row_counts"] = full(" union all ".join(f"select '{k}' as \"table\", count(*) as n_rows from {v}" for k, v in {"ref_countries": "ref_countries", "companies": "companies", "products": "products", "company_catalogs": "company_catalogs", "customers": "customers", "orders": "src_orders", "order_items": "order_items"}.items()))
ORACLE["dq_country_share"] = full("select count(*) as n_rows, avg((upper(country_code) in ('N1', 'N2', 'N3', 'N4', 'N5'))::integer) as share, avg((upper(country_code) in ('N1', 'N2', 'N3', 'N4', 'N5'))::integer) >= 0.18 as ok from companies")
ORACLE["dq_lead_status"] = full("select 'lead_status' as check, 0::bigint as issues, true as ok union all select 'lead_status_odd', count(*), count(*) = 0 from leads where status = 'Lost'")
ORACLE["dq_lead_alignment"] = full("""
, j as (select (upper(l.country_code) = upper(c.country_code))::integer as same from leads l join companies c on c.name = l.company_name where not l.is_prospect)
select count(*) as comparable, avg(same) as ratio, coalesce(avg(same) >= 0.9, true) as ok from j""")
ORACLE["dq_weblog_country"] = full("""
, j as (select (substr(l.username, 2)::bigint % 25 = n.c_nationkey)::integer as same from webserver_logs l join customers k on k.username = l.username join customer n on n.c_custkey = k.id where l.username <> '-')
select count(*) as comparable, avg(same) as ratio, coalesce(avg(same) >= 0.9, true) as ok from j""")
ORACLE["dq_weblog_mix"] = full("select username <> '-' as authenticated, count(*) as n_rows from webserver_logs group by 1")

ORACLE["name_index"] = full("""
, c as (select *, lower(trim(case when cuit like '%7' then ' CUSTOMER#' || substr(cuit, 2, 1) else name end)) as name_key, trim(case when cuit like '%7' then ' CUSTOMER#' || substr(cuit, 2, 1) else name end) as shown from companies where type = 'Client')
select name_key, min(cuit) as cuit, min(shown) as name, min(upper(country_code)) as country_code from c group by name_key having count(distinct cuit) = 1""")
ORACLE["lead_candidates"] = full(f"select lead_id, created_at, status from leads where is_prospect and status <> 'Lost' and status_updated_at >= {DAY} - interval 7 day and lead_id not in (select lead_id from leads where status = 'Converted' and right(lead_id, 1) in ('3', '4'))")
ORACLE["lead_score"] = full(f"""
, a as (select *, greatest(0, floor(date_diff('second', date_trunc('second', status_updated_at), {DAY}) / 86400)) as whole, greatest(0, floor((epoch({DAY}) - epoch(status_updated_at)) / 86400)) as days from leads)
select lead_id, created_at, status, lead_source, estimated_annual_revenue, case when status in ('Lost', 'Converted') then 0 else
round(least(0.2, greatest(0.001, case status when 'New' then 0.002 when 'Contacted' then 0.008 else 0.03 end::double * case lead_source when 'Referral' then 1.35 when 'Webinar' then 1.2 when 'Cold Call' then 0.8 else 1 end::double
* (0.8::double + least(1, estimated_annual_revenue / 1000000) * 0.6::double) * case when days <= 3 then 1.15 when days <= 7 then 1.3 when days <= 14 then 0.85 else 0.55 end::double)) * 1e9) end::bigint as score_e9 from a""")
ORACLE["lead_company_match"] = full("select l.lead_id, l.created_at, c.cuit as company_cuit, upper(c.country_code) as matched_country from leads l join companies c on c.type = 'Client' and lower(c.name) = lower(l.company_name)")
ORACLE["customer_from_lead"] = full("""
, m as (select distinct lead_id, 'Ann' as first_name, trim(replace(contact_name, 'Ann', '')) as last_name, lower(contact_email) as mail from leads),
free as (select mail, min(lead_id) as lead_id from m where mail not in (select lower(email) from customers) group by mail)
select m.lead_id, m.first_name, m.last_name, null::varchar as phone_number, free.mail as email from m left join free on free.mail = m.mail and free.lead_id = m.lead_id""")
ORACLE["price_cascade"] = full(f"select c.company_cuit, c.product_id, {money('case when p.id is not null then p.base_price * 1.1::double * 1.4::double else c.sale_price end')} as sale_price, c.created_at, c.updated_at from company_catalogs c left join products p on p.id = c.product_id and p.supplier_cuit = 'S1'")
ORACLE["returns_window"] = full("select id, order_date from src_orders where status = 'COMPLETED' and order_date between timestamp '2000-01-03' and timestamp '2000-01-07'")
ORACLE["trade_lanes"] = """
with k as (select * from (values (0, 'US', 'AMER'), (1, 'CA', 'AMER'), (2, 'GB', 'EMEA'), (3, 'DE', 'EMEA'), (4, 'CN', 'APAC'), (5, 'JP', 'APAC'), (6, 'ZZ', 'ROW'), (7, null, 'ROW')) t(i, code, region))
select case when a.code = b.code then 'domestic' when a.region = b.region then 'regional' else 'global' end as lane, count(*) as n from lineitem join k a on a.i = l_orderkey % 8 join k b on b.i = l_suppkey % 8 group by 1"""
ORACLE["user_cohorts"] = f"select user_id, case when max(ts) >= {DAY} - interval 3 day then 'new' else 'returning' end as cohort from events group by 1"
ORACLE["lead_reconcile"] = full(f"""
, j as (select l.*, c.name as own, upper(c.country_code) as home from leads l left join companies c on c.type = 'Client' and lower(c.name) = lower(l.company_name)),
s as (select *, case when own is not null and is_prospect then 'Converted' when own is not null and status not in ('Qualified', 'Lost', 'Converted') then 'Qualified' else status end as next from j)
select lead_id, created_at, coalesce(own, company_name) as company_name, coalesce(home, country_code) as country_code, is_prospect and own is null as is_prospect, next as status,
case when next <> status then {DAY} else status_updated_at end as status_updated_at, case when next <> status then {DAY} else status_updated_at end as last_activity_at from s""")
ORACLE["orderable_customers"] = full("select id, company_cuit from customers where company_cuit in (select company_cuit from company_catalogs)")
ORACLE["conversion_ledger"] = full(f"select lead_id, min(status_updated_at) as converted_at from leads where status = 'Converted' and status_updated_at >= {EVENT_CUT} and lead_id not in (select lead_id from leads where status = 'Converted' and status_updated_at < {EVENT_CUT}) group by 1 union all select lead_id, min(status_updated_at) from leads where status = 'Converted' and status_updated_at < {EVENT_CUT} group by 1")

HISTORY = {"h": "select 'run-' || strftime(ts, '%Y%m%d') as run_id, 'db' as source, 'd' || (user_id % 9) as dataset, 'raw' as stage, case event_type when 'error' then 'failed' when 'view' then 'started' else 'completed' end as status, event_id as records, event_id % 5 as bad_records, ts as updated_at, event_id::varchar as value from events",
           "state": "select distinct on (run_id, source, dataset, stage) * from h order by run_id, source, dataset, stage, updated_at desc, bad_records desc, records desc, status desc"}
ORACLE["latest_watermark"] = full("select distinct on (source, dataset, stage) source, dataset, stage, run_id, value from h order by source, dataset, stage, updated_at desc, bad_records desc, records desc", HISTORY)
ORACLE["latest_run_state"] = full("select run_id, dataset, status, records from state", HISTORY)
ORACLE["latest_completed_run"] = full(", m as (select distinct on (source, dataset, stage) * from h where status = 'completed' order by source, dataset, stage, updated_at desc, run_id desc, value desc)\nselect m.dataset, m.run_id, m.value as watermark, state.records from m join state on state.run_id = m.run_id and state.dataset = m.dataset where state.status = 'completed'", HISTORY)
ORACLE["run_coherence"] = full("select count(distinct run_id) as n_runs, count(distinct run_id) <= 1 as coherent from h union all select count(distinct run_id), count(distinct run_id) <= 1 from h where run_id = 'run-20240110'", HISTORY)
ORACLE["manifest_metrics"] = full("select run_id, stage, count(distinct dataset) as datasets, sum(records)::bigint as records, sum(bad_records)::bigint as bad_records from state group by 1, 2", HISTORY)
ORACLE["run_paths"] = full("select run_id, dataset, 'raw_path' as path_kind, array_to_string(list_transform(range(0, bad_records + 1), lambda i: 'p' || i), ',') as paths from state", HISTORY)
ORACLE["schema_snapshot"] = full(", n as (select count(*) as n_rows from src_orders)\nselect * from (values (0, 'id'), (1, 'company_cuit'), (2, 'customer_id'), (3, 'status'), (4, 'order_date'), (5, 'total_amount'), (6, 'created_at'), (7, 'updated_at')) t(column_index, name) cross join n")

LOG_ROW = "username, date_trunc('second', event_ts) as event_ts, request_path, status_code::varchar as status_code from webserver_logs"
ORACLE["stream_weblogs_upsert"] = full(f"""select event_id, {LOG_ROW} where _source_line % 11 <> 0
union all select 'made', {LOG_ROW} where _source_line % 11 = 0 union all select 'made', {LOG_ROW} where _source_line % 11 = 0 and request_path = '/click'""")
ORACLE["stream_bad_lines"] = "select count(*) + count(*) filter (event_type = 'click') + bad as n_lines, bad as n_bad, 2::bigint as batches from events, (select count(*) filter (event_id % 50 = 0) + count(*) filter (event_id % 90 = 0) as bad from events) group by bad"
ORACLE["stream_two_into_one"] = ORACLE["stream_weblogs_upsert"]
ORACLE["stream_late_rows"] = f"""with e as (select event_id, event_type, ts, ts <= {EVENT_CUT} and event_id % 4 <> 0 as early from events)
select event_id, event_type from e where early or ts > (select max(ts) from e where early)"""
ORACLE["stream_leads_current"] = full(CLEAN_LEADS.replace("contact_email desc, country_code desc", "country_code desc").replace("industry desc, ", "").replace("last_activity_at desc, ", ""))

ORACLE["stream_events_once"] = "select event_id, event_type from events"
ORACLE["warehouse_build"] = ORACLE["dq_generic"]
ORACLE["ingestion_run"] = full("""
, n as (select (select count(*) from src_orders) as orders, (select count(*) from order_items) as items, (select count(*) from companies where cuit not like '%5') as good)
select 'orders' as "table", orders as n_rows, 'completed' as status, orders as records, 0::bigint as bad_records from n
union all select 'order_items', items, 'completed', items, 0 from n union all select 'companies', good, null, null, null from n union all select 'ref_countries', null, 'failed', null, null""")

ORACLE["ingestion_cursor_runs"] = full(f"""
, o as (select updated_at as c, id from src_orders), m as (select max(c) as top, max(c) filter (c <= {CUT}) as mid, count(*) as n, count(*) filter (c <= {CUT}) as n1 from o),
i as (select max(id) as top, max(id) filter (id <= 1000000) as mid, count(*) as n, count(*) filter (id <= 1000000) as n1 from order_items),
r as (select count(*) as n from ref_countries)
select t.*, 1::bigint as n_paths from (
select 'run-1' as run_id, 'orders' as dataset, 'completed' as status, n1 as records, null::varchar as watermark_before, mid::varchar as watermark_after, 8::bigint as n_columns, n as n_rows from m
union all select 'run-2', 'orders', 'completed', n - n1, mid::varchar, top::varchar, 8, n from m union all select 'run-3', 'orders', 'completed', 0, top::varchar, top::varchar, 8, n from m
union all select 'run-1', 'order_items', 'completed', n1, null, mid::varchar, 5, n from i union all select 'run-2', 'order_items', 'completed', n - n1, mid::varchar, top::varchar, 5, n from i
union all select 'run-3', 'order_items', 'completed', 0, top::varchar, top::varchar, 5, n from i
union all select x, 'ref_countries', 'completed', n, null, null, 2, n from r, (values ('run-1'), ('run-2'), ('run-3')) v(x)) t""")
ORACLE["mart_tables"] = full("""select 'dim_countries' as "table", count(*) as n_rows from dim_countries union all select 'dim_companies', count(*) from dim_companies
union all select 'fct_orders', count(*) from fct_orders union all select 'dim_absent', 0 union all select 'peek', 5""")
CONVERSIONS = """select 'L' || user_id as lead_id, case when event_id % 5 = 0 then 'S' else 'C' end || user_id as company_cuit, case when event_id % 3 <> 0 then 'N' || (user_id % 30) end as country_code,
case when event_id % 10 <> 1 then ts end as converted_at from events where event_type = 'purchase'"""
ORACLE["dq_conversions"] = full(checks({
    "conversion_company": "select 1 from conversions where company_cuit is null or company_cuit not in (select cuit from companies)",
    "conversion_company_type": "select 1 from conversions c join companies k on k.cuit = c.company_cuit where k.type <> 'Client'",
    "conversion_country": "select 1 from conversions where country_code is not null and country_code not in (select code from ref_countries)",
    "conversion_time": "select 1 from conversions where converted_at is null",
}), {"conversions": CONVERSIONS})
ORACLE["tolerant_flags"] = "select event_id, event_id % 8 < 4 as flag from events"

# A body that begins with more common table expressions goes on where the models' list ends.
ORACLE = {k: re.sub(r"\)\n\s*,\s", "),\n", v, count=1) if re.search(r"\)\n\s*,\s", v) else v for k, v in ORACLE.items()}

ORACLE["upsert_key_types"] = full("select kind::integer as kind, id, case when id % 10 = 0 then 'CHANGED' else status end as status from src_orders, (select unnest([0, 1, 2]) as kind)")
ORACLE["upsert_two_writers"] = full("select id, status, (id % 3 = 0)::integer + (id % 2 = 0)::integer as times, 1 as conflicts from src_orders")
ORACLE["merge_on_read"] = full("select id, case when id % 15 = 0 then 'DAY4' when id % 14 = 0 then 'DAY3' when id % 13 = 0 then 'DAY2' when id % 12 = 0 then 'DAY1' when id % 11 = 0 then 'DAY0' else status end as status, total_amount, order_date, phase from src_orders, (select unnest(['deltas', 'folded', 'base']) as phase)")
ORACLE["file_skipping"] = full("select id, order_id, case when id % 97 = 0 then 0 else quantity end as quantity, true as few_opened, true as many_present from order_items where id in ((select min(id) from order_items), (select max(id) from order_items))")

ORACLE["ingestion_runs_repeated"] = full(f"""select 'run-1' as run_id, count(*) as n_rows, sum(id)::bigint as ids, 1::bigint as n_paths from src_orders where updated_at <= {CUT}
union all select 'run-2', count(*), sum(id)::bigint, 1 from src_orders where updated_at > {CUT}""")
ORACLE["ingestion_file_runs"] = """with n as (select count(*) as n, count(*) filter (event_id % 3 < 2) as n1 from events)
select 'run-1' as run_id, 'completed' as status, n1 as records, '20240102_000000' as cursor, 2::bigint as n_files, n as n_rows, 1::bigint as listed from n
union all select 'run-2', 'completed', n - n1, '20240103_000000', 1, n, 1 from n union all select 'run-3', 'completed', 0, '20240103_000000', null, n, 1 from n"""
ORACLE["write_sorted_lines"] = full("select count(*) as n_rows, min(_source_line) as low, max(_source_line) as high, true as in_order from webserver_logs")

#: The tables that the reports by deltas end with, in place of the models they come from.
CHANGED_ORDERS = MODELS["stg_orders"].replace("from src_orders", """from (select * replace (case when id % 11 = 0 then 'CANCELLED' else status end as status, case when id % 13 = 0 then order_date + interval 1 month else order_date end as order_date,
  case when id % 17 = 0 then 'C' || (customer_id % 100 + 1) else company_cuit end as company_cuit) from src_orders)""")
CHANGED_ITEMS = MODELS["stg_order_items"].replace("quantity, unit_price, quantity * unit_price as line_amount", "case when id % 7 = 0 then quantity + 1 else quantity end as quantity, unit_price, case when id % 7 = 0 then quantity * unit_price / 2 else quantity * unit_price end as line_amount")
CHANGED_LOGS = f"select * replace (case when _source_line % 5 = 0 then 'curl/9' else user_agent end as user_agent, case when _source_line % 10 = 0 then '-' else username end as username) from ({duckdb_view('webserver_logs')})"


def with_tables(name: str, first: str, tables: dict[str, str]) -> str:
    """A query's SQL from its own expression ``first`` on, over other tables."""
    return re.sub(r"\)\n\s*,\s", "),\n", full("\n, " + ORACLE[name][ORACLE[name].rindex(f"\n{first} as (") + 1 :], tables), count=1)


ORACLE["monthly_sales_by_deltas"] = with_tables("monthly_sales", "s", {"stg_orders": CHANGED_ORDERS})
ORACLE["top_devices_by_deltas"] = with_tables("top_devices", "f", {"webserver_logs": CHANGED_LOGS})
ORACLE["top_products_by_deltas"] = with_tables("top_products_in_top_country", "c", {"stg_orders": CHANGED_ORDERS, "stg_order_items": CHANGED_ITEMS, "webserver_logs": CHANGED_LOGS})
ORACLE["stream_newest_events"] = "select event_id, ts + (2 + event_id % 3) * interval 1 hour as event_ts, event_type || '+' || (2 + event_id % 3) as event_type from events"
ORACLE["price_then_valid"] = re.sub(r"\)\n\s*,\s", "),\n", full("""
, listed as (select *, case when product_id % 3 = 0 then updated_at else created_at end as listed_at from stg_company_catalogs),
p as (select company_cuit, product_id, listed_at, max(sale_price) as sale_price from listed group by all),
i as (select order_item_id, product_id, company_cuit, order_ts from stg_order_items join stg_orders using (order_id))
select order_item_id, round(p.sale_price * 100) as sale_price, p.listed_at from i asof left join p on i.company_cuit = p.company_cuit and i.product_id = p.product_id and i.order_ts >= p.listed_at"""), count=1)
ORACLE["last_view_before_purchase"] = """with v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by all), p as (select * from events where event_type = 'purchase')
select p.event_id, p.user_id, v.event_id as view_id, v.ts as viewed_at from p asof left join v on p.user_id = v.user_id and p.ts > v.ts"""
ORACLE["eligible_customers"] = full("select o.order_id, (select count(*) from stg_orders k where k.company_cuit = o.company_cuit and date_trunc('day', k.order_ts) + interval 6 month <= o.order_ts)::integer as n_eligible from stg_orders o")
ORACLE["snapshot_difference"] = full("""select kind, case kind when 'deleted' then (select count(*) from customers where id % 50 = 1) when 'updated' then (select count(*) from customers where id % 50 <> 1 and id % 60 = 2)
  when 'inserted' then (select count(*) from customers where id % 70 = 3) else (select count(*) from customers where id % 50 <> 1 and id % 60 <> 2) end as n_keys,
  true as equal, true as some_left from (select unnest(['inserted', 'updated', 'deleted', 'unchanged']) as kind)""")
ORACLE["database_window"] = full("select id, order_id, product_id, quantity, true as even from order_items, (select max(order_id) // 2 as high from order_items) where order_id <= high and order_id > high // 4")
