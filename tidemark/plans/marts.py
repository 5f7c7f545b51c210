"""Dimensions and facts. ``loaded_at`` is a parameter, so that a build can be repeated exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import cents, first_set, is_error, status_class
from tidemark.operators.dedupe import keep_first


def _loaded(df: DataFrame, loaded_at: Column | None) -> DataFrame:
    return df.withColumn("loaded_at", F.current_timestamp() if loaded_at is None else loaded_at)


def dim_countries(stg_ref_countries: DataFrame) -> DataFrame:
    return stg_ref_countries.select("country_code", "country_name")


def dim_companies(stg_companies: DataFrame, countries: DataFrame) -> DataFrame:
    joined = stg_companies.join(countries, "country_code", "left")
    return joined.select("company_cuit", "company_name", "company_type", "country_code", "country_name", "created_at", "updated_at")


def dim_customers(stg_customers: DataFrame, companies: DataFrame) -> DataFrame:
    names = companies.select("company_cuit", F.col("company_name").alias("customer_company_name"))
    return stg_customers.join(names, "company_cuit", "left").select(
        "customer_id", "company_cuit", "customer_company_name", "document_number", "username", "first_name", "last_name",
        "customer_name", "email", "phone_number", "birth_date", "created_at",
    )


def catalog_stats(stg_company_catalogs: DataFrame) -> DataFrame:
    """Listing companies and prices by product, aggregated before any join."""
    return stg_company_catalogs.groupBy("product_id").agg(
        F.countDistinct("company_cuit").alias("listed_by_company_count"), F.min("sale_price").alias("low"), F.max("sale_price").alias("high"), F.avg("sale_price").alias("mean"),
    )


def dim_products(stg_products: DataFrame, companies: DataFrame, stg_company_catalogs: DataFrame) -> DataFrame:
    """Products that no company lists keep null statistics."""
    suppliers = companies.select(F.col("company_cuit").alias("supplier_cuit"), F.col("company_name").alias("supplier_name"))
    joined = stg_products.join(suppliers, "supplier_cuit", "left").join(catalog_stats(stg_company_catalogs), "product_id", "left")
    return joined.select(
        "product_id", "product_name", "supplier_cuit", "supplier_name", cents("base_price").alias("base_price"), cents("product_price").alias("product_price"),
        "listed_by_company_count", cents("low").alias("min_catalog_sale_price"), cents("high").alias("max_catalog_sale_price"),
        cents("mean").alias("avg_catalog_sale_price"), "created_at", "updated_at",
    )


def date_bounds(date_columns: list[tuple[DataFrame, str]], as_of: Column) -> DataFrame:
    """One row (low, high): least and greatest date of all columns, or a year around ``as_of`` without any.

    Each column is reduced to its two bounds before the union.
    """
    both = [df.agg(F.min(F.col(c).cast("date")).alias("low"), F.max(F.col(c).cast("date")).alias("high")) for df, c in date_columns]
    union = both[0]
    for more in both[1:]:
        union = union.unionAll(more)
    return union.agg(F.coalesce(F.min("low"), F.date_sub(as_of, 365)).alias("low"), F.coalesce(F.max("high"), F.date_add(as_of, 365)).alias("high"))


def dim_datetime(date_columns: list[tuple[DataFrame, str]], as_of: Column | None = None) -> DataFrame:
    """A row a day between the bounds."""
    bounds = date_bounds(date_columns, F.current_date() if as_of is None else as_of.cast("date"))
    d = F.col("date_day")
    weekday = F.weekday(d) + 1
    start = d.cast("timestamp_ntz")
    return bounds.select(F.explode(F.sequence("low", "high")).alias("date_day")).select(
        F.date_format(d, "yyyyMMdd").cast("long").alias("date_key"), d, F.year(d).alias("year_num"), F.quarter(d).alias("quarter_num"), F.month(d).alias("month_num"),
        F.date_format(d, "MMMM").alias("month_name"), F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"), weekday.alias("iso_day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), F.weekofyear(d).alias("iso_week_of_year"), (weekday >= 6).alias("is_weekend"),
        F.trunc(d, "MM").alias("month_start_date"), F.trunc(d, "YEAR").alias("year_start_date"), start.alias("day_start_ts"),
        (start + F.expr("interval 1 day") - F.expr("interval 1 second")).alias("day_end_ts"),
    )


def order_item_stats(stg_order_items: DataFrame) -> DataFrame:
    return stg_order_items.groupBy("order_id").agg(
        F.count("*").alias("order_item_count"), F.sum("quantity").alias("total_quantity"), F.sum("line_amount").alias("total_line_amount"),
    )


def fct_orders(stg_orders: DataFrame, stg_order_items: DataFrame, loaded_at: Column | None = None, delta: bool = False) -> DataFrame:
    """Orders with their items' statistics, zero without items.

    For a ``delta`` of the orders, items of other orders are left out before they are aggregated.
    """
    items = stg_order_items.join(stg_orders.select("order_id"), "order_id", "left_semi") if delta else stg_order_items
    joined = stg_orders.join(order_item_stats(items), "order_id", "left")
    return _loaded(joined.select(
        "order_id", "customer_id", "company_cuit", "order_status", "order_ts", "order_date", "order_total",
        F.coalesce("order_item_count", F.lit(0)).alias("order_item_count"), F.coalesce("total_quantity", F.lit(0)).alias("total_quantity"),
        F.coalesce("total_line_amount", F.lit(0.0)).alias("total_line_amount"), F.col("updated_at").alias("source_updated_at"),
    ), loaded_at)


def fct_order_items(stg_order_items: DataFrame, stg_orders: DataFrame, stg_products: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    orders = stg_orders.select("order_id", "customer_id", "company_cuit", "order_ts", "order_date")
    products = stg_products.select("product_id", "product_name", "supplier_cuit", "base_price")
    cost = F.coalesce("quantity", F.lit(0)) * F.coalesce("base_price", F.lit(0.0))
    joined = stg_order_items.join(orders, "order_id", "left").join(products, "product_id", "left")
    return _loaded(joined.select(
        "order_item_id", "order_id", "order_ts", "order_date", "customer_id", "company_cuit", "product_id", "product_name", "supplier_cuit",
        "quantity", "unit_price", "line_amount", cost.cast("double").alias("estimated_base_cost"),
        (F.coalesce("line_amount", F.lit(0.0)) - cost).cast("double").alias("estimated_margin"),
    ), loaded_at)


def fct_company_catalog_prices(stg_company_catalogs: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """The newest price of each company and product; equal times are settled by the higher price."""
    newest = [F.coalesce("updated_at", "created_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("sale_price").desc_nulls_last()]
    latest = keep_first(stg_company_catalogs, ["company_cuit", "product_id"], newest)
    return _loaded(latest.select("company_cuit", "product_id", F.col("sale_price").alias("current_sale_price"), "created_at", "updated_at"), loaded_at)


def company_by_name(companies: DataFrame) -> DataFrame:
    """One company for each name in lower case: clients first, then newest, then by cuit."""
    order = [F.when(F.col("company_type") == "Client", 0).otherwise(1), F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("company_cuit").asc_nulls_last()]
    return keep_first(companies.withColumn("name_key", F.lower("company_name")), ["name_key"], order).select("name_key", "company_cuit", "company_type")


LEAD_COLUMNS = (
    "lead_id", "company_name", "is_prospect", "industry", "contact_name", "contact_email", "contact_phone", "lead_source",
    "estimated_annual_revenue", "country_code", "status", "created_at", "status_updated_at", "last_activity_at", "_ingestion_run_id", "_ingested_at",
)


def fct_marketing_leads_current(stg_leads: DataFrame, companies: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """The newest row of each lead with the company of its name.

    A lead's rows are reduced before the join. Rows of one time are settled by run id,
    then by the time of the status, then by all that is left.
    """
    newest = [first_set("_ingested_at", "status_updated_at", "created_at").desc(), F.col("_ingestion_run_id").desc_nulls_last(), F.col("status_updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("estimated_annual_revenue").desc_nulls_last(), F.col("lead_source").desc_nulls_last()]
    leads = keep_first(stg_leads, ["lead_id"], newest).withColumn("name_key", F.lower("company_name"))
    joined = leads.join(company_by_name(companies), "name_key", "left")
    return _loaded(joined.select(*LEAD_COLUMNS[:2], "company_cuit", "company_type", *LEAD_COLUMNS[2:]), loaded_at)


def fct_marketing_leads_history(stg_leads: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    return _loaded(stg_leads.select(*LEAD_COLUMNS), loaded_at)


def fct_webserver_logs(stg_logs: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    return _loaded(stg_logs.select(
        "event_id", "event_ts", "event_date", "remote_host", "username", "request_path", "status_code", status_class("status_code").alias("status_class"),
        is_error("status_code").alias("is_error"), "user_agent", "_ingestion_run_id", "_ingested_at",
    ), loaded_at)
