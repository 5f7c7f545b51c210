"""Staging models: casts and renames of the source datasets, strict (a bad value ends the model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = ("_source_file", "_ingestion_run_id", "_ingested_at")


def _as(name: str, kind: str, new: str | None = None) -> Column:
    return F.col(name).cast(kind).alias(new or name)


def stg_ref_countries(countries: DataFrame) -> DataFrame:
    return countries.select(F.trim("code").alias("country_code"), F.trim("name").alias("country_name"))


def stg_companies(companies: DataFrame) -> DataFrame:
    return companies.select(
        F.col("cuit").alias("company_cuit"), F.col("name").alias("company_name"), F.col("type").alias("company_type"),
        F.upper("country_code").alias("country_code"), _as("created_at", "timestamp_ntz"), _as("updated_at", "timestamp_ntz"),
    )


def stg_products(products: DataFrame) -> DataFrame:
    return products.select(
        _as("id", "long", "product_id"), F.col("name").alias("product_name"), "supplier_cuit",
        _as("base_price", "double"), _as("base_price", "double", "product_price"), _as("created_at", "timestamp_ntz"), _as("updated_at", "timestamp_ntz"),
        F.lit(False).alias("is_food_item"), F.lit(False).alias("is_drink_item"),
    )


def stg_company_catalogs(catalogs: DataFrame) -> DataFrame:
    return catalogs.select("company_cuit", _as("product_id", "long"), _as("sale_price", "double"), _as("created_at", "timestamp_ntz"), _as("updated_at", "timestamp_ntz"))


def stg_customers(customers: DataFrame) -> DataFrame:
    name = F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))
    return customers.select(
        _as("id", "long", "customer_id"), "company_cuit", "document_number", "username", "first_name", "last_name", name.alias("customer_name"),
        "email", "phone_number", _as("birth_date", "date"), _as("created_at", "timestamp_ntz"),
    )


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        _as("id", "long", "order_id"), "company_cuit", _as("customer_id", "long"), F.col("status").alias("order_status"),
        _as("order_date", "timestamp_ntz", "order_ts"), _as("order_date", "date"), _as("total_amount", "double", "order_total"), _as("total_amount", "double", "subtotal"),
        F.lit(0.0).alias("tax_paid"), _as("created_at", "timestamp_ntz"), _as("updated_at", "timestamp_ntz"),
    )


def stg_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Only items whose order is among the staged orders: a semi join, as order_id is unique there."""
    amount = F.coalesce(F.col("quantity"), F.lit(0)) * F.coalesce(F.col("unit_price"), F.lit(0))
    rows = items.select(
        _as("id", "long", "order_item_id"), _as("order_id", "long"), _as("product_id", "long"), _as("quantity", "long"),
        _as("unit_price", "double"), amount.cast("double").alias("line_amount"),
    )
    return rows.join(orders.select("order_id"), "order_id", "left_semi").select(*rows.columns)


def stg_marketing_leads(leads: DataFrame) -> DataFrame:
    """For the current leads and for their history alike."""
    return leads.select(
        "lead_id", _as("created_at", "timestamp_ntz"), "company_name", _as("is_prospect", "boolean"), "industry", "contact_name", "contact_email", "contact_phone",
        "lead_source", _as("estimated_annual_revenue", "double"), F.upper("country_code").alias("country_code"), "status",
        _as("status_updated_at", "timestamp_ntz"), _as("last_activity_at", "timestamp_ntz"), "_source_file", "_ingestion_run_id", _as("_ingested_at", "timestamp_ntz"),
    )


def stg_webserver_logs(logs: DataFrame) -> DataFrame:
    return logs.select(
        "event_id", _as("event_ts", "timestamp_ntz"), _as("event_ts", "date", "event_date"), "remote_host", "username", "request_path",
        _as("status_code", "int"), "user_agent", "_source_file", _as("_source_line", "long"), "_ingestion_run_id", _as("_ingested_at", "timestamp_ntz"),
    )
