"""The whole warehouse from the source datasets, as views and tables, with its tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.operators import audit
from tidemark.plans import marts, staging


def materialize_view(df: DataFrame, name: str) -> None:
    """A staging model as a view: nothing is computed until it is read."""
    df.createOrReplaceTempView(name)


def materialize_table(df: DataFrame, name: str, database: str | None = None, location: str | None = None) -> DataFrame:
    """A mart as a table that is rewritten whole; the database is made if absent, in the warehouse or at ``location``."""
    spark = df.sparkSession
    if database:
        spark.sql(f"create database if not exists {database}" + (f" location '{location}'" if location else ""))
    full = f"{database}.{name}" if database else name
    df.write.mode("overwrite").saveAsTable(full)
    return spark.table(full)


def head_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """Some rows to look at."""
    return df.limit(n)


def staging_models(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """From the source datasets by name; leads are given as current and as history rows, or once as marketing_leads."""
    current = t.get("marketing_leads_current", t.get("marketing_leads"))
    orders = staging.stg_orders(t["orders"])
    return {
        "stg_ref_countries": staging.stg_ref_countries(t["ref_countries"]), "stg_companies": staging.stg_companies(t["companies"]),
        "stg_products": staging.stg_products(t["products"]), "stg_company_catalogs": staging.stg_company_catalogs(t["company_catalogs"]),
        "stg_customers": staging.stg_customers(t["customers"]), "stg_orders": orders, "stg_order_items": staging.stg_order_items(t["order_items"], orders),
        "stg_marketing_leads_current": staging.stg_marketing_leads(current), "stg_marketing_leads_history": staging.stg_marketing_leads(t.get("marketing_leads_history", current)),
        "stg_webserver_logs": staging.stg_webserver_logs(t["webserver_logs"]),
    }


def mart_models(s: dict[str, DataFrame], as_of: Column | None = None, loaded_at: Column | None = None) -> dict[str, DataFrame]:
    """Dimensions and facts in the order of their inputs."""
    countries = marts.dim_countries(s["stg_ref_countries"])
    companies = marts.dim_companies(s["stg_companies"], countries)
    history = s["stg_marketing_leads_history"]
    dates = [(s["stg_orders"], "order_ts"), (s["stg_webserver_logs"], "event_ts"), *[(history, c) for c in ("created_at", "status_updated_at", "last_activity_at")]]
    return {
        "dim_countries": countries, "dim_companies": companies, "dim_customers": marts.dim_customers(s["stg_customers"], companies),
        "dim_products": marts.dim_products(s["stg_products"], companies, s["stg_company_catalogs"]), "dim_datetime": marts.dim_datetime(dates, as_of),
        "fct_orders": marts.fct_orders(s["stg_orders"], s["stg_order_items"], loaded_at),
        "fct_order_items": marts.fct_order_items(s["stg_order_items"], s["stg_orders"], s["stg_products"], loaded_at),
        "fct_company_catalog_prices": marts.fct_company_catalog_prices(s["stg_company_catalogs"], loaded_at),
        "fct_marketing_leads_current": marts.fct_marketing_leads_current(s["stg_marketing_leads_current"], companies, loaded_at),
        "fct_marketing_leads_history": marts.fct_marketing_leads_history(history, loaded_at),
        "fct_webserver_logs": marts.fct_webserver_logs(s["stg_webserver_logs"], loaded_at),
    }


def build(spark: SparkSession, sources: dict[str, DataFrame], database: str | None = None, as_of: Column | None = None, loaded_at: Column | None = None) -> DataFrame:
    """Staging as views, marts as tables in ``database`` (or left as frames), then the tests: rows (check, issues, ok)."""
    views = staging_models(sources)
    for name, df in views.items():
        materialize_view(df, name)
    models = mart_models(views, as_of, loaded_at)
    if database:
        models = {name: materialize_table(df, name, database) for name, df in models.items()}
    return audit.run_audits(audit.warehouse_audits(models))
