"""Data-quality checks: each is a count of offending rows and passes at 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import name_key, stripped

#: The domains of enumerations.
COMPANY_TYPES = ("Supplier", "Client")
ORDER_STATUSES = ("COMPLETED", "CANCELLED", "RETURNED")
LEAD_STATUSES = ("New", "Contacted", "Qualified", "Lost", "Nurturing", "Converted")


# --- failing rows -------------------------------------------------------------------


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once; nulls are left out. Counts are combined before the shuffle."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def accepted_values(df: DataFrame, column: str, values: tuple, null_is_bad: bool = False) -> DataFrame:
    bad = ~F.col(column).isin(*values)
    return df.where(F.coalesce(bad, F.lit(null_is_bad)))


def relationships(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str]) -> DataFrame:
    """Child rows whose key, if set, isn't among the parent's."""
    keys = parent.select(*[F.col(p).alias(f) for f, p in zip(fk, pk, strict=True)])
    return child.dropna(subset=fk).join(keys, fk, "left_anti")


def missing_or_wrong(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """As ``relationships``, with unset keys counting as wrong."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


# --- checks -------------------------------------------------------------------------


def run_checks(failing: dict[str, DataFrame]) -> DataFrame:
    """Rows (check, issues, ok), a row for each named frame of failing rows."""
    rows = [df.agg(F.count("*").alias("issues")).select(F.lit(name).alias("check"), "issues") for name, df in failing.items()]
    return reduce(DataFrame.unionAll, rows).withColumn("ok", F.col("issues") == 0)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in tables.items()])


def missing_tables(tables: dict[str, DataFrame], required: tuple[str, ...]) -> list[str]:
    return [t for t in required if t not in tables]


def with_type(child: DataFrame, companies: DataFrame, fk: str, wanted: str) -> DataFrame:
    """Rows whose company exists and isn't of the wanted type."""
    return child.join(companies.select(F.col("cuit").alias(fk), "type"), fk).where(F.col("type") != wanted)


def business_checks(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Failing rows of each check over the source datasets; conversions are checked where present."""
    companies, products, customers, orders, items, catalogs = (t[k] for k in ("companies", "products", "customers", "orders", "order_items", "company_catalogs"))
    upper = companies.withColumn("country_code", F.upper("country_code"))
    order_buyers = orders.select(F.col("id").alias("order_id"), "company_cuit")
    totals = items.groupBy("order_id").agg((F.round(F.sum(F.col("quantity") * F.col("unit_price")) * 100) / 100).alias("items_total"))
    buyers = customers.select(F.col("id").alias("customer_id"), F.col("company_cuit").alias("own_cuit"))
    out = {
        "company_country": missing_or_wrong(upper, "country_code", t["ref_countries"], "code"),
        "company_type": accepted_values(companies, "type", COMPANY_TYPES, True),
        "product_supplier": missing_or_wrong(products, "supplier_cuit", companies, "cuit"),
        "product_supplier_type": with_type(products, companies, "supplier_cuit", "Supplier"),
        "customer_company": missing_or_wrong(customers, "company_cuit", companies, "cuit"),
        "customer_company_type": with_type(customers, companies, "company_cuit", "Client"),
        "catalog_company": missing_or_wrong(catalogs, "company_cuit", companies, "cuit"),
        "catalog_company_type": with_type(catalogs, companies, "company_cuit", "Client"),
        "catalog_product": missing_or_wrong(catalogs, "product_id", products, "id"),
        "order_customer": missing_or_wrong(orders, "customer_id", customers, "id"),
        "order_company": missing_or_wrong(orders, "company_cuit", companies, "cuit"),
        "order_company_is_customers": orders.join(buyers, "customer_id").where(F.col("company_cuit") != F.col("own_cuit")),
        "order_status": accepted_values(orders, "status", ORDER_STATUSES, True),
        "order_total_positive": orders.where(~F.coalesce(F.col("total_amount") > 0, F.lit(False))),
        "item_order": missing_or_wrong(items, "order_id", orders, "id"),
        "item_product": missing_or_wrong(items, "product_id", products, "id"),
        "item_quantity_positive": items.where(~F.coalesce(F.col("quantity") > 0, F.lit(False))),
        "item_price_positive": items.where(~F.coalesce(F.col("unit_price") > 0, F.lit(False))),
        "item_in_catalog": items.join(order_buyers, "order_id").join(catalogs.select("company_cuit", "product_id"), ["company_cuit", "product_id"], "left_anti"),
        "order_total_is_items": orders.join(totals, F.col("id") == F.col("order_id")).where(F.abs(F.col("total_amount") - F.col("items_total")) > 0.05),
        "username_unique": unique(customers, "username"),
        "email_unique": unique(customers, "email"),
        "no_time_travel": orders.join(customers.select(F.col("id").alias("customer_id"), F.col("created_at").alias("since")), "customer_id").where(F.col("order_date") < F.col("since")),
    }
    if "lead_conversions" in t:
        c = t["lead_conversions"]
        out |= {
            "conversion_company": missing_or_wrong(c, "company_cuit", companies, "cuit"),
            "conversion_company_type": with_type(c, companies, "company_cuit", "Client"),
            "conversion_country": relationships(c, ["country_code"], t["ref_countries"], ["code"]),
            "conversion_time": not_null(c, "converted_at"),
        }
    return out


def top_share(df: DataFrame, column: str, top: tuple[str, ...], wanted: float = 0.8) -> DataFrame:
    """One row: share of the set codes that are in a list; ok from 90 % of the wanted share on."""
    code = F.nullif(F.upper(F.trim(column)), F.lit(""))
    share = F.avg(code.isin(*top).cast("double"))
    return df.agg(F.count(code).alias("n_rows"), share.alias("share")).withColumn("ok", F.coalesce(F.col("share") >= 0.9 * wanted, F.lit(False)))


def lead_statuses(leads: DataFrame) -> DataFrame:
    return leads.withColumn("status", stripped("status")).where(~F.coalesce(F.col("status").isin(*LEAD_STATUSES), F.lit(False)))


def country_alignment(rows: DataFrame, other: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """One row: among rows that find their partner and have both countries, the share whose countries agree."""
    joined = rows.join(other.withColumnRenamed("country_code", "__other"), key).where("country_code is not null and __other is not null")
    agree = F.avg((F.upper("country_code") == F.upper("__other")).cast("double"))
    return joined.agg(F.count("*").alias("comparable"), agree.alias("ratio")).withColumn("ok", F.coalesce(F.col("ratio") >= least, F.lit(True)))


def lead_alignment(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Leads of existing companies (not prospects) by exact name; names on several companies count once each."""
    own = leads.where(~F.col("is_prospect")).select(F.col("company_name").alias("name"), "country_code")
    return country_alignment(own, companies.select("name", "country_code"), "name")


def weblog_mix(logs: DataFrame) -> DataFrame:
    """Rows (authenticated, n_rows, share); a missing name and - are anonymous."""
    known = F.coalesce(F.col("username") != "-", F.lit(False))
    return logs.groupBy(known.alias("authenticated")).agg(F.count("*").alias("n_rows"))


def warehouse_tests(m: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The generic tests of staging and mart models: keys set and unique, domains, references."""
    keys = {"dim_companies": "company_cuit", "dim_customers": "customer_id", "dim_products": "product_id", "dim_datetime": "date_key", "dim_countries": "country_code", "fct_orders": "order_id", "fct_order_items": "order_item_id", "fct_marketing_leads_current": "lead_id", "fct_webserver_logs": "event_id"}
    out = {}
    for model, key in keys.items():
        if model in m:
            out[f"{model}.{key}.not_null"] = not_null(m[model], key)
            out[f"{model}.{key}.unique"] = unique(m[model], key)
    fks = [
        ("dim_companies", "country_code", "dim_countries", "country_code"), ("dim_customers", "company_cuit", "dim_companies", "company_cuit"),
        ("dim_products", "supplier_cuit", "dim_companies", "company_cuit"), ("fct_orders", "customer_id", "dim_customers", "customer_id"),
        ("fct_orders", "company_cuit", "dim_companies", "company_cuit"), ("fct_order_items", "order_id", "fct_orders", "order_id"),
        ("fct_order_items", "product_id", "dim_products", "product_id"), ("fct_marketing_leads_current", "company_cuit", "dim_companies", "company_cuit"),
    ]
    for child, fk, parent, pk in fks:
        if child in m and parent in m:
            out[f"{child}.{fk}.in.{parent}"] = relationships(m[child], [fk], m[parent], [pk])
    if "dim_companies" in m:
        out["dim_companies.company_type.accepted"] = accepted_values(m["dim_companies"], "company_type", COMPANY_TYPES)
    return out


def ambiguous_names(companies: DataFrame) -> DataFrame:
    return companies.groupBy(name_key("name").alias("name_key")).agg(F.countDistinct("cuit").alias("n")).where(F.col("n") > 1)
