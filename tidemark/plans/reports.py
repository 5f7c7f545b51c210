"""The three reports over facts and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import cents, device_family


def monthly_order_metrics(orders: DataFrame) -> DataFrame:
    def amount(status: str) -> Column:
        return F.sum(F.when(F.col("order_status") == status, F.coalesce("order_total", F.lit(0.0))).otherwise(0.0))

    def number(status: str) -> Column:
        return F.sum(F.when(F.col("order_status") == status, 1).otherwise(0))

    return orders.groupBy(F.trunc("order_date", "MM").alias("month_start")).agg(
        amount("COMPLETED").alias("gross"), amount("RETURNED").alias("returned"), number("COMPLETED").alias("completed_orders"),
        number("RETURNED").alias("returned_orders"), number("CANCELLED").alias("cancelled_orders"),
    )


def monthly_sales(orders: DataFrame, as_of: Column | None = None, keep_empty: bool = False) -> DataFrame:
    """Sales of the month of ``as_of`` and the eleven before; months without gross sales only with ``keep_empty``."""
    month = F.trunc(F.current_date() if as_of is None else as_of.cast("date"), "MM")
    first, end = F.add_months(month, -11), F.add_months(month, 1)
    metrics = monthly_order_metrics(orders.where((F.col("order_date") >= first) & (F.col("order_date") < end)))
    spine = orders.sparkSession.range(1).select(F.explode(F.sequence(first, month, F.expr("interval 1 month"))).alias("month_start"))
    joined = spine.join(metrics, "month_start", "left")
    if not keep_empty:
        joined = joined.where(F.col("gross") > 0)
    gross, returned = F.coalesce("gross", F.lit(0.0)), F.coalesce("returned", F.lit(0.0))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("completed_orders", "returned_orders", "cancelled_orders")]
    return joined.select("month_start", cents(gross).alias("gross_sales_amount"), cents(returned).alias("returned_amount"), cents(gross - returned).alias("net_sales_amount"), *counts).orderBy("month_start")


def top_devices(logs: DataFrame, n: int = 5) -> DataFrame:
    """Device families by requests of signed-in users."""
    own = logs.where(F.col("username").isNotNull() & (F.col("username") != "-"))
    usage = own.groupBy(device_family("user_agent").alias("device_family")).agg(F.count("*").alias("request_count"), F.countDistinct("username").alias("unique_users"))
    return usage.orderBy(F.desc("request_count"), F.desc("unique_users"), "device_family").limit(n)


def logins_by_country(logs: DataFrame, customers: DataFrame, companies: DataFrame) -> DataFrame:
    """Requests are counted by user before they are joined, so no user name is hot in the join."""
    own = logs.where(F.col("username").isNotNull() & (F.col("username") != "-")).groupBy("username").agg(F.count("*").alias("n"))
    users = own.join(customers.select("username", "company_cuit"), "username").join(companies.select("company_cuit", "country_name"), "company_cuit", "left")
    return users.groupBy(F.coalesce("country_name", F.lit("Unknown")).alias("country_name")).agg(F.sum("n").alias("login_event_count"), F.countDistinct("username").alias("unique_logged_in_users"))


def top_login_country(logs: DataFrame, customers: DataFrame, companies: DataFrame) -> DataFrame:
    """One row; ties by users, then by name. A limit after an ordering, no window over all rows."""
    return logins_by_country(logs, customers, companies).orderBy(F.desc("login_event_count"), F.desc("unique_logged_in_users"), F.asc_nulls_last("country_name")).limit(1)


def top_products_in_top_country(logs: DataFrame, customers: DataFrame, companies: DataFrame, items: DataFrame, orders: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    top = top_login_country(logs, customers, companies).select("country_name")  # one row: a bounded broadcast
    there = companies.join(F.broadcast(top), "country_name").select("company_cuit", "country_name")
    sold = items.select("order_id", "product_id", "product_name", "quantity", "line_amount").join(orders.select("order_id", "company_cuit").join(there, "company_cuit"), "order_id")
    named = sold.join(products.select("product_id", F.col("product_name").alias("listed_name")), "product_id", "left")
    popular = named.groupBy("country_name", "product_id", F.coalesce("product_name", "listed_name").alias("product_name")).agg(
        F.sum(F.coalesce("quantity", F.lit(0))).alias("total_units_sold"), cents(F.sum(F.coalesce("line_amount", F.lit(0.0)))).alias("total_sales_amount"), F.countDistinct("order_id").alias("order_count"),
    )
    return popular.orderBy(F.desc("total_units_sold"), F.desc("total_sales_amount"), "product_name", "product_id").limit(n)
