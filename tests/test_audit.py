"""Checks in one pass against the checks one by one, and the number of scans in their plan."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import audit, quality
from tidemark.plans import queries
from tidemark.sources.workdir import staged


def as_dict(df):
    rows = df.collect()
    assert len({r["check"] for r in rows}) == len(rows)
    return {r["check"]: (r["issues"], r["ok"]) for r in rows}


def faulty(spark):
    def make(schema, *rows):
        return staged(spark.createDataFrame(list(rows), schema), "audited")

    return {
        "ref_countries": make("code string", ("AR",), ("US",)),
        "companies": make("cuit string, type string, country_code string", ("s1", "Supplier", "ar"), ("c1", "Client", "us"), ("c2", "Client", None), ("x1", "Odd", "zz"), ("x2", None, "US")),
        "products": make("id long, supplier_cuit string", (1, "s1"), (2, "c1"), (3, "none"), (4, None)),
        "customers": make("id long, company_cuit string, username string, email string, created_at timestamp_ntz", *[(i, k, u, e, None if i == 3 else __import__("datetime").datetime(2026, 1, 1)) for i, k, u, e in ((1, "c1", "a", "m"), (2, "c2", "a", "m"), (3, "s1", "b", "m"), (4, None, None, "n"), (5, "gone", None, None))]),
        "company_catalogs": make("company_cuit string, product_id long", ("c1", 1), ("c1", 2), ("s1", 9), (None, None)),
        "orders": make("id long, customer_id long, company_cuit string, status string, total_amount double, order_date timestamp_ntz", *[(i, c, k, s, t, __import__("datetime").datetime(y, 6, 1)) for i, c, k, s, t, y in ((1, 1, "c1", "COMPLETED", 10.0, 2026), (2, 2, "c1", "ODD", 0.0, 2025), (3, 9, "gone", None, None, 2026), (4, None, None, "RETURNED", 5.0, 2026), (5, 4, "c2", "CANCELLED", 7.0, 2027))]),
        "order_items": make("order_id long, product_id long, quantity int, unit_price double", (1, 1, 2, 5.0), (2, 2, 1, 3.0), (2, 1, 0, 3.0), (7, 1, 1, 1.0), (None, 9, None, -1.0), (4, 9, 1, 5.04), (5, 1, 1, 6.0)),
        "lead_conversions": make("company_cuit string, country_code string, converted_at timestamp_ntz", ("c1", "AR", None), ("s1", None, None), (None, "QQ", None)),
    }


def test_one_pass_equals_the_checks_one_by_one(spark):
    t = faulty(spark)
    found = as_dict(audit.run_audits(audit.business_audits(t)))
    assert found == as_dict(quality.run_checks(quality.business_checks(t)))
    assert {n for n, (issues, _) in found.items() if not issues} <= {"no_time_travel", "customer_company_type"}
    clean = {n: df.limit(0) for n, df in t.items()}
    assert set(as_dict(audit.run_audits(audit.business_audits(clean))).values()) == {(0, True)}


def test_models_in_one_pass(spark, sf):
    m = queries.Models(spark, sf)
    models = {n: m[n] for n in ("dim_countries", "dim_companies", "dim_customers", "dim_products", "fct_orders")}
    models["dim_customers"] = models["dim_customers"].withColumn("customer_id", F.when(F.col("customer_id") % 7 > 1, F.col("customer_id")))
    models["fct_orders"] = models["fct_orders"].unionAll(models["fct_orders"].limit(9))
    assert as_dict(audit.run_audits(audit.warehouse_audits(models))) == as_dict(quality.run_checks(quality.warehouse_tests(models)))


def test_a_table_is_scanned_once_as_itself_and_once_as_a_parent(spark):
    t = faulty(spark)
    folders = {re.search(r"audited-[0-9a-f]{32}", df.inputFiles()[0]).group(): n for n, df in t.items()}
    df = audit.run_audits(audit.business_audits(t))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = [folders[f] for f in re.findall(r"FileScan parquet[^\n]*?(audited-[0-9a-f]{32})", final)]
    parents = {"ref_countries", "companies", "products", "customers", "orders", "company_catalogs"}
    assert all(scans.count(n) <= 1 + (n in parents) for n in t), scans
    assert scans.count("order_items") == 1 and scans.count("companies") == 2


def test_values_that_repeat_and_nulls(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, None), (1, "x")], "a int, b string")
    found = as_dict(audit.run_audits([audit.Audit(rows, {"null": F.col("b").isNull()}, unique={"a": ["a"], "ab": ["a", "b"], "b": ["b"]})]))
    assert {n: i for n, (i, _) in found.items()} == {"null": 1, "a": 1, "ab": 1, "b": 1}
