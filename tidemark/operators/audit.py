"""All checks of a table in one pass: rules become one conditional aggregate, parents are looked up once, uniqueness is one grouping."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import COMPANY_TYPES, ORDER_STATUSES


@dataclass
class Lookup:
    """A parent of a table: ``facts`` are aggregates of the parent's rows of a key, null where there is none.

    The parent is grouped by its key, so a key that repeats doesn't multiply the table's
    rows; equal parents of several tables are one exchange in the plan.
    """

    parent: DataFrame
    key: list[str]
    own: list[str]
    facts: dict[str, Column]


@dataclass
class Audit:
    """The checks of one table.

    ``rules`` tell a bad row, with the columns of the lookups. ``unique`` are columns whose
    values should occur once; values that repeat are counted, nulls are left out. ``groups``
    are rules on aggregates of the rows that share ``by``: name to (aggregates by name, rule over these names).
    """

    rows: DataFrame
    rules: dict[str, Column] = field(default_factory=dict)
    lookups: list[Lookup] = field(default_factory=list)
    unique: dict[str, list[str]] = field(default_factory=dict)
    by: list[str] = field(default_factory=list)
    groups: dict[str, tuple[dict[str, Column], Column]] = field(default_factory=dict)


def _joined(audit: Audit) -> DataFrame:
    rows = audit.rows
    for i, look in enumerate(audit.lookups):
        parent = look.parent.groupBy(*look.key).agg(*[c.alias(n) for n, c in look.facts.items()])
        names = {k: f"__key{i}_{j}" for j, k in enumerate(look.key)}
        parent = parent.select(*[F.col(k).alias(n) for k, n in names.items()], *look.facts)
        on = reduce(Column.__and__, [F.col(o) == F.col(names[k]) for o, k in zip(look.own, look.key, strict=True)])
        rows = rows.join(parent, on, "left").drop(*names.values())
    return rows


def count_issues(audit: Audit) -> DataFrame:
    """Rows (check, issues) of one table, which is scanned once.

    A row becomes one row for its rules and one for each unique check. The first is
    grouped by ``by`` (combined before the shuffle, so no group is hot), the others by
    their value; the groups are then added up.
    """
    rows = _joined(audit)
    rules = {f"__rule{i}": F.coalesce(c, F.lit(False)).cast("long") for i, c in enumerate(audit.rules.values())}
    facts = {n: c for own, _ in audit.groups.values() for n, c in own.items()}
    sets = [F.struct(F.lit(-1).alias("set"), F.lit(None).cast("string").alias("value"))]
    for i, columns in enumerate(audit.unique.values()):
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
        sets.append(F.struct(F.lit(i).alias("set"), F.when(known, F.to_json(F.struct(*columns))).alias("value")))
    if audit.unique:
        rows = rows.withColumn("__of", F.explode(F.array(*sets))).where("__of.set = -1 or __of.value is not null")
    else:
        rows = rows.withColumn("__of", sets[0])
    first = F.col("__of.set") == -1
    by = [F.when(first, F.col(k)).alias(f"__by{i}") for i, k in enumerate(audit.by)]
    aggregates = [F.sum(F.when(first, c)).alias(n) for n, c in rules.items()] + [c.alias(n) for n, c in facts.items()]
    grouped = rows.groupBy(F.col("__of.set").alias("__set"), F.col("__of.value").alias("__value"), *by).agg(F.count("*").alias("__n"), *aggregates)
    grouped = grouped.withColumn("__rows", F.col("__set") == -1)
    total = [F.sum(n).alias(n) for n in rules]
    total += [F.count_if(F.col("__rows") & F.coalesce(rule, F.lit(False))).alias(f"__group{i}") for i, (_, rule) in enumerate(audit.groups.values())]
    total += [F.count_if((F.col("__set") == i) & (F.col("__n") > 1)).alias(f"__unique{i}") for i in range(len(audit.unique))]
    one = grouped.agg(*total)
    names = [*zip(audit.rules, rules, strict=True), *((n, f"__group{i}") for i, n in enumerate(audit.groups)), *((n, f"__unique{i}") for i, n in enumerate(audit.unique))]
    listed = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("issues")) for n, c in names])
    return one.select(F.inline(listed))


def run_audits(audits: list[Audit]) -> DataFrame:
    """Rows (check, issues, ok) of several tables; each is scanned once."""
    return reduce(DataFrame.unionAll, [count_issues(a) for a in audits]).withColumn("ok", F.col("issues") == 0)


def _known(*columns: str) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def business_audits(t: dict[str, DataFrame]) -> list[Audit]:
    """The checks of ``quality.business_checks`` as one pass a table; a row that has an issue counts once for each check."""
    upper = t["companies"].select("cuit", "type", F.upper("country_code").alias("country_code"))
    # one number, so that every child's lookup is the same exchange: 1 for a row that isn't a supplier, 2 for one that isn't a client
    kinds = {"kinds": F.bit_or(F.when(F.col("type") != "Supplier", 1).otherwise(0).bitwiseOR(F.when(F.col("type") != "Client", 2).otherwise(0)))}
    no_company, not_supplier, not_client = F.col("kinds").isNull(), F.col("kinds").bitwiseAND(1) > 0, F.col("kinds").bitwiseAND(2) > 0
    countries = Lookup(t["ref_countries"], ["code"], ["country_code"], {"countries": F.count("*")})

    def company(own: str) -> Lookup:
        return Lookup(t["companies"], ["cuit"], [own], kinds)

    products = Lookup(t["products"], ["id"], ["product_id"], {"products": F.count("*")})
    buyers = Lookup(t["customers"], ["id"], ["customer_id"], {"customers": F.count("*"), "least_cuit": F.min("company_cuit"), "most_cuit": F.max("company_cuit"), "since": F.max("created_at")})
    ordered = Lookup(t["orders"], ["id"], ["order_id"], {"orders": F.count("*"), "buyer_cuit": F.max("company_cuit"), "ordered_total": F.max("total_amount")})
    listed = Lookup(t["company_catalogs"], ["company_cuit", "product_id"], ["buyer_cuit", "product_id"], {"listed": F.count("*")})
    own = F.col("company_cuit")
    audits = [
        Audit(upper, {"company_country": F.col("countries").isNull(), "company_type": F.coalesce(~F.col("type").isin(*COMPANY_TYPES), F.lit(True))}, [countries]),
        Audit(t["products"].select("supplier_cuit"), {"product_supplier": no_company, "product_supplier_type": not_supplier}, [company("supplier_cuit")]),
        Audit(t["customers"].select("company_cuit", "username", "email"), {"customer_company": no_company, "customer_company_type": not_client}, [company("company_cuit")], {"username_unique": ["username"], "email_unique": ["email"]}),
        Audit(t["company_catalogs"].select("company_cuit", "product_id"), {"catalog_company": no_company, "catalog_company_type": not_client, "catalog_product": F.col("products").isNull()}, [company("company_cuit"), products]),
        Audit(t["orders"].select("customer_id", "company_cuit", "status", "total_amount", "order_date"), {
            "order_customer": F.col("customers").isNull(), "order_company": no_company, "order_company_is_customers": (own != F.col("least_cuit")) | (own != F.col("most_cuit")),
            "order_status": F.coalesce(~F.col("status").isin(*ORDER_STATUSES), F.lit(True)), "order_total_positive": ~F.coalesce(F.col("total_amount") > 0, F.lit(False)), "no_time_travel": F.col("order_date") < F.col("since"),
        }, [buyers, company("company_cuit")]),
        Audit(t["order_items"].select("order_id", "product_id", "quantity", "unit_price"), {
            "item_order": F.col("orders").isNull(), "item_product": F.col("products").isNull(), "item_quantity_positive": ~F.coalesce(F.col("quantity") > 0, F.lit(False)),
            "item_price_positive": ~F.coalesce(F.col("unit_price") > 0, F.lit(False)), "item_in_catalog": F.col("orders").isNotNull() & F.col("listed").isNull(),
        }, [ordered, products, listed], by=["order_id"], groups={"order_total_is_items": (
            {"items_total": F.round(F.sum(F.col("quantity") * F.col("unit_price")) * 100) / 100, "order_total": F.max("ordered_total")}, F.abs(F.col("order_total") - F.col("items_total")) > 0.05,
        )}),
    ]
    if "lead_conversions" in t:
        named = Lookup(t["ref_countries"], ["code"], ["country_code"], {"countries": F.count("*")})
        audits.append(Audit(t["lead_conversions"].select("company_cuit", "country_code", "converted_at"), {
            "conversion_company": no_company, "conversion_company_type": not_client,
            "conversion_country": _known("country_code") & F.col("countries").isNull(), "conversion_time": F.col("converted_at").isNull(),
        }, [company("company_cuit"), named]))
    return audits


#: Each model's key, and its columns that refer to another's key.
MODEL_KEYS = {
    "dim_companies": "company_cuit", "dim_customers": "customer_id", "dim_products": "product_id", "dim_datetime": "date_key", "dim_countries": "country_code",
    "fct_orders": "order_id", "fct_order_items": "order_item_id", "fct_marketing_leads_current": "lead_id", "fct_webserver_logs": "event_id",
}
MODEL_REFERENCES = {
    "dim_companies": {"country_code": "dim_countries"}, "dim_customers": {"company_cuit": "dim_companies"}, "dim_products": {"supplier_cuit": "dim_companies"},
    "fct_orders": {"customer_id": "dim_customers", "company_cuit": "dim_companies"}, "fct_order_items": {"order_id": "fct_orders", "product_id": "dim_products"},
    "fct_marketing_leads_current": {"company_cuit": "dim_companies"},
}


def warehouse_audits(m: dict[str, DataFrame]) -> list[Audit]:
    """The checks of ``quality.warehouse_tests`` as one pass a model."""
    audits = []
    for model, key in MODEL_KEYS.items():
        if model not in m:
            continue
        references = {fk: parent for fk, parent in MODEL_REFERENCES.get(model, {}).items() if parent in m}
        lookups = [Lookup(m[parent], [MODEL_KEYS[parent]], [fk], {f"in_{fk}": F.count("*")}) for fk, parent in references.items()]
        rules = {f"{model}.{key}.not_null": F.col(key).isNull()} | {f"{model}.{fk}.in.{parent}": _known(fk) & F.col(f"in_{fk}").isNull() for fk, parent in references.items()}
        columns = [key, *references]
        if model == "dim_companies":
            rules["dim_companies.company_type.accepted"] = ~F.col("company_type").isin(*COMPANY_TYPES)
            columns.append("company_type")
        audits.append(Audit(m[model].select(*dict.fromkeys(columns)), rules, lookups, {f"{model}.{key}.unique": [key]}))
    return audits
