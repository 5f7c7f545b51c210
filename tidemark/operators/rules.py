"""Business rules on leads, prices, orders and customers, as table operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import age_days, name_key, stripped
from tidemark.operators.dedupe import keep_first

#: Conversion chance by lead status, and factors by lead source.
STATUS_BASE = {"new": 0.002, "contacted": 0.008, "nurturing": 0.010, "qualified": 0.030}
SOURCE_FACTOR = {"referral": 1.35, "webinar": 1.20, "trade show 2026": 1.15, "linkedin ads": 1.00, "google search": 1.00, "cold call": 0.80}
#: Factors by age in days, up to and with the first number; later: 0.55; unknown: 1.
AGE_FACTOR = ((3, 1.15), (7, 1.30), (14, 0.85))
LATE_FACTOR = 0.55
SCORE_BOUNDS = (0.001, 0.200)
MARKUP = 1.4


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.coalesce(F.try_element_at(m, F.coalesce(key, F.lit(""))), F.lit(default))


def name_index(companies: DataFrame, any_repeat: bool = False) -> DataFrame:
    """Client names that name one company: (name_key, cuit, name, country_code).

    With ``any_repeat`` a name on two rows is ambiguous even for one company.
    """
    named = companies.where(F.col("type") == "Client").withColumn("name_key", name_key("name")).where(F.col("name_key") != "")
    n = F.count("*") if any_repeat else F.countDistinct("cuit")
    return named.groupBy("name_key").agg(n.alias("n"), F.min("cuit").alias("cuit"), F.min(stripped("name")).alias("name"), F.min(F.upper("country_code")).alias("country_code")).where(F.col("n") == 1).drop("n")


def last_activity() -> Column:
    return F.coalesce("status_updated_at", "created_at")


def lead_candidates(leads: DataFrame, as_of: Column, window_days: int = 7, converted: DataFrame | None = None) -> DataFrame:
    """Prospects that aren't lost, with an id and a company, active within the window (or at an unknown time), not yet converted."""
    named = (F.coalesce(F.trim("lead_id"), F.lit("")) != "") & (F.coalesce(stripped("company_name"), F.lit("")) != "")
    recent = F.coalesce(last_activity() >= as_of - F.make_dt_interval(days=F.lit(window_days)), F.lit(True))
    live = F.coalesce(F.lower(stripped("status")) != "lost", F.lit(True))
    found = leads.where(F.coalesce(F.col("is_prospect"), F.lit(False)) & named & live & recent)
    return found if converted is None else found.join(converted.select("lead_id").distinct(), "lead_id", "left_anti")


def lead_score(as_of: Column) -> Column:
    """Chance that a lead converts, without noise: 0 for statuses that can't."""
    base = _lookup(STATUS_BASE, F.lower(stripped("status")), 0.0)
    source = _lookup(SOURCE_FACTOR, F.lower(stripped("lead_source")), 1.0)
    revenue = 0.8 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("estimated_annual_revenue", F.lit(0.0))) / 1_000_000.0) * 0.6
    days = age_days(last_activity(), as_of)
    age = F.when(last_activity().isNull(), 1.0)
    for most, factor in AGE_FACTOR:
        age = age.when(days <= most, factor)
    low, high = SCORE_BOUNDS
    score = F.least(F.lit(high), F.greatest(F.lit(low), base * source * revenue * age.otherwise(LATE_FACTOR)))
    return F.when(base <= 0, 0.0).otherwise(score)


def lead_company_match(leads: DataFrame, companies: DataFrame, countries: DataFrame) -> DataFrame:
    """Leads of one existing client: its cuit, and its country or else the lead's, if valid."""
    index = name_index(companies).select("name_key", F.col("cuit").alias("company_cuit"), F.col("country_code").alias("__company_country"))
    valid = countries.select(F.upper("code").alias("__valid")).distinct()
    keyed = leads.withColumn("name_key", name_key("company_name")).withColumn("__lead_country", F.upper(F.trim("country_code")))
    joined = keyed.join(index, "name_key").join(valid, F.col("__lead_country") == F.col("__valid"), "left")
    return joined.withColumn("matched_country", F.coalesce("__company_country", "__valid")).drop("name_key", "__company_country", "__lead_country", "__valid")


def split_name(name: Column) -> tuple[Column, Column]:
    """First part and the rest of a name; commas count as spaces. Null where missing."""
    parts = F.filter(F.split(F.regexp_replace(name, ",", " "), r"\s+"), lambda x: x != "")
    return F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " "))


def customers_from_leads(leads: DataFrame, customers: DataFrame) -> DataFrame:
    """A customer for each lead: names split, phone if given, e-mail only if nobody has it yet.

    Of leads of one e-mail in the batch the first by lead_id gets it.
    """
    first, last = split_name(F.coalesce("contact_name", F.lit("")))
    mail = F.lower(stripped("contact_email"))
    made = leads.select("lead_id", first.alias("first_name"), last.alias("last_name"), F.nullif(stripped("contact_phone"), F.lit("")).alias("phone_number"), F.nullif(mail, F.lit("")).alias("__mail"))
    used = customers.select(F.lower("email").alias("__mail")).where("__mail is not null").distinct()
    free = keep_first(made.where("__mail is not null").join(used, "__mail", "left_anti"), ["__mail"], [F.asc_nulls_last("lead_id")]).select("lead_id", F.col("__mail").alias("email")).distinct()
    return made.join(free, "lead_id", "left").withColumn("email", F.when(F.col("email") == F.col("__mail"), F.col("email"))).drop("__mail").distinct()


def price_cascade(catalogs: DataFrame, products: DataFrame, supplier: str, factor: float) -> DataFrame:
    """Catalog prices after a supplier's base prices change by a factor: the new base price and a markup."""
    raised = products.where(F.col("supplier_cuit") == supplier).select(F.col("id").alias("product_id"), (F.col("base_price") * factor).alias("__base"))
    joined = catalogs.join(raised, "product_id", "left")
    return joined.withColumn("sale_price", F.when(F.col("__base").isNotNull(), F.col("__base") * MARKUP).otherwise(F.col("sale_price"))).select(*catalogs.columns)


def returns_window(orders: DataFrame, as_of: Column, earliest: int = 7, latest: int = 3) -> DataFrame:
    """Completed orders from 7 to 3 days before ``as_of``, both ends included."""
    low, high = (as_of - F.make_dt_interval(days=F.lit(d)) for d in (earliest, latest))
    return orders.where((F.col("status") == "COMPLETED") & F.col("order_date").between(low, high))


def lead_reconcile(leads: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Leads of the last snapshot held against today's clients.

    A prospect whose company now is a client is Converted; another lead of a client is
    Qualified unless its status is final. Name and country become the client's.
    """
    index = name_index(companies, any_repeat=True).select("name_key", F.col("name").alias("__name"), F.col("country_code").alias("__country"))
    joined = leads.withColumn("name_key", name_key("company_name")).join(index, "name_key", "left")
    client, prospect = F.col("__name").isNotNull(), F.coalesce(F.col("is_prospect"), F.lit(False))
    final = F.coalesce(F.col("status").isin("Qualified", "Lost", "Converted"), F.lit(False))
    status = F.when(client & prospect, "Converted").when(client & ~final, "Qualified").otherwise(F.coalesce("status", F.lit("New")))
    changed = ~status.eqNullSafe(F.coalesce("status", F.lit("New")))
    out = joined.withColumn("__changed", changed).withColumn("__status", status)
    updated = F.when(F.col("__changed"), as_of).otherwise(F.col("status_updated_at"))
    columns = {
        "company_name": F.coalesce("__name", stripped("company_name")), "country_code": F.coalesce("__country", "country_code"),
        "is_prospect": prospect & ~client, "status": F.col("__status"), "status_updated_at": updated,
        "last_activity_at": F.coalesce(updated, "last_activity_at", "created_at"),
    }
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in leads.columns])


def orderable_customers(customers: DataFrame, catalogs: DataFrame) -> DataFrame:
    return customers.join(catalogs.select("company_cuit"), "company_cuit", "left_semi")


def append_conversions(ledger: DataFrame, conversions: DataFrame) -> DataFrame:
    """The ledger and, once each, conversions of leads it doesn't have: repeating an append changes nothing."""
    new = conversions.join(ledger.select("lead_id"), "lead_id", "left_anti")
    first = keep_first(new, ["lead_id"], [F.asc_nulls_last("converted_at"), F.asc_nulls_last("company_cuit")])
    return ledger.unionByName(first, allowMissingColumns=True)
