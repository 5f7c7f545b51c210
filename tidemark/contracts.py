"""Row contracts of the datasets: schema, required columns, keys, order and scope of deduplication, targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """What a dataset's rows must look like and how they are loaded.

    ``targets`` maps a target table to its key; ``scope`` is "file" or "dataset" and says
    where keys must be distinct; ``cursor`` is the high-water column of incremental reads.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    mode: str = "incremental_timestamp"
    cursor: str | None = None
    order: tuple[str, ...] = ()
    scope: str = "file"
    targets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    prepare: Callable[[DataFrame], DataFrame] | None = None

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(), "decimal(12;2)": T.DecimalType(12, 2), "decimal(15;2)": T.DecimalType(15, 2),
}


def _schema(text: str) -> T.StructType:
    """Columns as ``name type`` with an exclamation mark for required ones."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name.rstrip("!"), _TYPES[kind], not name.endswith("!")))
    return T.StructType(fields)


REF_COUNTRIES = Contract("ref_countries", _schema("code! string, name! string"), ("code",), "full_snapshot")
COMPANIES = Contract("companies", _schema("cuit! string, name! string, type! string, country_code string, created_at timestamp_ntz, updated_at timestamp_ntz"), ("cuit",), cursor="updated_at", order=("updated_at",))
PRODUCTS = Contract("products", _schema("id! bigint, name! string, supplier_cuit string, base_price decimal(12;2), created_at timestamp_ntz, updated_at timestamp_ntz"), ("id",), cursor="updated_at", order=("updated_at",))
COMPANY_CATALOGS = Contract("company_catalogs", _schema("company_cuit! string, product_id! bigint, sale_price decimal(12;2), created_at timestamp_ntz, updated_at timestamp_ntz"), ("company_cuit", "product_id"), cursor="updated_at", order=("updated_at",))
CUSTOMERS = Contract("customers", _schema("id! bigint, company_cuit string, document_number! string, username! string, first_name! string, last_name! string, email! string, phone_number string, birth_date! date, created_at timestamp_ntz"), ("id",), cursor="created_at", order=("created_at",))
ORDERS = Contract("orders", _schema("id! bigint, company_cuit string, customer_id bigint, status! string, order_date timestamp_ntz, total_amount decimal(15;2), created_at timestamp_ntz, updated_at timestamp_ntz"), ("id",), cursor="updated_at", order=("updated_at",))
ORDER_ITEMS = Contract("order_items", _schema("id! bigint, order_id! bigint, product_id bigint, quantity int, unit_price decimal(12;2)"), ("id",), "incremental_id", cursor="id")
LEAD_CONVERSIONS = Contract("lead_conversions", _schema("lead_id! string, company_cuit string, company_name string, country_code string, lead_status string, lead_source string, conversion_probability double, converted_at timestamp_ntz, source_file string, conversion_window_days int, created_at timestamp_ntz"), ("lead_id",))
MARKETING_LEADS = Contract(
    "marketing_leads",
    _schema("lead_id! string, created_at! timestamp_ntz, company_name! string, is_prospect! boolean, industry! string, contact_name! string, contact_email! string, contact_phone string, lead_source! string, estimated_annual_revenue! double, country_code! string, status! string, status_updated_at timestamp_ntz, last_activity_at timestamp_ntz"),
    ("lead_id",), "files", order=("status_updated_at",), scope="dataset",
    targets={"marketing_leads_current": ("lead_id",), "marketing_leads_history": ("lead_id", "_ingestion_run_id")},
)
WEBSERVER_LOGS = Contract(
    "webserver_logs",
    _schema("event_id! string, remote_host string, username string, event_ts! timestamp_ntz, user_agent string, request_path string, status_code bigint"),
    ("event_id",), "files", order=("event_ts",),
)

CONTRACTS = {c.name: c for c in (REF_COUNTRIES, COMPANIES, PRODUCTS, COMPANY_CATALOGS, CUSTOMERS, ORDERS, ORDER_ITEMS, LEAD_CONVERSIONS, MARKETING_LEADS, WEBSERVER_LOGS)}
