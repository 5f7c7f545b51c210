"""Row functions of the commerce models, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the time that stands for "never" in cursor comparisons.
NEVER = "1900-01-01 00:00:00"

#: Device families by a part of the lower-case user agent, first match wins.
DEVICE_FAMILIES = (
    (("bot", "crawler", "spider"), "Bot/Crawler"),
    (("iphone",), "iPhone"),
    (("android",), "Android"),
    (("ipad", "tablet"), "Tablet"),
    (("windows",), "Windows Desktop"),
    (("macintosh", "mac os"), "Mac Desktop"),
    (("linux",), "Linux Desktop"),
)

#: Trade regions by country code.
COUNTRY_REGION = {
    "US": "AMER", "CA": "AMER", "BR": "AMER", "MX": "AMER", "AR": "AMER",
    "GB": "EMEA", "DE": "EMEA", "FR": "EMEA", "IT": "EMEA", "ES": "EMEA", "NL": "EMEA", "AE": "EMEA", "QA": "EMEA", "SA": "EMEA",
    "CN": "APAC", "JP": "APAC", "IN": "APAC", "AU": "APAC", "SG": "APAC", "KR": "APAC",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(text: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


def first_set(*cs: Column | str) -> Column:
    """The first that is set, else the time that stands for never."""
    return F.coalesce(*[col(c) for c in cs], ts(NEVER))


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^\s+", ""), r"\s+$", "")


def cents(c: Column | str) -> Column:
    """Rounds a double to two decimals by way of whole hundredths."""
    return F.round(col(c) * 100) / 100


def parse_ts_lenient(c: Column | str, normalize_utc: bool = False) -> Column:
    """Timestamp from text in several forms, else null.

    White space at the ends is dropped and the first T becomes a space. A Z or an offset at
    the end is dropped without moving the time, or applied with ``normalize_utc``. Text
    without a time of day, and anything that isn't a timestamp, gives null.
    """
    text = F.regexp_replace(stripped(c), "^([^T]*)T", "$1 ")
    offset = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 0)
    local = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    found = F.regexp_extract(local, r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?", 0)
    parsed = F.nullif(found, F.lit("")).try_cast("timestamp_ntz")
    if not normalize_utc:
        return parsed
    sign = F.when(offset.startswith("-"), 1).otherwise(-1)
    minutes = F.when(offset == "", 0).otherwise(sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(F.replace(offset, F.lit(":"), F.lit("")), 4, 2).cast("int")))
    return parsed + F.make_dt_interval(mins=minutes)


def tolerant_bool(c: Column | str) -> Column:
    """True for 1, true, t, yes, y in any case; false for all else, null included."""
    return F.coalesce(F.lower(stripped(col(c).cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def device_family(agent: Column | str) -> Column:
    a = F.lower(col(agent))
    out = F.when(col(agent).isNull() | (F.trim(col(agent)) == "") | (col(agent) == "-"), "Unknown")
    for parts, family in DEVICE_FAMILIES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | a.contains(p)
        out = out.when(hit, family)
    return out.otherwise("Other")


def status_class(code: Column | str) -> Column:
    c = col(code)
    return F.when(c.between(200, 599), F.concat(F.floor(c / 100).cast("string"), F.lit("xx"))).otherwise("other")


def is_error(code: Column | str) -> Column:
    return F.coalesce(col(code) >= 400, F.lit(False))


def name_key(c: Column | str) -> Column:
    """Names are matched without white space at the ends and in lower case."""
    return F.lower(stripped(c))


def region(country: Column | str) -> Column:
    """Trade region of a country code in any case; ROW for unknown and missing ones."""
    table = F.create_map(*[F.lit(x) for x in chain(*COUNTRY_REGION.items())])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.upper(col(country)), F.lit(""))), F.lit("ROW"))


def trade_lane(client: Column | str, supplier: Column | str) -> Column:
    """domestic (same country), regional (same region), else global."""
    a, b = F.nullif(F.upper(col(client)), F.lit("")), F.nullif(F.upper(col(supplier)), F.lit(""))
    return F.when(a == b, "domestic").when(region(client) == region(supplier), "regional").otherwise("global")


def user_cohort(created_at: Column | str, as_of: Column, days: int) -> Column:
    """new if created within ``days`` before ``as_of``, else (also without a date) returning."""
    return F.when(col(created_at) >= as_of - F.make_dt_interval(days=F.lit(days)), "new").otherwise("returning")


def age_days(at: Column, as_of: Column) -> Column:
    """Whole days from ``at`` to ``as_of``, never negative."""
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", at, as_of) / 86400))
