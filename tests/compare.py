"""Holds a DataFrame's rows against the oracle's, whatever their order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 4) if math.isfinite(v) else str(v)
    return v if isinstance(v, bool | int) or v is None else str(v)


def bag(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    rows = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    mine, other = bag(df.columns, [tuple(r) for r in df.collect()]), bag(names, rows)
    assert mine == other, (list((mine - other).items())[:2], list((other - mine).items())[:2])
