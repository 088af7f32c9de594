"""Runs a query and its oracle side by side."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if x is None or isinstance(x, (bool, str, bytes)):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if isinstance(x, dict):
        return tuple(norm(y) for y in x.values())
    if isinstance(x, (dt.datetime, dt.date)):
        return str(x)
    return int(x) if hasattr(x, "__index__") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    r = con.sql(sql)
    return sorted(r.columns), rows_of(r.columns, r.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def same(df, sf_dir: str, sql: str) -> None:
    a, b = spark_rows(df), duck(sf_dir, sql)
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    assert not bad, (len(bad), bad[:3])
