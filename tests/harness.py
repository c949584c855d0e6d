"""Runs a query and its SQL over the same tables and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def compare(df, sql, sf_dir):
    """None if equal, else what differs."""
    (a, x), (b, y) = spark_rows(df), oracle_rows(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only here {list((x - y).items())[:3]}; only there {list((y - x).items())[:3]}"
    return None
