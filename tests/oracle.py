"""Comparison of a query with its SQL on the same tables, by DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        g = f"{p}/*.parquet" if os.path.isdir(p) else p
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{g}'")
    return db


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, db, sql: str):
    """(columns equal, rows only Spark has, rows only SQL has)."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    return got[0] == want[0], got[1] - want[1], want[1] - got[1]
