"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", float(value))
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else float(f"{value:.9g}"))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df, con, sql: str):
    """(ok, message) for one query."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    got_cols = df.columns
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    order = sorted(got_cols)
    got_rows = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    index = [want_cols.index(c) for c in order]
    want_rows = [tuple(plain(r[i]) for i in index) for r in want]
    a, b = Counter(got_rows), Counter(want_rows)
    if a == b:
        return True, f"{len(got_rows)} rows"
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    key = lambda r: tuple(str(x) for x in r)
    return False, (f"rows {len(got_rows)} vs {len(want_rows)}; cols {order}\n  spark only "
                   f"{len(only_a)}: {sorted(only_a, key=key)[:3]}\n  sql only {len(only_b)}: {sorted(only_b, key=key)[:3]}")
