"""Runs a query and its SQL twin over the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(x) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT:
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x)).lower()
    return str(x)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if equal, else what differs."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    want = rows(names, cursor.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return ""
    extra = [r for r in got if r not in set(want)][:2]
    lost = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows for {len(want)}; only here {extra}; only in SQL {lost}"
