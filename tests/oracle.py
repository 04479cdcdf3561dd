"""Runs a registered query and its SQL on the same tables and compares columns, rows and values."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 2**53 else float(f"{v:.9g}")
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    left_names, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_names, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    return None
