"""Run a registered query and its SQL twin on the same files and compare them."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, repr(float(v)) if isinstance(v, float) else str(v))
    return (3, str(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data), [columns[i] for i in order]


def mismatch(spark, con, query, sql, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    df = query(spark, sf_dir)
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    res = con.execute(sql)
    want, cols2 = rows([d[0] for d in res.description], res.fetchall())
    if cols != cols2:
        return f"columns {sorted(set(cols) ^ set(cols2))[:12]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    for a, b in zip(got, want):
        if a != b:
            bad = [(c, x[1], y[1]) for c, x, y in zip(cols, a, b) if x != y]
            return f"{len([1 for p, q in zip(got, want) if p != q])} rows differ, e.g. {bad[:4]}"
    mismatch.seconds = took
    return None
