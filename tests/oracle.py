"""Runs a query and its SQL over the same Parquet tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [list(r.asDict(recursive=True).values()) for r in df.collect()])
    out = tables(sf_dir).execute(sql)
    names = [d[0] for d in out.description]
    want = rows_of(names, out.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else ""
