"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, f, sql, sf_dir):
    df = f(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = rows([x[0] for x in cur.description], cur.fetchall())
    assert a[0] == b[0], f"columns {a[0]} {b[0]}"
    assert len(a[1]) == len(b[1]), f"rows {len(a[1])} {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not bad, f"{len(bad)} of {len(a[1])} rows differ: {bad[:2]}"
    return len(a[1])
