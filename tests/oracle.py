"""Comparison of registered queries with DuckDB on the same tables."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = rows_of(names, out.fetchall())
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
