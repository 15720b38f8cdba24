"""A query's rows against those of its SQL in DuckDB, whatever their order."""

import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f[: -len('.parquet')]} as select * from '{folder}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def same(spark, folder, con, query, sql):
    df = query(spark, folder)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())
