"""Runs a query and its DuckDB equivalent on the same tables."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def oracle(sql: str, sf: str, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    for name, table in tables.items():
        con.execute(f"DROP VIEW IF EXISTS {name}")
        con.register(name, table)
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same(df, sql: str, sf: str, **tables) -> None:
    names, rows = oracle(sql, sf, **tables)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    left = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    right = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rows)
    assert left == right
