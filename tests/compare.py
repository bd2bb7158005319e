"""Rows of a DataFrame and of a DuckDB query in one form."""

import decimal
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}" if v != v or v != int(v) else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
