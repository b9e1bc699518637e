"""Runs a query and its DuckDB SQL on the same tables."""

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(data) -> list:
    return sorted((tuple(map(plain, r)) for r in data), key=repr)


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())
