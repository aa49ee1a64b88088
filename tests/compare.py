"""Spark's result against DuckDB's, whatever the order of rows and columns."""

import glob
import os

import duckdb
import pandas as pd


def oracle(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return repr(round(float(v), 6) + 0.0)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
