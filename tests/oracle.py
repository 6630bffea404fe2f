"""Compares a query with its DuckDB oracle, without regard to the order of rows."""

import glob
import numbers
import os

import duckdb
import pandas as pd


def rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)

    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(value, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def duck(sql: str, folder: str):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c.sql(sql).df()


def same(df, sql: str, folder: str) -> bool:
    got, want = df.toPandas(), duck(sql, folder)
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got) == rows(want)
