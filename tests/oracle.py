"""Compares a query with its SQL in DuckDB, without regard to the order of rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def _value(v):
    if pd.isna(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.6g}"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_value(x) for x in r) for r in frame[columns].itertuples(index=False))


def check(df, sql: str, sf_dir: str) -> int:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = rows(df.toPandas()), rows(db.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    return len(got[1])
