"""Rows of a Spark query against those of its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, Decimal) or isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return round(float(v), 9)
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_plain(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)
