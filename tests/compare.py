"""Results of a query and of its SQL as sorted lists of plain rows."""

import os
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (datetime, pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(df.columns), sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


def duck(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con.execute(sql).df()
