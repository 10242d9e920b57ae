"""Rows of a Spark result and of its SQL twin in one comparable form."""

import os

import duckdb
import pandas as pd


def cell(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and getattr(v, "ndim", 0):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return "N"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted("|".join(map(cell, r)) for r in frame.itertuples(index=False))


def by_sql(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    return pd.DataFrame(done.fetchall(), columns=names)
