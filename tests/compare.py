"""Spark result against the SQL of the same query on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if hasattr(v, "item"):
        v = v.item()
        return None if isinstance(v, float) and math.isnan(v) else v
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, sorted."""
    frame = frame[sorted(frame.columns)]
    out = [tuple(_cell(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    """Empty if both hold the same rows exactly."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"]
    a, b = rows(spark_frame), rows(sql_frame)
    found = [] if len(a) == len(b) else [f"{len(a)} rows != {len(b)} rows"]
    if a != b:
        left, right = set(map(repr, a)), set(map(repr, b))
        found.append(f"only spark: {sorted(left - right)[:3]}; only sql: {sorted(right - left)[:3]}")
    return found
