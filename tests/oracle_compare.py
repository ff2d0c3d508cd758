"""Runs a query on Spark and its SQL on DuckDB and compares the full results."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _family(dtype) -> str:
    if pd.api.types.is_bool_dtype(dtype):
        return "bool"
    if pd.api.types.is_integer_dtype(dtype):
        return "int"
    if pd.api.types.is_float_dtype(dtype):
        return "float"
    if pd.api.types.is_datetime64_any_dtype(dtype):
        return "time"
    return "text"


def _rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
                cells.append("NULL")
            elif isinstance(v, float):
                cells.append(repr(v))
            else:
                cells.append(str(v))
        out.append("\x1f".join(cells))
    return sorted(out)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; empty when rows, names, types and values agree."""
    left = spark_df.toPandas()
    right = con.execute(sql).df()
    problems = []
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} != {sorted(right.columns)}"]
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    for c in left.columns:
        a, b = _family(left[c].dtype), _family(right[c].dtype)
        if a != b and not (left[c].isna().any() or right[c].isna().any()):
            problems.append(f"type of {c}: {a} != {b}")
        if {a, b} == {"int", "float"}:
            left[c], right[c] = left[c].astype(float), right[c].astype(float)
    for c in left.columns:
        if _family(left[c].dtype) == "time":
            left[c], right[c] = left[c].astype("datetime64[us]"), right[c].astype("datetime64[us]")
    a, b = _rows(left), _rows(right)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        problems.append(f"values differ: spark {only_a} / duckdb {only_b}, {len(set(a) - set(b))} rows")
    return problems
