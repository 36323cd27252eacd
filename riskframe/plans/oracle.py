"""Local oracle check: run a registered query on Spark and its SQL on DuckDB
over the same parquet files and compare order-insensitively.

Used by the tests; mirrors the driver's check (column names, row count,
values after normalisation).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb
import numpy as np
import pandas as pd

from ..session import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return None
        r = round(float(v), digits)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, np.datetime64):
        return pd.Timestamp(v).isoformat(sep=" ")
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if v is pd.NaT:
        return None
    return v


def normalise(pdf: pd.DataFrame, digits: int = 6) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(v, digits) for v in rec))
    rows.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return cols, rows


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection, digits: int = 6) -> tuple[bool, str]:
    left = spark_df.toPandas()
    right = con.sql(sql).to_arrow_table().to_pandas(date_as_object=True)
    lc, lrows = normalise(left, digits)
    rc, rrows = normalise(right, digits)
    if lc != rc:
        return False, f"columns differ: spark={lc} oracle={rc}"
    if len(lrows) != len(rrows):
        return False, f"row count differs: spark={len(lrows)} oracle={len(rrows)}"
    bad = [(a, b) for a, b in zip(lrows, rrows) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, first: spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(lrows)} rows match"
