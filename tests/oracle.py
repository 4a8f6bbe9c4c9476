"""Compare a Spark result with DuckDB SQL on the same Parquet tables.

Row count, column names and an order-insensitive multiset of rounded values.
"""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        r = round(float(v), 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (pd.Timestamp, datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if v is pd.NaT:
        return None
    return str(v)


def _kind(dtype: str) -> str:
    """Coarse dtype class; nullable ints may surface as floats on one side."""
    if dtype.startswith("datetime64"):
        return "datetime"
    if dtype in ("Int64", "Int32", "float64"):
        return "float64"  # a nullable integer column: Int64 in DuckDB, float64 in Spark
    return dtype


def rows(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return sorted((tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)),
                  key=lambda t: repr(t))


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    a = spark_df.toPandas()
    b = con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return False, f"columns differ: {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    da = {c: str(a[c].dtype) for c in a.columns}
    db = {c: str(b[c].dtype) for c in b.columns}
    diff = {c: (da[c], db[c]) for c in da if _kind(da[c]) != _kind(db[c])}
    if diff:
        return False, f"dtypes differ (spark, duck): {diff}"
    ra, rb = rows(a), rows(b)
    for x, y in zip(ra, rb):
        if x != y:
            return False, f"first differing row:\n spark {x}\n duck  {y}"
    return True, f"{len(a)} rows"
