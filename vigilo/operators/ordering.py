"""Sort, limit, top-k, lookup (O1-O6) and set operations.

Top-k is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: each partition keeps its own k best rows and only
``partitions x k`` rows move - never a full sort.  A limit is kept only where
it is the feature (a top-k report).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



# O2 -------------------------------------------------------------------------
def top_k(df: DataFrame, col: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(col).desc(), *[F.col(t).asc() for t in tie]).limit(k)



# O3 -------------------------------------------------------------------------
def recent(df: DataFrame, ts: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in tie]).limit(n)


# O4 -------------------------------------------------------------------------
def worklist_sort(df: DataFrame, eligible: str = "eligible", alert: str = "alert",
                  name: str = "name") -> DataFrame:
    return df.orderBy(F.col(eligible).desc(), F.col(alert).desc(), F.lower(F.col(name)).asc())


# O5 -------------------------------------------------------------------------
def limit_cohort(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


# O6 -------------------------------------------------------------------------
def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality reaches the Parquet reader as a pushed filter."""
    return df.filter(F.col(key) == F.lit(value))


# X1 -------------------------------------------------------------------------
def key_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().subtract(b.select(key).distinct())


# X2 -------------------------------------------------------------------------
def coverage(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Distinct test values, how many were seen in training, and the ratio.
    The unseen values themselves are rows of :func:`key_except`."""
    tv = test.select(F.col(col).alias("v")).filter(F.col("v").isNotNull()).distinct()
    seen = train.select(F.col(col).alias("v")).filter(F.col("v").isNotNull()).distinct() \
        .withColumn("_seen", F.lit(1))
    j = tv.join(seen, ["v"], "left")
    return j.agg(F.count(F.lit(1)).alias("n_test_values"),
                 F.sum(F.coalesce(F.col("_seen"), F.lit(0))).cast("long").alias("n_seen")) \
        .withColumn("coverage", F.when(F.col("n_test_values") > 0,
                                       F.col("n_seen") / F.col("n_test_values")).otherwise(F.lit(1.0)))


# X3 -------------------------------------------------------------------------
def union_results(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# X4 -------------------------------------------------------------------------
def schema_diff(df: DataFrame, expected: Sequence[str]) -> dict:
    """Missing and extra column names (driver-side: schemas are metadata)."""
    have, want = set(df.columns), set(expected)
    return {"missing": sorted(want - have), "extra": sorted(have - want)}


def missing_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column null share from one aggregate, flagged above 50 %."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("_n"), *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in cols])
    long = row.unpivot(["_n"], list(cols), "column", "nulls")
    return long.select("column", (F.col("nulls") / F.col("_n")).alias("null_share")) \
        .withColumn("too_sparse", F.col("null_share") > 0.5)
