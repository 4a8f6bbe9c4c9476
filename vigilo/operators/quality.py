"""Data-quality profiling and scoring (Q1-Q8, Q11, Q12).

Profiles are computed for all columns at once: a single wide aggregate (null
counts, whitespace counts) or one grouped aggregate over the unpivoted
``(column, value)`` form, never one job per column.  Outlier detection is two
passes in total - exact quartiles for every numeric column, then one counting
pass against the per-column fences (a table with one row per column).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilo.functions import scalar as S
from vigilo.operators.aggregates import duplicate_count, unpivot_numeric
from vigilo.operators.ordered import exact_quantiles
from vigilo.presets import clinical as C

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    out = []
    for f in df.schema.fields:
        low = f.name.lower()
        if isinstance(f.dataType, TEMPORAL) or ("date" in low or "dt" in low):
            out.append(f.name)
    return out


# Q1 -------------------------------------------------------------------------
def completeness(df: DataFrame) -> DataFrame:
    """Per column: records, non-null, null, null % and completeness % (2 places)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in cols])
    long = row.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("null_count")) for c in cols])).alias("s"))
    long = long.select(F.col("_n").alias("total_records"), "s.*")
    pct = F.when(F.col("total_records") > 0, F.col("null_count") * 100.0 / F.col("total_records")) \
        .otherwise(F.lit(0.0))
    return long.select("column", "total_records",
                       (F.col("total_records") - F.col("null_count")).alias("non_null_count"),
                       "null_count", F.round(pct, 2).alias("null_percentage"),
                       F.round(100 - pct, 2).alias("completeness"))


def overall_completeness(df: DataFrame) -> DataFrame:
    cols = df.columns
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in cols), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("missing"))
    cells = F.col("rows") * len(cols)
    return row.select(F.col("rows").alias("total_rows"), F.lit(len(cols)).alias("total_columns"),
                      cells.alias("total_cells"), F.coalesce(F.col("missing"), F.lit(0)).alias("total_missing"),
                      F.round(F.when(cells > 0, (cells - F.col("missing")) * 100.0 / cells).otherwise(0.0), 2)
                      .alias("overall_completeness"))


# Q2 -------------------------------------------------------------------------
def validity(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric profile with IQR outliers (strictly outside the 1.5 IQR fences)."""
    cols = list(cols or numeric_columns(df))
    # One pass over the table: everything below comes from the counts per distinct value,
    # which are written once for their three uses.
    counts = (unpivot_numeric(df, cols, var="column").groupBy("column", "value")
              .agg(F.count(F.lit(1)).alias("n")).checkpoint())
    v, n = F.col("value"), F.col("n")
    known = F.sum(F.when(v.isNotNull(), n))
    stats = counts.groupBy("column").agg(
        F.sum(n).alias("_rows"), known.alias("_known"), F.count(v).alias("unique_values"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * n) / known).alias("_mean"))
    q = exact_quantiles(counts, ["column"], "value", [0.25, 0.5, 0.75], "n")
    quart = q.groupBy("column").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))
    per = stats.join(quart, ["column"], "left").withColumns({
        "lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    # One row per profiled column: the table's size is fixed by the caller.
    marked = counts.join(F.broadcast(per.select("column", "_mean", "lower_fence", "upper_fence")), ["column"])
    spread = marked.groupBy("column").agg(
        F.sum(F.when((v < F.col("lower_fence")) | (v > F.col("upper_fence")), n).otherwise(0)).cast("long").alias("outliers"),
        F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_m2"))
    std = F.when(F.col("_known") > 1, F.sqrt(F.col("_m2") / (F.col("_known") - 1)))
    return per.join(spread, ["column"], "left").select(
        "column", "unique_values",
        F.round(F.col("unique_values") * 100.0 / F.col("_rows"), 2).alias("unique_percentage"),
        "min", "max", F.round("_mean", 2).alias("mean"), "median", F.round(std, 2).alias("std"),
        "q1", "q3", "lower_fence", "upper_fence", "outliers",
        F.round(F.col("outliers") * 100.0 / F.col("_rows"), 2).alias("outliers_percentage"))


def top_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most common value per string column (ties: smallest value) and its count."""
    cols = list(cols or string_columns(df))
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by(F.struct(F.col("value"), F.col("n")), F.struct(-F.col("n"), F.col("value"))).alias("t")) \
        .select("column", F.col("t.value").alias("most_common_value"),
                F.col("t.n").cast("long").alias("most_common_count"))


# Q3 -------------------------------------------------------------------------
def consistency(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per string column: rows with surrounding whitespace, distinct and
    case-folded distinct counts, and the mixed-case flag (only under 100
    distinct values)."""
    cols = list(cols or string_columns(df))
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    v = F.col("value")
    per = long.groupBy("column").agg(
        F.sum(F.when(v.isNotNull() & (S.strip(v) != v), 1).otherwise(0)).cast("long").alias("whitespace_rows"),
        F.count_distinct(v).alias("distinct_values"),
        F.count_distinct(F.lower(v)).alias("distinct_lower"),
        F.count(v).alias("non_null"))
    mixed = (F.col("distinct_values") < 100) & (F.col("distinct_lower") < F.col("distinct_values"))
    return per.select("column", "whitespace_rows", "distinct_values", "distinct_lower",
                      mixed.alias("mixed_case"),
                      F.when(mixed, F.col("non_null")).otherwise(F.lit(0)).cast("long").alias("mixed_case_rows"))


def duplicate_share(df: DataFrame) -> DataFrame:
    dup = duplicate_count(df)
    total = df.agg(F.count(F.lit(1))).scalar()
    return dup.select("duplicates", F.round(F.when(total > 0, F.col("duplicates") * 100.0 / total)
                                            .otherwise(F.lit(0.0)), 2).alias("duplicate_percentage"))


# Q4 -------------------------------------------------------------------------
def accuracy_rules(df: DataFrame, as_of_year: int) -> DataFrame:
    """Rule violations by column name: year/yr in 1900..as_of_year, age in 0..120."""
    rules = []
    for c in numeric_columns(df):
        low = c.lower()
        if "year" in low or "yr" in low:
            rules.append((c, f"Year should be between 1900 and {as_of_year}",
                          (F.col(c) < 1900) | (F.col(c) > as_of_year)))
        if "age" in low:
            rules.append((c, "Age should be between 0 and 120", (F.col(c) < 0) | (F.col(c) > 120)))
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, rule string, violations long")
    row = df.agg(*[F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias(f"r{i}")
                   for i, (_, _, bad) in enumerate(rules)])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(msg).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, (c, msg, _) in enumerate(rules)])).alias("s")).select("s.*")
    return long.filter(F.col("violations") > 0)


# Q5 -------------------------------------------------------------------------
def timeliness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or date_columns(df))
    parsed = df.select(*[F.col(c).cast("timestamp").alias(c) if isinstance(df.schema[c].dataType, TEMPORAL)
                         else F.try_to_timestamp(F.col(c).cast("string")).alias(c) for c in cols])
    row = parsed.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
                     *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"mn{i}").alias("earliest"), F.col(f"mx{i}").alias("latest"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    return long.filter(F.col("earliest").isNotNull()).withColumn(
        "date_range_days", S.day_diff("latest", "earliest"))


# Q6 / Q7 ------------------------------------------------------------------------
def quality_score(df: DataFrame, strict: bool = False, table_name: str = "table") -> DataFrame:
    """Completeness x 0.4 + consistency x 0.3 + validity x 0.3, and a grade.

    Validity loses 10 points per numeric column with more than 10 % outliers.
    ``strict`` (the cleaning variant) also takes 5 points off consistency for
    every column with surrounding whitespace and every mixed-case column.
    """
    comp = overall_completeness(df).select("overall_completeness")
    dup = duplicate_share(df)
    nums = numeric_columns(df)
    if nums:
        bad_cols = validity(df, nums).agg(F.sum(F.when(F.col("outliers_percentage") > 10, 1).otherwise(0)))
        bad = F.coalesce(bad_cols.scalar(), F.lit(0))
    else:
        bad = F.lit(0)
    penalty = F.lit(0)
    strs = string_columns(df)
    if strict and strs:
        cons = consistency(df, strs).agg(
            F.sum(F.when(F.col("whitespace_rows") > 0, 5).otherwise(0) +
                  F.when(F.col("mixed_case"), 5).otherwise(0)))
        penalty = F.coalesce(cons.scalar(), F.lit(0))
    comp_score = comp.scalar()
    cons_score = F.greatest(F.lit(0.0), 100 - dup.select("duplicate_percentage").scalar() - penalty)
    val_score = F.greatest(F.lit(0.0), 100 - bad * 10.0)
    overall = comp_score * 0.4 + cons_score * 0.3 + val_score * 0.3
    spark = df.sparkSession
    one = spark.range(1)
    return one.select(F.lit(table_name).alias("table_name"),
                      F.round(comp_score, 2).alias("completeness_score"),
                      F.round(cons_score, 2).alias("consistency_score"),
                      F.round(val_score, 2).alias("validity_score"),
                      F.round(overall, 2).alias("overall_score"),
                      S.band(overall, C.QUALITY_GRADES, C.QUALITY_GRADE_DEFAULT).alias("quality_grade"))


# Q8 -------------------------------------------------------------------------
def quality_summary(scores: DataFrame) -> DataFrame:
    """Per-table recommendations (only below 80 overall; per-dimension cut 90)
    plus an overall average row."""
    advice = F.array_compact(F.array(
        *[F.when(F.col(c) < 90, F.lit(text)) for c, text in C.QUALITY_ADVICE.items()]))
    per = scores.withColumn("recommendations",
                            F.when(F.col("overall_score") < 80, F.array_join(advice, "; ")).otherwise(F.lit("")))
    avg = scores.agg(F.lit("ALL").alias("table_name"),
                     *[F.round(F.avg(c), 2).alias(c) for c in
                       ("completeness_score", "consistency_score", "validity_score", "overall_score")])
    avg = avg.withColumn("quality_grade", S.band("overall_score", C.QUALITY_GRADES, C.QUALITY_GRADE_DEFAULT)) \
        .withColumn("recommendations", F.lit(""))
    return per.unionByName(avg)


# Q11 ------------------------------------------------------------------------
def validate_dataset(df: DataFrame, label: str) -> DataFrame:
    """One status row: label present, at least two classes, duplicates, rows."""
    if label not in df.columns:
        return df.sparkSession.range(1).select(
            F.lit(False).alias("valid"), F.lit(f"missing label column {label}").alias("reason"),
            F.lit(None).cast("long").alias("n_classes"), F.lit(None).cast("long").alias("rows"),
            F.lit(None).cast("long").alias("duplicates"))
    dup = duplicate_count(df).scalar()
    stats = df.agg(F.count_distinct(label).alias("n_classes"), F.count(F.lit(1)).alias("rows"))
    return stats.select((F.col("n_classes") >= 2).alias("valid"),
                        F.when(F.col("n_classes") < 2, F.lit("fewer than two classes")).otherwise(F.lit("ok"))
                        .alias("reason"), F.col("n_classes").cast("long").alias("n_classes"),
                        F.col("rows").cast("long").alias("rows"), dup.alias("duplicates"))


# Q12 ------------------------------------------------------------------------
def _distinct_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "column", "value").filter(F.col("value").isNotNull()).distinct())


def unknown_categories(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) rows for test values never seen in training - one row
    each, so a high-cardinality column never becomes one huge cell."""
    return _distinct_long(test, cols).join(_distinct_long(train, cols), ["column", "value"], "left_anti")


def category_coverage(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per categorical column: distinct test values, how many were seen in
    training, coverage ratio, and valid only when nothing is unseen."""
    cols = list(cols)
    tr = _distinct_long(train, cols).withColumn("_seen", F.lit(1))
    j = _distinct_long(test, cols).join(tr, ["column", "value"], "left")
    return j.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_test_values"),
        F.sum(F.coalesce(F.col("_seen"), F.lit(0))).cast("long").alias("n_seen")) \
        .withColumn("n_unknown", F.col("n_test_values") - F.col("n_seen")) \
        .withColumn("coverage", F.col("n_seen") / F.col("n_test_values")) \
        .withColumn("valid", F.col("n_seen") == F.col("n_test_values"))



