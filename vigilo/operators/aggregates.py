"""Aggregations.

All are single ``groupBy(...).agg(...)`` passes with Spark's partial/final
split, so a hot key is combined map-side.  Statistics that need the whole
value distribution (exact quantiles, modes) are computed from per-value counts
instead of per-group value lists.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.operators.ordered import exact_quantiles


# A1 -------------------------------------------------------------------------
def count_by(df: DataFrame, keys: Sequence[str] | str, name: str = "count") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = df
    for k in keys:
        src = src.filter(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# A2 -------------------------------------------------------------------------
def flag_exprs(col: str, groups: Mapping[str, Sequence[str] | Column]) -> list[Column]:
    out = []
    for flag, values in groups.items():
        cond = values if isinstance(values, Column) else F.col(col).isin(*values)
        out.append(F.max(F.when(cond, 1).otherwise(0)).alias(flag))
    return out


def flags_by(df: DataFrame, key: str, col: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Existence flags per entity, all groups in one aggregate (absent -> 0)."""
    return df.groupBy(key).agg(*flag_exprs(col, groups))


# A3 -------------------------------------------------------------------------
def max_level_by(df: DataFrame, key: str, col: str, name: str = "max_level") -> DataFrame:
    return df.groupBy(key).agg(F.coalesce(F.max(col), F.lit(0)).alias(name))


# A4 -------------------------------------------------------------------------
def rate_by(df: DataFrame, key: str, flag: str, name: str = "rate") -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.col(flag).cast("double")).alias(name))


# A5 -------------------------------------------------------------------------
def label_ever(base: DataFrame, events: DataFrame, key: str, pred: Column,
               name: str = "label", invert: bool = True) -> DataFrame:
    """1 when the entity never had a matching event (``invert``), else the ever-flag."""
    hit = events.filter(pred).select(key).distinct().withColumn("_ever", F.lit(1))
    out = base.join(hit, [key], "left").fillna({"_ever": 0})
    val = (F.lit(1) - F.col("_ever")) if invert else F.col("_ever")
    return out.withColumn(name, val.cast("int")).drop("_ever")


# A6 -------------------------------------------------------------------------
def sample_skewness(c: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from the population skewness g1."""
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from the population excess kurtosis g2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def unpivot_numeric(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = (),
                    var: str = "feature", val: str = "value") -> DataFrame:
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(list(id_cols), list(cols), var, val)


def feature_stats(df: DataFrame, cols: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75),
                  exact: bool = True) -> DataFrame:
    """One row per feature: count, nulls, mean, std (sample), min, max, skew, kurtosis,
    distinct count and quantiles.

    Columns are unpivoted once, so every statistic is one grouped aggregate
    over (feature, value).  Exact quantiles come from a distributed prefix sum
    over per-value counts (no per-group value map); ``exact=False`` uses
    ``percentile_approx`` instead.
    """
    long = unpivot_numeric(df, cols)
    v = F.col("value")
    n = F.count(v)
    stats = long.groupBy("feature").agg(
        n.alias("count"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("nulls"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        sample_skewness(v, n.cast("double")).alias("skewness"),
        sample_kurtosis(v, n.cast("double")).alias("kurtosis"),
        F.count_distinct(v).alias("n_distinct"))
    names = {q: "p" + str(int(round(q * 100))) for q in quantiles}
    if exact:
        q = exact_quantiles(long, ["feature"], "value", quantiles)
        wide = q.groupBy("feature").agg(*[F.max(F.when(F.col("q") == qq, F.col("value"))).alias(nm)
                                          for qq, nm in names.items()])
    else:
        wide = long.groupBy("feature").agg(*[F.percentile_approx(v, qq, 10000).cast("double").alias(nm)
                                             for qq, nm in names.items()])
    return stats.join(wide, ["feature"], "left")


# A7 -------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Counts and shares per value, nulls excluded.

    The total is a scalar subquery (computed once, inlined), not a window over
    all rows or a join.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    total = df.filter(F.col(col).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col(name) / total)


# A8 -------------------------------------------------------------------------
def mode_of(df: DataFrame, col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Most frequent value (smallest on ties), via per-value counts."""
    g = list(group_cols)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*g, col).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*g).agg(
        F.min_by(F.col(col), F.struct(-F.col("_c"), F.col(col))).alias("mode"))


# A9 -------------------------------------------------------------------------
def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first copy (whole row, or on a column subset)."""
    cols = list(subset) if subset else df.columns
    per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicates"))


# A10 ------------------------------------------------------------------------
def prediction_stats(df: DataFrame, ts: str, since, prediction: str = "prediction",
                     label: str = "actual_label", probability: str = "probability") -> DataFrame:
    """One pass: predictions, mean probability and labelled rows after ``since`` (strict)."""
    return (df.filter(F.col(ts) > F.lit(since).cast(df.schema[ts].dataType))
            .agg(F.count(F.lit(1)).alias("n_predictions"),
                 F.avg(probability).alias("avg_probability"),
                 F.avg(F.col(prediction).cast("double")).alias("positive_rate"),
                 F.count(F.col(label)).alias("n_labelled")))


# A11 ------------------------------------------------------------------------
def metric_counts(df: DataFrame, ts: str, since, name: str = "metric_name",
                  value: str = "value") -> DataFrame:
    return (df.filter(F.col(ts) > F.lit(since).cast(df.schema[ts].dataType))
            .groupBy(name).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"))
            .orderBy(F.desc("count"), F.asc(name)))


# A12 ------------------------------------------------------------------------
ROLLUP_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def rollup_exprs(value: str = "value", exact: bool = True) -> list[Column]:
    """All figures as aggregates of one group; ``exact`` percentiles keep a value map per group (streams)."""
    v = F.col(value)
    pct = (lambda q: F.percentile(v, q)) if exact else (lambda q: F.percentile_approx(v, q, 10000).cast("double"))
    return [F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"),
            F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            *[pct(q).alias(name) for name, q in ROLLUP_QUANTILES.items()]]


def rollup_metrics(df: DataFrame, keys: Sequence[str], value: str = "value", exact: bool = True) -> DataFrame:
    """count/sum/min/max/mean/population std/linear percentiles per key.

    Non-numeric values are skipped (``try_cast``).  Exact percentiles come from
    counts per distinct value and running counts over value buckets, so no
    group's values meet in one task; ``exact=False`` estimates them.
    """
    keys = list(keys)
    src = df.withColumn(value, F.expr(f"try_cast(`{value}` AS double)")).filter(F.col(value).isNotNull())
    if not exact:
        return src.groupBy(*keys).agg(*rollup_exprs(value, False))
    figures = src.groupBy(*keys).agg(*rollup_exprs(value)[:6])
    counts = src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    q = exact_quantiles(counts, keys, value, list(ROLLUP_QUANTILES.values()), "_n")
    wide = q.groupBy(*[F.col(k).alias("_k_" + k) for k in keys]).agg(
        *[F.max(F.when(F.col("q") == x, F.col(value))).alias(name) for name, x in ROLLUP_QUANTILES.items()])
    cond = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys]
    return figures.join(wide, cond, "left").drop(*["_k_" + k for k in keys])


def merged_deviation(parts: Column) -> Column:
    """Population standard deviation of groups given as an array of (n, mean, m2):
    squared deviations from the common mean, never differences of large squares."""
    n = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["n"] * p["mean"]) / n
    m2 = F.aggregate(F.transform(parts, lambda p: F.struct(p["n"].alias("n"), p["mean"].alias("mean"), p["m2"].alias("m2"),
                                                            mean.alias("all"))),
                     F.lit(0.0), lambda acc, p: acc + p["m2"] + p["n"] * (p["mean"] - p["all"]) * (p["mean"] - p["all"]))
    return F.sqrt(F.greatest(m2 / n, F.lit(0.0)))


# Count, mean and squared deviations of one slide-sized bucket.
def bucket_part(v: Column) -> Column:
    return F.struct(F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"),
                    (F.var_pop(v) * F.count(v)).alias("m2"))


# A13 ------------------------------------------------------------------------
def alert_statistics(df: DataFrame, severities: Sequence[str], severity: str = "severity",
                     type_col: str = "alert_type", state: str = "status") -> DataFrame:
    """Counts by severity (all listed severities present, zero-filled) and by state."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.sum(F.when(F.col(severity) == s, 1).otherwise(0)).alias("severity_" + s) for s in severities]
    aggs += [F.count_distinct(type_col).alias("n_types")]
    if state in df.columns:
        aggs += [F.sum(F.when(F.col(state) == "active", 1).otherwise(0)).alias("active")]
    return df.agg(*aggs)


# A14 ------------------------------------------------------------------------
def entity_statistics(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("min"),
                  F.max(col).alias("max"), F.avg(col).alias("mean"))


# A15 ------------------------------------------------------------------------
def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Per-class count and share; imbalance = largest / smallest class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.filter(F.col(label).isNotNull()).agg(F.count(F.lit(1))).scalar()
    ext = counts.agg(F.max("count").alias("mx"), F.min("count").alias("mn"))
    ratio = ext.select(F.col("mx") / F.col("mn")).scalar()
    return (counts.withColumn("share", F.col("count") / total)
            .withColumn("imbalance_ratio", ratio)
            .withColumn("warning", F.when(F.col("imbalance_ratio") > 10, "warn")
                        .when(F.col("imbalance_ratio") > 5, "info").otherwise("ok")))


# A16 ------------------------------------------------------------------------
def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion_exprs(label: str, pred: str) -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
            F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
            F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
            F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn")]


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    return df.withColumns({
        "accuracy": _div(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "specificity": _div(tn, tn + fp),
        "f1": _div(2 * precision * recall, precision + recall),
    })


def classification_metrics(df: DataFrame, label: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and derived rates in one aggregate (zero denominators -> 0)."""
    return with_rates(df.groupBy(*group_cols).agg(*confusion_exprs(label, pred)))


# A17 ------------------------------------------------------------------------
def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    y, p = F.col(label), F.col(pred)
    classes = df.select(y.alias("cls")).union(df.select(p.alias("cls"))).distinct()
    # Per-class counts from one grouped pass over (label, prediction) pairs.
    pairs = df.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_true = pairs.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    by_pred = pairs.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    hits = pairs.filter(F.col("y") == F.col("p")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    per = (classes.join(by_true, "cls", "left").join(by_pred, "cls", "left").join(hits, "cls", "left")
           .fillna({"support": 0, "predicted": 0, "tp": 0}))
    per = per.select(F.col("cls").cast("string").alias("class"),
                     _div(F.col("tp").cast("double"), F.col("predicted")).alias("precision"),
                     _div(F.col("tp").cast("double"), F.col("support")).alias("recall"),
                     F.col("support").cast("long").alias("support"))
    per = per.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall")))
    total = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), total.cast("long").alias("support"),
                    F.avg("f1").alias("f1"))
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       _div(F.sum(F.col("precision") * F.col("support")), total).alias("precision"),
                       _div(F.sum(F.col("recall") * F.col("support")), total).alias("recall"),
                       total.cast("long").alias("support"),
                       _div(F.sum(F.col("f1") * F.col("support")), total).alias("f1"))
    return per.unionByName(macro).unionByName(weighted)


# A18 ------------------------------------------------------------------------
def metrics_at(df: DataFrame, label: str, score: str, cutoffs: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Confusion counts at several cut-offs from one pass (no cross join)."""
    y, s = F.col(label), F.col(score)
    aggs = []
    for i, c in enumerate(cutoffs):
        p = s >= F.lit(c)
        aggs += [F.sum(F.when((y == 1) & p, 1).otherwise(0)).alias(f"tp_{i}"),
                 F.sum(F.when((y == 0) & p, 1).otherwise(0)).alias(f"fp_{i}"),
                 F.sum(F.when((y == 0) & ~p, 1).otherwise(0)).alias(f"tn_{i}"),
                 F.sum(F.when((y == 1) & ~p, 1).otherwise(0)).alias(f"fn_{i}")]
    wide = df.filter(s.isNotNull() & y.isNotNull()).agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"),
                 F.col(f"tn_{i}").alias("tn"), F.col(f"fn_{i}").alias("fn"))
        for i, c in enumerate(cutoffs)]))
    return with_rates(wide.select(rows.alias("r")).select("r.*"))


# A19 ------------------------------------------------------------------------
def metric_summary(df: DataFrame, id_col: str, metrics: Sequence[str]) -> DataFrame:
    """Mean/std/min/max/range per metric and the best id (first wins ties)."""
    long = df.unpivot([id_col], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"),
        # Best id by value (nulls never win), first id on ties.
        F.min_by(F.col(id_col), F.when(F.col("value").isNotNull(), F.struct(-F.col("value"), F.col(id_col))))
        .alias("best"))


# A20 ------------------------------------------------------------------------
def importance_summary(df: DataFrame, feature: str, importance: str,
                       categories: DataFrame | None = None) -> DataFrame:
    """Mean importance per feature; with a (category, feature) map, totals per category.

    A feature may belong to two categories; the map is a small table.
    """
    mean = df.groupBy(feature).agg(F.avg(importance).alias("mean_importance"))
    if categories is None:
        return mean
    return (mean.join(categories, [feature], "inner")
            .groupBy("category").agg(F.sum("mean_importance").alias("total_importance"),
                                     F.count(F.lit(1)).alias("n_features")))


# A21 ------------------------------------------------------------------------
def collect_distinct(df: DataFrame, key: str, col: str, limit: int | None = None,
                     name: str | None = None) -> DataFrame:
    arr = F.array_sort(F.collect_set(col))
    if limit:
        arr = F.slice(arr, 1, limit)
    return df.groupBy(key).agg(arr.alias(name or col + "_list"))


# A22 ------------------------------------------------------------------------
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct()


# A23 ------------------------------------------------------------------------
def column_health(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per numeric column: infinite values, zero variance, null share > 0.5."""
    long = unpivot_numeric(df, cols)
    v = F.col("value")
    return long.groupBy("feature").agg(
        F.sum(F.when(v.isin(float("inf"), float("-inf")), 1).otherwise(0)).alias("n_infinite"),
        (F.coalesce(F.var_samp(F.when(~v.isin(float("inf"), float("-inf")), v)), F.lit(0.0)) == 0)
        .alias("zero_variance"),
        (F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)) > 0.5).alias("mostly_null"))
