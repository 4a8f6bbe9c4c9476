"""Metrics, rollups, lookups and model-performance monitoring.

Metric tables are long ``(ts, metric_name, value, tags, source)`` rows; tags
are a ``map<string,string>`` whose JSON rendering has sorted keys, so the
same tag set always groups together.  Rollups are ``groupBy(window(...))``:
tumbling windows aggregate rows directly; sliding windows first
pre-aggregate to slide-sized buckets (count, sum, sum of squares, min, max),
then expand each bucket to the windows that contain it - size/slide small
rows instead of size/slide copies of every raw row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.functions import scalar as S
from vigilo.operators.aggregates import bucket_part, classification_metrics, merged_deviation, rollup_metrics
from vigilo.operators.windows import roc_pr
from vigilo.presets import clinical as C

TAG_TYPE = "map<string,string>"


def sorted_tags(tags) -> F.Column:
    """Canonical JSON text of a tag map (keys sorted)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def parse_tags(json_text) -> F.Column:
    """JSON object text to a map of strings (numbers become their text)."""
    return F.from_json(json_text, "map<string,string>")


# M1 -------------------------------------------------------------------------
def to_metrics(df: DataFrame, ts: str, values: Mapping[str, F.Column], tags: F.Column | None = None,
               source: str = "api") -> DataFrame:
    """Wide records to long metric rows, one per (record, metric) with a non-null value."""
    arr = F.array(*[F.struct(F.lit(name).alias("metric_name"), expr.cast("double").alias("value"))
                    for name, expr in values.items()])
    out = df.select(F.col(ts).alias("timestamp"), F.explode(arr).alias("m"),
                    (tags if tags is not None else F.create_map().cast(TAG_TYPE)).alias("tags"))
    return out.select("timestamp", "m.metric_name", "m.value", "tags", F.lit(source).alias("source")) \
        .filter(F.col("value").isNotNull())


def prediction_metrics(preds: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Prediction log to metric rows; accuracy only where a label exists."""
    return to_metrics(preds, ts, {
        "prediction": F.col("prediction"),
        "prediction_probability": F.col("probability"),
        "response_time_ms": F.col("response_time_ms"),
        "prediction_accuracy": F.when(F.col("actual_label").isNotNull(),
                                      (F.col("prediction") == F.col("actual_label")).cast("double")),
    }, F.create_map(F.lit("model_version"), F.col("model_version")))


# M2 -------------------------------------------------------------------------
def rollup_windows(df: DataFrame, size: str, slide: str | None = None, keys: Sequence[str] = ("metric_name",),
                   ts: str = "timestamp", value: str = "value", exact: bool = True) -> DataFrame:
    """count/sum/min/max/mean/population std (and percentiles for tumbling
    windows) per window and key.  ``slide`` < ``size`` gives trailing windows
    refreshed every ``slide``."""
    keys = list(keys)
    src = df.withColumn(value, F.expr(f"try_cast(`{value}` AS double)")).filter(F.col(value).isNotNull())
    if slide is None or slide == size:
        w = F.window(ts, size)
        out = rollup_metrics(src.withColumns({"window_start": w.start, "window_end": w.end}),
                             ["window_start", "window_end", *keys], value, exact)
        return out.select("window_start", "window_end", *keys, "count", "sum", "min", "max", "mean", "std",
                          "p50", "p95", "p99")
    v = F.col(value)
    buckets = src.groupBy(F.window(ts, slide).alias("b"), *keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), bucket_part(v).alias("part"),
        F.min(v).alias("mn"), F.max(v).alias("mx"))
    # Each bucket lies in size/slide windows; window() on the bucket start enumerates them.
    win = buckets.select(F.window(F.col("b.start"), size, slide).alias("w"), *keys, "n", "s", "part", "mn", "mx")
    agg = win.groupBy("w", *keys).agg(F.sum("n").alias("count"), F.sum("s").alias("sum"),
                                      F.min("mn").alias("min"), F.max("mx").alias("max"),
                                      F.collect_list("part").alias("parts"))     # size / slide parts at most
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                      F.col("count").cast("long").alias("count"), "sum", "min", "max",
                      (F.col("sum") / F.col("count")).alias("mean"), merged_deviation(F.col("parts")).alias("std"))


# M4 -------------------------------------------------------------------------
def metric_values(df: DataFrame, name: str, since, tags: Mapping[str, str] | None = None,
                  ts: str = "timestamp") -> DataFrame:
    """Values of one metric after ``since`` (strict), optionally matching tags, newest first."""
    out = df.filter((F.col("metric_name") == name) & (F.col(ts) > F.lit(since).cast(df.schema[ts].dataType)))
    for k, v in (tags or {}).items():
        out = out.filter(F.col("tags")[k] == F.lit(v))
    return out.orderBy(F.col(ts).desc())


# M5 -------------------------------------------------------------------------
def aggregated_metrics(rollups: DataFrame, name: str, since, ts: str = "window_start") -> DataFrame:
    return (rollups.filter((F.col("metric_name") == name) &
                           (F.col(ts) > F.lit(since).cast(rollups.schema[ts].dataType)))
            .orderBy(F.col(ts).desc()))


# M6 -------------------------------------------------------------------------
def metrics_summary(df: DataFrame, since, ts: str = "timestamp") -> DataFrame:
    """Per metric after ``since``: count, mean, and the latest value (numeric only)."""
    src = df.withColumn("value", F.expr("try_cast(value AS double)")).filter(
        F.col("value").isNotNull() & (F.col(ts) > F.lit(since).cast(df.schema[ts].dataType)))
    return src.groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.max_by(F.col("value"), F.struct(F.col(ts), F.col("value"))).alias("latest_value"),
        F.max(ts).alias("latest_timestamp"))


# M7 -------------------------------------------------------------------------
def current_performance(preds: DataFrame, as_of, hours: int = 1, ts: str = "timestamp") -> DataFrame:
    """Performance over the trailing window from labelled rows (null when none), PR-AUC included."""
    t = F.lit(as_of).cast(preds.schema[ts].dataType)
    win = preds.filter((F.col(ts) > t - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col(ts) <= t))
    counts = win.agg(F.count(F.lit(1)).alias("n_predictions"),
                     F.count("actual_label").alias("n_labelled"),
                     F.avg("response_time_ms").alias("avg_response_time_ms"))
    labelled = win.filter(F.col("actual_label").isNotNull())
    m = classification_metrics(labelled, "actual_label", "prediction")
    has = F.col("n_labelled") > 0
    # One-row results combine through scalar subqueries, not a join.
    return counts.select(
        "n_predictions", "n_labelled", "avg_response_time_ms",
        *[F.when(has, m.select(c).scalar()).alias(n) for c, n in
          (("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))],
        roc_pr(labelled, "actual_label", "probability").select("pr_auc").scalar().alias("pr_auc"))


# M8 -------------------------------------------------------------------------
def performance_drift(current: DataFrame, baseline: Mapping[str, float] = C.BASELINE_METRICS,
                      thresholds: Mapping[str, float] = C.DECLINE_THRESHOLDS,
                      min_predictions: int = C.MIN_PREDICTIONS_FOR_DRIFT) -> DataFrame:
    """Metrics whose relative decline from baseline exceeds its cut (strict), with a level."""
    metrics = [m for m in thresholds if m in current.columns]
    long = current.select("n_predictions", *metrics).unpivot(["n_predictions"], metrics, "metric", "current_value")
    base = F.create_map(*[x for k, v in baseline.items() for x in (F.lit(k), F.lit(float(v)))])
    cut = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    out = long.withColumn("baseline_value", F.element_at(base, F.col("metric"))) \
        .withColumn("decline_percentage",
                    (F.col("baseline_value") - F.col("current_value")) / F.col("baseline_value"))
    out = out.filter(F.col("current_value").isNotNull() & (F.col("n_predictions") >= min_predictions) &
                     (F.col("decline_percentage") > F.element_at(cut, F.col("metric"))))
    return out.select("metric", "baseline_value", "current_value", "decline_percentage",
                      S.band("decline_percentage", C.DECLINE_LEVELS, C.DECLINE_LEVEL_DEFAULT).alias("alert_level"))


# M9 -------------------------------------------------------------------------
def performance_summary(preds: DataFrame, drift_alerts: DataFrame, since, ts: str = "timestamp") -> DataFrame:
    t = F.lit(since).cast(preds.schema[ts].dataType)
    p = preds.filter(F.col(ts) > t).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.avg("probability").alias("avg_probability"),
        F.count("actual_label").alias("n_labelled"),
        F.avg(F.when(F.col("actual_label").isNotNull(),
                     (F.col("prediction") == F.col("actual_label")).cast("double"))).alias("accuracy"))
    return p.withColumn("n_drift_alerts", drift_alerts.agg(F.count(F.lit(1))).scalar())


# M10 ------------------------------------------------------------------------
def drift_alerts(df: DataFrame, since, level: str | None = None, ts: str = "timestamp") -> DataFrame:
    out = df.filter(F.col(ts) > F.lit(since).cast(df.schema[ts].dataType))
    if level:
        out = out.filter(F.col("alert_level") == level)
    return out.orderBy(F.col(ts).desc())
