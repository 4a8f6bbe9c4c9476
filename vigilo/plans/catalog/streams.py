"""Registered queries that run a Structured Streaming job over a driver table.

Each replays the table through a file stream source with ``availableNow``
(all data, then stop), appends every micro-batch to a table in the shared folder
and returns that table.  Checkpoints go below the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilo.operators import alerts as AL
from vigilo.plans.registry import register
from vigilo.session import scratch_dir
from vigilo.streaming.alerts import alert_stream
from vigilo.streaming.merged import read_merged, start_merge
from vigilo.streaming.rollup import rollup_stream, start_append


def _replay(sdf, prefix: str):
    """Run the stream over all data and return what its sink table holds."""
    spark = sdf.sparkSession
    name = f"{prefix}-{uuid.uuid4().hex[:8]}"
    path = scratch_dir(spark, "table-" + name)
    q = start_append(sdf, path, scratch_dir(spark, "stream-" + name), available_now=True)
    q.awaitTermination()
    # Written by one micro-batch at least; a stream without rows leaves an empty table.
    return spark.read.schema(sdf.schema).option("recursiveFileLookup", "true").parquet(path)


def _event_stream(spark, sf):
    """The events table as a stream: a folder of files, or one file.

    The source takes a plain path for a folder's name only; a pattern that
    matches just this name works for both.
    """
    folder = sf.rstrip("/")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


ROLLUP_KEYS = ["window_start", "window_end", "metric_name"]


def metric_rollup_stream(spark, sf):
    """All windows of the replayed events, the last ones too: update output merged by window and metric."""
    ev = _event_stream(spark, sf).select(F.col("ts").alias("timestamp"),
                                         F.col("event_type").alias("metric_name"), "value")
    agg = rollup_stream(ev, "1 hour", watermark="1 hour")
    name = f"rollup-{uuid.uuid4().hex[:8]}"
    path = scratch_dir(spark, "table-" + name)
    start_merge(agg, path, scratch_dir(spark, "stream-" + name), ROLLUP_KEYS, available_now=True).awaitTermination()
    out = read_merged(spark, path, ROLLUP_KEYS, agg.schema)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# percentile_approx gives values that occur, as quantile_disc does.
register("metric_rollup_stream", ops=("M3", "S7"), sql="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type AS metric_name, count(value) AS count, sum(value) AS sum, min(value) AS min,
       max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, quantile_disc(value, 0.5) AS p50,
       quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3""")(metric_rollup_stream)


def alert_stream_replay(spark, sf):
    """Every error event is a model-error signal (value scaled to a rate-like
    score); the stateful policy decides, per user, which alerts are sent."""
    from vigilo.plans.catalog.monitoring import RATE_LIMIT
    ev = _event_stream(spark, sf).filter(F.col("event_type") == "error")
    sig = ev.select("user_id", F.lit("model_error").alias("alert_type"), F.lit(None).cast("string").alias("metric"),
                    F.col("event_id").alias("detail"), F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("value") / 400.0).alias("value"))
    out = alert_stream(sig, AL.rules_table(spark), ts="ts", order=["detail"], tenant_cols=["user_id"],
                       max_alerts=RATE_LIMIT)
    res = _replay(out, "alerts")
    return res.select("user_id", "detail", F.col("ts").cast("timestamp_ntz").alias("ts"), "severity", "emitted",
                      "suppressed_by")


def _alert_stream_sql() -> str:
    from vigilo.plans.catalog.monitoring import RATE_LIMIT, policy_sql
    from vigilo.presets import clinical as C
    (_, _, th, sev, _, cd), = [r for r in C.DEFAULT_ALERT_RULES if r[1] == "model_error"]
    cand = f"""cand AS (SELECT user_id, 'model_error' AS alert_type, CAST(NULL AS VARCHAR) AS metric, event_id AS detail, ts,
                        '{sev}' AS severity, {cd} AS cooldown_minutes
                 FROM events WHERE event_type = 'error' AND value / 400.0 >= {th})"""
    return f"""WITH RECURSIVE {policy_sql(cand, "ts, detail", RATE_LIMIT,
                                       "user_id, alert_type, metric, detail, ts, severity, cooldown_minutes")}
SELECT user_id, detail, ts, severity, emitted, suppressed_by FROM r"""


register("alert_stream", ops=("M16",), sql=_alert_stream_sql())(alert_stream_replay)
