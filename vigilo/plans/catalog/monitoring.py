"""Registered queries: metric rollups and lookups, performance monitoring, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilo.operators import aggregates as A
from vigilo.operators import alerts as AL
from vigilo.operators import monitor as MO
from vigilo.plans.registry import register
from vigilo.presets import clinical as C
from vigilo.presets import driver as D
from vigilo.sources import tables as TB
from vigilo.sources.tables import table

SINCE = D.MONITOR_SINCE
AS_OF = D.MONITOR_AS_OF


def metric_rows(spark, sf):
    """Events as metric rows: name = event type, tags parsed from the props JSON."""
    ev = table(spark, sf, "events")
    return ev.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("metric_name"), "value",
                     MO.parse_tags(F.col("props")).alias("tags"), F.lit("events").alias("source"))


def predictions(spark, sf):
    return table(spark, sf, "events").select(
        F.col("ts").alias("timestamp"), (F.col("value") >= 100).cast("int").alias("prediction"),
        F.least(F.col("value") / 400.0, F.lit(1.0)).alias("probability"),
        F.expr("CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN NULL ELSE 0 END")
        .alias("actual_label"),
        F.col("value").alias("response_time_ms"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"))


# ---- M2 + A12 ---------------------------------------------------------------------
def rollup_hourly(spark, sf):
    return MO.rollup_windows(metric_rows(spark, sf), "1 hour")


register("metric_rollup_hourly", ops=("M2", "A12"), sql="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type AS metric_name, count(value) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max,
       avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
FROM events GROUP BY 1, 2, 3""")(rollup_hourly)


def rollup_sliding(spark, sf):
    return MO.rollup_windows(metric_rows(spark, sf), "1 hour", "15 minutes")


register("metric_rollup_sliding", ops=("M2",), sql="""
WITH b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, event_type, value FROM events),
w AS (SELECT b - k * INTERVAL 15 MINUTE AS window_start, event_type, value
      FROM b, (SELECT unnest(range(0, 4)) AS k))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type AS metric_name,
       count(value) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, avg(value) AS mean,
       stddev_pop(value) AS std
FROM w GROUP BY 1, 2, 3""")(rollup_sliding)


def rollup_by_tags(spark, sf):
    rows = metric_rows(spark, sf).withColumn("tags", MO.sorted_tags(F.col("tags")))
    return A.rollup_metrics(rows, ["metric_name", "tags"])


register("metric_rollup_tags", ops=("A12", "M1"), sql="""
SELECT event_type AS metric_name, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS tags,
       count(value) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, avg(value) AS mean,
       stddev_pop(value) AS std, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95,
       quantile_cont(value, 0.99) AS p99
FROM events GROUP BY 1, 2""")(rollup_by_tags)


# ---- M4 / M6 / A11 ------------------------------------------------------------------
def metric_lookup(spark, sf):
    out = MO.metric_values(metric_rows(spark, sf), "error", SINCE, {"k": "9"})
    return out.select("timestamp", "metric_name", "value")


register("metric_lookup", ops=("M4", "O3"), sql=f"""
SELECT ts AS timestamp, event_type AS metric_name, value FROM events
WHERE event_type = 'error' AND ts > TIMESTAMP '{SINCE}' AND json_extract_string(props, '$.k') = '9'""")(metric_lookup)


def metrics_summary_q(spark, sf):
    return MO.metrics_summary(metric_rows(spark, sf), SINCE)


register("metrics_summary", ops=("M6",), sql=f"""
SELECT event_type AS metric_name, count(*) AS count, avg(value) AS mean,
       arg_max(value, (ts, value)) AS latest_value, max(ts) AS latest_timestamp
FROM events WHERE value IS NOT NULL AND ts > TIMESTAMP '{SINCE}' GROUP BY 1""")(metrics_summary_q)


def metric_counts_q(spark, sf):
    return A.metric_counts(metric_rows(spark, sf), "timestamp", SINCE)


register("metric_counts", ops=("A11",), sql=f"""
SELECT event_type AS metric_name, count(*) AS count, avg(value) AS mean FROM events
WHERE ts > TIMESTAMP '{SINCE}' GROUP BY 1""")(metric_counts_q)


# ---- A10 / M7 / M8 / J12 --------------------------------------------------------------
def prediction_stats_q(spark, sf):
    return A.prediction_stats(predictions(spark, sf), "timestamp", SINCE)


register("prediction_stats", ops=("A10", "M9"), sql=f"""
WITH p AS ({D.PRED_SQL})
SELECT count(*) AS n_predictions, avg(probability) AS avg_probability,
       avg(CAST(prediction AS DOUBLE)) AS positive_rate, count(actual_label) AS n_labelled
FROM p WHERE timestamp > TIMESTAMP '{SINCE}'""")(prediction_stats_q)


def _current(spark, sf):
    return MO.current_performance(predictions(spark, sf), AS_OF, hours=24)


CURRENT_SQL = f"""p AS ({D.PRED_SQL}),
win AS (SELECT * FROM p WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
        AND timestamp <= TIMESTAMP '{AS_OF}'),
c AS (SELECT count(*) AS n_predictions, count(actual_label) AS n_labelled,
             avg(response_time_ms) AS avg_response_time_ms FROM win),
m AS (SELECT sum(CASE WHEN actual_label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN actual_label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN actual_label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn,
             sum(CASE WHEN actual_label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn
      FROM win WHERE actual_label IS NOT NULL),
r AS (SELECT CASE WHEN tp + fp + tn + fn <> 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END AS accuracy,
             CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM m),
sc AS (SELECT probability AS s, sum(CASE WHEN actual_label = 1 THEN 1 ELSE 0 END) AS pos, count(*) AS n
       FROM win WHERE actual_label IS NOT NULL AND probability IS NOT NULL GROUP BY 1),
sd AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM sc WINDOW w AS (ORDER BY s DESC)),
ap AS (SELECT CASE WHEN sum(pos) > 0 THEN sum(pos * tp / seen) / sum(pos) END AS pr_auc FROM sd),
cur AS (SELECT n_predictions, n_labelled, avg_response_time_ms,
               CASE WHEN n_labelled > 0 THEN accuracy END AS accuracy,
               CASE WHEN n_labelled > 0 THEN precision END AS precision,
               CASE WHEN n_labelled > 0 THEN recall END AS recall,
               CASE WHEN n_labelled > 0 THEN CASE WHEN precision + recall <> 0
                    THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END END AS f1_score, pr_auc
        FROM c, r, ap)"""


register("current_performance", ops=("M7", "A16"), sql=f"WITH {CURRENT_SQL} SELECT * FROM cur")(_current)


def performance_drift_q(spark, sf):
    return MO.performance_drift(_current(spark, sf))


def _perf_drift_sql() -> str:
    rows = ", ".join(f"('{m}', {C.BASELINE_METRICS[m]!r}, {t!r})" for m, t in C.DECLINE_THRESHOLDS.items())
    levels = " ".join(f"WHEN decline_percentage >= {cut} THEN '{lvl}'" for cut, lvl in C.DECLINE_LEVELS)
    return f"""WITH {CURRENT_SQL},
b AS (SELECT * FROM (VALUES {rows}) t(metric, baseline_value, cut)),
l AS (UNPIVOT (SELECT n_predictions, accuracy, precision, recall, f1_score, pr_auc FROM cur)
      ON accuracy, precision, recall, f1_score, pr_auc INTO NAME metric VALUE current_value),
j AS (SELECT l.metric, b.baseline_value, l.current_value, n_predictions, b.cut,
             (b.baseline_value - l.current_value) / b.baseline_value AS decline_percentage
      FROM l JOIN b USING (metric))
SELECT metric, baseline_value, current_value, decline_percentage,
       CASE {levels} ELSE '{C.DECLINE_LEVEL_DEFAULT}' END AS alert_level
FROM j WHERE current_value IS NOT NULL AND n_predictions >= {C.MIN_PREDICTIONS_FOR_DRIFT}
  AND decline_percentage > cut"""


register("performance_drift", ops=("M8", "J12", "P15"), sql=_perf_drift_sql())(performance_drift_q)


# ---- M11 / M12 / M13 / A13 ----------------------------------------------------------------
def signals(spark, sf, tenant=()):
    """Hourly error rate and mean value per event type, of all events or per tenant."""
    ev = table(spark, sf, "events").withColumn("hour", F.window("ts", "1 hour").start)
    err = ev.groupBy("hour", *tenant).agg((F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)) /
                                           F.count(F.lit(1))).alias("value")) \
        .select(*tenant, F.lit("model_error").alias("alert_type"), F.lit("error_rate").alias("metric"),
                F.lit("error_rate").alias("detail"), F.col("hour").alias("ts"), "value")
    drift = ev.groupBy("hour", "event_type", *tenant).agg((F.avg("value") / 400.0).alias("value")) \
        .select(*tenant, F.lit("data_drift").alias("alert_type"), F.col("event_type").alias("metric"),
                F.col("event_type").alias("detail"), F.col("hour").alias("ts"), "value")
    return err.unionByName(drift)


def _candidates(spark, sf, tenant=()):
    return AL.evaluate_rules(signals(spark, sf, tenant), AL.rules_table(spark), [*tenant, "alert_type", "detail", "ts"])


def alert_candidates(spark, sf):
    c = _candidates(spark, sf)
    return c.select("alert_type", "detail", "ts", "value", "severity",
                    F.array_join("channels", ",").alias("channels"), "cooldown_minutes",
                    F.array_join("matched_rules", ",").alias("matched_rules"))


def _rules_values() -> str:
    return ", ".join(
        f"('{n}', '{t}', {float(th)!r}, '{sev}', {sev_rank}, [{', '.join(repr(c) for c in ch)}], {cd})"
        for n, t, th, sev, ch, cd in C.DEFAULT_ALERT_RULES
        for sev_rank in [C.SEVERITY_ORDER.index(sev) + 1])


def signals_sql(tenant: str = "") -> str:
    return f"""sig AS (
  SELECT {tenant} 'model_error' AS alert_type, 'error_rate' AS metric, 'error_rate' AS detail,
         time_bucket(INTERVAL 1 HOUR, ts) AS ts,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*) AS value
  FROM events GROUP BY ALL
  UNION ALL
  SELECT {tenant} 'data_drift', event_type, event_type, time_bucket(INTERVAL 1 HOUR, ts), avg(value) / 400.0
  FROM events GROUP BY ALL)"""


SIGNALS_SQL = signals_sql()


def candidates_sql(tenant: str = "") -> str:
    """Candidates of the signals; ``tenant`` is empty or a column with a comma."""
    return f"""{signals_sql(tenant)},
rules AS (SELECT * FROM (VALUES {_rules_values()}) r(name, rtype, threshold, sev, sev_rank, channels, cooldown)),
hit AS (SELECT * FROM sig JOIN rules ON sig.alert_type = rules.rtype AND sig.value >= rules.threshold),
cand AS (SELECT {tenant} alert_type, detail, ts, any_value(metric) AS metric, any_value(value) AS value,
                {[s for s in C.SEVERITY_ORDER]}[max(sev_rank)] AS severity,
                array_to_string(list_sort(list_distinct(flatten(list(channels)))), ',') AS channels,
                max(cooldown) AS cooldown_minutes, array_to_string(list_sort(list(name)), ',') AS matched_rules
         FROM hit GROUP BY {tenant} alert_type, detail, ts)"""


CANDIDATES_SQL = candidates_sql()
TENANT = ["user_id"]     # the rate limit holds per user of the events
LONGEST_COOLDOWN = max(cooldown for *_, cooldown in C.DEFAULT_ALERT_RULES)

register("alert_candidates", ops=("M11",), sql=f"""
WITH {CANDIDATES_SQL}
SELECT alert_type, detail, ts, value, severity, channels, cooldown_minutes, matched_rules FROM cand""")(
    alert_candidates)


def _cooled(spark, sf):
    return AL.apply_cooldown(_candidates(spark, sf), ["alert_type", "metric"], "ts", ["detail"],
                             longest_cooldown=LONGEST_COOLDOWN)


def alert_cooldown(spark, sf):
    return _cooled(spark, sf).select("alert_type", "detail", "ts", "severity", "cooldown_minutes", "emitted")


COOLDOWN_SQL = f"""{CANDIDATES_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY alert_type, metric ORDER BY ts, detail) AS rn FROM cand),
r AS (
  SELECT alert_type, metric, rn, detail, ts, severity, cooldown_minutes, true AS emitted, ts AS last_sent
  FROM a WHERE rn = 1
  UNION ALL
  SELECT a.alert_type, a.metric, a.rn, a.detail, a.ts, a.severity, a.cooldown_minutes,
         NOT (r.last_sent > a.ts - to_minutes(a.cooldown_minutes)) AS emitted,
         CASE WHEN NOT (r.last_sent > a.ts - to_minutes(a.cooldown_minutes)) THEN a.ts ELSE r.last_sent END
  FROM r JOIN a ON a.alert_type = r.alert_type AND a.metric IS NOT DISTINCT FROM r.metric AND a.rn = r.rn + 1)"""

register("alert_cooldown", ops=("M12",), sql=f"""
WITH RECURSIVE {COOLDOWN_SQL}
SELECT alert_type, detail, ts, severity, cooldown_minutes, emitted FROM r""")(alert_cooldown)

RATE_LIMIT = 4  # per trailing hour for this query, so the limit is exercised on the driver's data


def alert_rate_limit(spark, sf):
    out = AL.apply_rate_limit(_candidates(spark, sf, TENANT), RATE_LIMIT, 60, tenant_cols=TENANT, ts="ts",
                              order=["alert_type", "detail"])
    return out.select("user_id", "alert_type", "detail", "ts", "severity", "emitted")


register("alert_rate_limit", ops=("M13",), sql=f"""
WITH RECURSIVE {candidates_sql("user_id,")},
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, alert_type, detail) AS rn FROM cand),
r AS (
  SELECT user_id, rn, alert_type, detail, ts, severity, true AS emitted, [ts] AS hist FROM a WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.rn, a.alert_type, a.detail, a.ts, a.severity,
         len(list_filter(r.hist, lambda x: x > a.ts - INTERVAL 1 HOUR)) < {RATE_LIMIT},
         CASE WHEN len(list_filter(r.hist, lambda x: x > a.ts - INTERVAL 1 HOUR)) < {RATE_LIMIT}
              THEN list_append(list_filter(r.hist, lambda x: x > a.ts - INTERVAL 1 HOUR), a.ts)
              ELSE list_filter(r.hist, lambda x: x > a.ts - INTERVAL 1 HOUR) END
  FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)
SELECT user_id, alert_type, detail, ts, severity, emitted FROM r""")(alert_rate_limit)


def alert_policy(spark, sf):
    out = AL.apply_alert_policy(_candidates(spark, sf, TENANT), ["alert_type", "metric"], RATE_LIMIT, 60,
                                tenant_cols=TENANT, ts="ts", order=["alert_type", "detail"],
                                longest_cooldown=LONGEST_COOLDOWN)
    return out.select("user_id", "alert_type", "detail", "ts", "severity", "emitted", "suppressed_by")


def policy_sql(cand_cte: str, order: str, limit: int, cols: str) -> str:
    """Coupled cooldown + rate limit as a recursive CTE over each user's
    candidates in ``order``: state is the send times of the trailing hour and the last send
    time per (alert_type, metric) key."""
    key = "coalesce(a.alert_type, '') || '|' || coalesce(a.metric, '')"
    recent = "list_filter(r.hist, lambda x: x > a.ts - INTERVAL 1 HOUR)"
    last = f"list_extract(list_transform(list_filter(r.lasts, lambda s: s.k = {key}), lambda s: s.t), 1)"
    cooled = f"coalesce({last} > a.ts - to_minutes(a.cooldown_minutes), false)"
    sent = f"(NOT {cooled} AND len({recent}) < {limit})"
    return f"""{cand_cte},
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn FROM cand),
r AS (
  SELECT rn, {cols}, true AS emitted, CAST(NULL AS VARCHAR) AS suppressed_by, [ts] AS hist,
         [{{'k': coalesce(alert_type, '') || '|' || coalesce(metric, ''), 't': ts}}] AS lasts
  FROM a WHERE rn = 1
  UNION ALL
  SELECT a.rn, {", ".join("a." + c.strip() for c in cols.split(","))}, {sent},
         CASE WHEN {cooled} THEN 'cooldown' WHEN len({recent}) >= {limit} THEN 'rate_limit' END,
         CASE WHEN {sent} THEN list_append({recent}, a.ts) ELSE {recent} END,
         CASE WHEN {sent} THEN list_append(list_filter(r.lasts, lambda s: s.k <> {key}),
                                           {{'k': {key}, 't': a.ts}})
              ELSE r.lasts END
  FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)"""


register("alert_policy", ops=("M12", "M13"), sql=f"""
WITH RECURSIVE {policy_sql(candidates_sql("user_id,"), "ts, alert_type, detail", RATE_LIMIT,
                           "user_id, alert_type, metric, detail, ts, severity, cooldown_minutes")}
SELECT user_id, alert_type, detail, ts, severity, emitted, suppressed_by FROM r""")(alert_policy)


def alert_statistics_q(spark, sf):
    sent = _cooled(spark, sf).filter("emitted")
    return A.alert_statistics(sent, C.SEVERITY_ORDER)


register("alert_statistics", ops=("A13", "M15"), sql=f"""
WITH RECURSIVE {COOLDOWN_SQL}
SELECT count(*) AS total,
       {", ".join(f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS severity_{s}"
                  for s in C.SEVERITY_ORDER)},
       count(DISTINCT alert_type) AS n_types
FROM r WHERE emitted""")(alert_statistics_q)


# ---- S8 ----------------------------------------------------------------------------------
def retention_q(spark, sf):
    return TB.retention_report(table(spark, sf, "events"), "ts", days=14, as_of=AS_OF)


register("retention_report", ops=("S8",), sql=f"""
SELECT count(*) AS rows_before,
       CAST(sum(CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY THEN 1 ELSE 0 END) AS BIGINT) AS rows_removed
FROM events""")(retention_q)


# ---- M1 + S7 + S8: append-only metric store, date-partitioned, retention with pruning ----------
def metric_store(spark, sf):
    import uuid
    from vigilo.session import scratch_dir
    path = scratch_dir(spark, f"metric-store-{uuid.uuid4().hex[:8]}")
    TB.append_table(MO.prediction_metrics(predictions(spark, sf)), path, "timestamp", "dt")   # S7
    stored = spark.read.parquet(path)
    kept = TB.apply_retention(stored, "timestamp", days=14, as_of=AS_OF, date_col="dt")       # S8
    return kept.groupBy("metric_name").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                           F.min("dt").cast("timestamp_ntz").alias("first_day"))


register("metric_store", ops=("M1", "S7", "S8"), sql=f"""
WITH p AS ({D.PRED_SQL}),
m AS (
  SELECT timestamp, 'prediction' AS metric_name, CAST(prediction AS DOUBLE) AS value FROM p
  UNION ALL SELECT timestamp, 'prediction_probability', probability FROM p
  UNION ALL SELECT timestamp, 'response_time_ms', response_time_ms FROM p
  UNION ALL SELECT timestamp, 'prediction_accuracy', CAST(prediction = actual_label AS DOUBLE) FROM p
            WHERE actual_label IS NOT NULL)
SELECT metric_name, count(*) AS count, avg(value) AS mean,
       CAST(min(CAST(timestamp AS DATE)) AS TIMESTAMP) AS first_day
FROM m WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1""")(metric_store)


def retention_delete(spark, sf):
    """Metrics appended by day, two weeks kept: what was there, what was deleted and what a reader finds, by day."""
    import uuid
    from vigilo.session import scratch_dir
    path = scratch_dir(spark, f"metric-store-{uuid.uuid4().hex[:8]}")
    TB.append_table(MO.prediction_metrics(predictions(spark, sf)), path, "timestamp", "dt")
    before = spark.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("rows_before")).checkpoint()
    report = TB.delete_expired(spark, path, "timestamp", days=14, as_of=AS_OF).select("dt", "rows_removed")
    left = spark.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("rows_left"))
    return before.join(report, "dt", "left").join(left, "dt", "left").select(
        F.col("dt").cast("timestamp_ntz").alias("day"), "rows_before", F.coalesce("rows_removed", F.lit(0)).alias("rows_removed"),
        F.coalesce("rows_left", F.lit(0)).alias("rows_left"))


register("retention_delete", ops=("S8", "S7"), sql=f"""
WITH p AS ({D.PRED_SQL}),
m AS (SELECT timestamp FROM p WHERE prediction IS NOT NULL UNION ALL SELECT timestamp FROM p WHERE probability IS NOT NULL
      UNION ALL SELECT timestamp FROM p WHERE response_time_ms IS NOT NULL
      UNION ALL SELECT timestamp FROM p WHERE actual_label IS NOT NULL AND prediction IS NOT NULL),
k AS (SELECT CAST(CAST(timestamp AS DATE) AS TIMESTAMP) AS day, timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS old FROM m)
SELECT day, count(*) AS rows_before, count(*) FILTER (old) AS rows_removed, count(*) FILTER (NOT old) AS rows_left
FROM k GROUP BY 1""")(retention_delete)
