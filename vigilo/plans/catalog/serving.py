"""Registered queries: records and forms, keyword matching, file round trips,
lookups, ordering, alert life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilo.functions import scalar as S
from vigilo.operators import alerts as AL
from vigilo.operators import monitor as MO
from vigilo.operators import ordering as O
from vigilo.operators import windows as W
from vigilo.plans import features as FE
from vigilo.plans.catalog.core import RAW_PATIENTS_SQL, raw_patients
from vigilo.plans.catalog.features import FC, PATS_SQL, clean_dims, clinical_fact
from vigilo.plans.catalog.monitoring import (COOLDOWN_SQL, SINCE, _cooled, metric_rows, predictions,
                                             performance_drift_q)
from vigilo.plans.registry import register
from vigilo.presets import clinical as C
from vigilo.presets import driver as D
from vigilo.session import scratch_dir
from vigilo.sources import tables as TB
from vigilo.sources.tables import table

# --- fixed values: keyword groups and names for the part catalogue ------------
PART_GROUPS = {
    "size": ["small", "large", "tiny", "big", "mini"],
    "color": ["red", "blue", "green", "black", "white", "yellow"],
    "hardware": ["bolt", "gear", "ring", "nut", "screw", "spring"],
}
PART_NAMES = ["widget", "gizmo", "bolt", "gear", "ring"]
# --- end fixed values -----------------------------------------------------------


# ---- P17 / P18 ------------------------------------------------------------------------
def part_keyword_groups(spark, sf):
    p = table(spark, sf, "part")
    g = S.match_keyword_groups(F.col("p_name"), PART_GROUPS)
    return p.select("p_partkey", F.array_join(g, ",").alias("groups"), F.size(g).alias("n_groups"))


def _groups_sql() -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(p_name, '(?i)({'|'.join(words)})') THEN '{name}' END"
        for name, words in PART_GROUPS.items()) + "], lambda x: x IS NOT NULL)"


register("part_keyword_groups", ops=("P17",), sql=f"""
SELECT p_partkey, array_to_string({_groups_sql()}, ',') AS groups, CAST(len({_groups_sql()}) AS INT) AS n_groups
FROM part""")(part_keyword_groups)


def part_category(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.map_exact_or_contains("p_name", PART_NAMES).alias("category"))


register("part_category", ops=("P18",), sql=f"""
SELECT p_partkey, CASE WHEN p_name IN ({", ".join(f"'{n}'" for n in PART_NAMES)}) THEN p_name
  {" ".join(f"WHEN contains(p_name, '{n}') THEN '{n}'" for n in PART_NAMES)} END AS category
FROM part""")(part_category)


# ---- F10 + J9 + P23 + A21 + W2 -----------------------------------------------------------
COHORT_AS_OF = "2024-01-31 00:00:00"


def recent_cohort_q(spark, sf):
    pats, _ = clean_dims(spark, sf)
    pats = pats.select("patient_id", F.when(F.col("birth_year") > 0, F.col("birth_year")).alias("birth_year"))
    rec = FE.recent_cohort(clinical_fact(spark, sf), pats, COHORT_AS_OF, fc=FC)
    return rec.select("patient_id", "age", "n_events", F.array_join("comorbidities", ",").alias("comorbidities"),
                      F.array_join("symptoms", ",").alias("symptoms"), "last_transaction_dt",
                      "risk_score", "risk_level", "has_alert")


def _recent_sql() -> str:
    hi = ", ".join(f"'{x}'" for x in C.RECORD_HIGH_RISK_CONDITIONS)
    sev = ", ".join(f"'{x}'" for x in C.RECORD_SEVERE_SYMPTOMS)
    return f"""
WITH fact AS ({D.FACT_SQL}),
pats AS (SELECT patient_id, CASE WHEN birth_year > 0 THEN birth_year END AS birth_year FROM ({PATS_SQL})),
named AS (SELECT * FROM fact WHERE regexp_matches(upper(txn_desc), '{"|".join(C.COHORT_KEYWORDS)}')),
rdx AS (SELECT DISTINCT patient_id FROM named WHERE true
          AND txn_dt >= TIMESTAMP '{COHORT_AS_OF}' - INTERVAL {C.RECENT_DAYS} DAY AND txn_dt <= TIMESTAMP '{COHORT_AS_OF}'),
ids AS (SELECT * FROM rdx UNION SELECT DISTINCT patient_id FROM named WHERE NOT EXISTS (SELECT 1 FROM rdx)),
ev AS (SELECT f.patient_id, txn_dt, txn_type, CASE WHEN txn_desc <> 'DISEASE_X' THEN txn_desc END AS d
       FROM fact f WHERE patient_id IN (SELECT patient_id FROM ids)),
per AS (SELECT patient_id, count(*) AS n_events,
          list_sort(list(DISTINCT d) FILTER (WHERE txn_type = 'CONDITIONS' AND d IS NOT NULL)) AS co,
          list_sort(list(DISTINCT d) FILTER (WHERE txn_type = 'SYMPTOMS' AND d IS NOT NULL)) AS sy,
          max(txn_dt) AS last_transaction_dt FROM ev GROUP BY 1),
r AS (SELECT p.patient_id, CAST({COHORT_AS_OF[:4]} - p.birth_year AS INT) AS age, per.n_events,
             coalesce(co, []) AS co, coalesce(sy, []) AS sy, last_transaction_dt
      FROM pats p JOIN per USING (patient_id)),
s AS (SELECT *, CASE WHEN age >= 65 THEN 3 WHEN age >= 45 THEN 2 ELSE 1 END + least(len(co), 3) + least(len(sy), 2)
                  AS risk_score FROM r)
SELECT patient_id, age, n_events, array_to_string(co, ',') AS comorbidities, array_to_string(sy, ',') AS symptoms,
       last_transaction_dt, CAST(risk_score AS INT) AS risk_score,
       CASE WHEN risk_score >= 6 THEN 'High Risk' WHEN risk_score >= 4 THEN 'Medium Risk' ELSE 'Low Risk' END
         AS risk_level,
       coalesce(age >= 65, false)
         AND (coalesce(list_has_any(co, [{hi}]), false) OR coalesce(list_has_any(sy, [{sev}]), false))
         AS has_alert
FROM s"""


register("recent_cohort", ops=("F10", "J9", "P23", "A21", "W2"), sql=_recent_sql())(recent_cohort_q)


# ---- F11 --------------------------------------------------------------------------------
def visit_attributes_q(spark, sf):
    fact = clinical_fact(spark, sf).withColumn("visit_type", F.col("txn_type"))
    return FE.visit_attributes(fact, FC, ["physician_id", "visit_type"])


register("visit_attributes", ops=("F11",), sql=f"""
WITH fact AS ({D.FACT_SQL}),
f AS (SELECT patient_id, arg_min({{'t': txn_dt, 'p': physician_id, 'v': txn_type}}, (txn_dt, physician_id, txn_type)) AS r
      FROM fact GROUP BY 1),
i AS (SELECT patient_id, arg_min({{'t': txn_dt, 'p': physician_id, 'v': txn_type}}, (txn_dt, physician_id, txn_type)) AS r
      FROM fact WHERE txn_desc = 'DISEASE_X' GROUP BY 1)
SELECT f.patient_id, coalesce(i.r, f.r).t AS visit_dt, coalesce(i.r, f.r).p AS physician_id,
       coalesce(i.r, f.r).v AS visit_type
FROM f LEFT JOIN i USING (patient_id)""")(visit_attributes_q)


# ---- P25 --------------------------------------------------------------------------------
def row_validation(spark, sf):
    p = raw_patients(spark, sf)
    age = F.lit(D.AS_OF_YEAR) - F.col("birth_year")
    errs = S.validate_rows([
        (F.col("birth_year").isNull(), "birth year missing"),
        ((age < 0) | (age > 120), "age outside 0..120"),
        (~S.strip("gender").isin("M", "F", "Male", "Female", "male", "female", "m", "f"), "gender not recognised"),
    ])
    return p.select("patient_id", F.array_join(errs, "; ").alias("errors")).filter(F.col("errors") != "")


register("row_validation", ops=("P25",), sql=f"""
WITH p AS ({RAW_PATIENTS_SQL}),
e AS (SELECT patient_id, list_filter([
        CASE WHEN birth_year IS NULL THEN 'birth year missing' END,
        CASE WHEN {D.AS_OF_YEAR} - birth_year < 0 OR {D.AS_OF_YEAR} - birth_year > 120 THEN 'age outside 0..120' END,
        CASE WHEN NOT trim(gender, {D.WS_SQL}) IN ('M', 'F', 'Male', 'Female', 'male', 'female', 'm', 'f')
             THEN 'gender not recognised' END], lambda x: x IS NOT NULL) AS l FROM p)
SELECT patient_id, array_to_string(l, '; ') AS errors FROM e WHERE len(l) > 0""")(row_validation)


# ---- S1 / S2 / S5: CSV sink and schema-explicit read back --------------------------------
ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                 "o_orderdate string, o_orderpriority string")


def csv_roundtrip(spark, sf):
    import uuid
    path = scratch_dir(spark, f"csv-orders-{uuid.uuid4().hex[:8]}")
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    TB.write_table(orders, path, "csv", "overwrite", partition_by=["o_orderstatus"])
    # Explicit schema (no inference pass); the partition column comes from the folder names.
    back = TB.read_csv(spark, path, ORDERS_SCHEMA, ts_cols=["o_orderdate"])
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min("o_orderdate").cast("timestamp_ntz").alias("first_order"))


register("csv_roundtrip", ops=("S1", "S2", "S5"), sql="""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_order
FROM orders GROUP BY 1""")(csv_roundtrip)


# ---- S6 / S3 / S4 / P27: documents written, read back and exploded --------------------
def conversation_documents(spark, sf):
    import uuid
    conv = table(spark, sf, "conversations")
    docs = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("transactions"))
    path = scratch_dir(spark, f"docs-{uuid.uuid4().hex[:8]}")
    TB.write_documents(docs, path, {"data_source": "conversations"})
    back = spark.read.schema("conv_id bigint, transactions array<struct<turn: bigint, role: string, text: string>>").json(
        path + "/records")
    rows = TB.explode_requests(back, "conv_id", "transactions")
    meta_total = spark.read.schema("total bigint, data_source string").json(path + "/metadata").select("total")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"),
                                    F.sum(F.length("text")).alias("n_chars"),
                                    F.count_distinct("conv_id").alias("n_documents")) \
        .withColumn("documents_total", meta_total.scalar())


register("conversation_documents", ops=("S4", "S6"), sql="""
SELECT role, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT conv_id) AS n_documents,
       (SELECT count(DISTINCT conv_id) FROM conversations) AS documents_total
FROM conversations GROUP BY role""")(conversation_documents)


# ---- W7 ---------------------------------------------------------------------------------
def purchase_gaps(spark, sf):
    ev = table(spark, sf, "events").filter(F.col("event_type") == "purchase").select("user_id", "ts")
    g = W.gaps(ev, "ts", "user_id")
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_purchases"), F.avg("gap_days").alias("avg_gap_days"))


register("purchase_gaps", ops=("W7",), sql="""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events
           WHERE event_type = 'purchase')
SELECT user_id, count(*) AS n_purchases,
       avg(CAST(floor((epoch_us(ts) - epoch_us(prev)) / 86400000000.0) AS BIGINT)) AS avg_gap_days
FROM e GROUP BY 1""")(purchase_gaps)


# ---- O2 / O3 / O4 / O6 -----------------------------------------------------------------------
def top_customers(spark, sf):
    rev = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return O.top_k(rev, "revenue", 10, tie=["o_custkey"])


register("top_customers", ops=("O2",), sql="""
SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1
ORDER BY revenue DESC, o_custkey LIMIT 10""")(top_customers)


def recent_events(spark, sf):
    return O.recent(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), "ts", 10,
                    tie=["event_id"])


register("recent_events", ops=("O3",), sql="""
SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""")(recent_events)


def order_lookup(spark, sf):
    return O.lookup(table(spark, sf, "orders"), "o_orderkey", 7)


register("order_lookup", ops=("O6",), sql="SELECT * FROM orders WHERE o_orderkey = 7")(order_lookup)


def worklist(spark, sf):
    """O4 + P26: eligibility with a score; each patient gets an action, the
    list is sorted eligible first, then alerts, then name."""
    from vigilo.plans.catalog.features import _eligibility
    e = _eligibility(spark, sf)
    fact = clinical_fact(spark, sf)
    exp = FE.provider_experience(fact, FC, FE.Preset())
    idx = FE.index_rows(fact, FC, FE.Preset()).select("patient_id", "physician_id")
    scored = (e.join(idx, ["patient_id"], "left").join(exp, ["physician_id"], "left")
              .withColumn("probability", F.coalesce(F.lit(1.0) - F.col("phys_treat_rate_all"), F.lit(0.5)))
              .withColumn("prediction", (F.col("probability") >= 0.5).cast("int")))
    d = FE.decide_alerts(scored).withColumn("action", S.recommend_action("alert_recommended", "meets_criteria",
                                                                         "prediction"))
    d = d.withColumn("name", F.concat(F.lit("Patient "), F.col("patient_id").cast("string")))
    out = O.worklist_sort(d, "meets_criteria", "alert_recommended", "name")
    return out.select("patient_id", "meets_criteria", "alert_recommended",
                      F.col("action.priority").alias("priority"), F.col("action.title").alias("title"))


def _worklist_sql() -> str:
    from vigilo.plans.catalog.features import EXP_SQL, _eligibility_sql
    return f"""
WITH e AS ({_eligibility_sql()}),
fact AS ({D.FACT_SQL}), {EXP_SQL.strip()},
idx AS (SELECT patient_id, physician_id FROM (
          SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY txn_dt, event_id) AS rn
          FROM fact WHERE txn_desc = 'DISEASE_X') WHERE rn = 1),
s AS (SELECT e.patient_id, e.meets_criteria, coalesce(1.0 - x.phys_treat_rate_all, 0.5) AS probability
      FROM e LEFT JOIN idx USING (patient_id) LEFT JOIN exp x ON idx.physician_id = x.physician_id),
d AS (SELECT *, probability >= 0.5 AS pred1,
             probability >= 0.5 AND probability >= {C.ALERT_PROBABILITY_CUTOFF} AND coalesce(meets_criteria, false)
               AS alert_recommended FROM s)
SELECT patient_id, meets_criteria, alert_recommended,
       CASE WHEN alert_recommended AND meets_criteria THEN 'high' WHEN pred1 AND NOT alert_recommended THEN 'medium'
            ELSE 'low' END AS priority,
       CASE WHEN alert_recommended AND meets_criteria THEN 'Consider Drug A Prescription'
            WHEN pred1 AND NOT alert_recommended THEN 'Clinical Review Recommended' ELSE 'Continue Current Treatment' END AS title
FROM d"""


register("worklist", ops=("O4", "P26", "L24"), sql=_worklist_sql())(worklist)


# ---- M5 / M9 / M10 / M14 -----------------------------------------------------------------------
def rollup_lookup(spark, sf):
    return MO.aggregated_metrics(MO.rollup_windows(metric_rows(spark, sf), "1 hour"), "error", SINCE) \
        .select("window_start", "metric_name", "count", "mean")


register("rollup_lookup", ops=("M5",), sql=f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS metric_name, count(value) AS count,
       avg(value) AS mean
FROM events WHERE event_type = 'error' GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, ts) > TIMESTAMP '{SINCE}'""")(rollup_lookup)


def performance_summary_q(spark, sf):
    alerts = performance_drift_q(spark, sf)
    return MO.performance_summary(predictions(spark, sf), alerts, SINCE)


def _performance_summary_sql() -> str:
    from vigilo.plans.catalog.monitoring import _perf_drift_sql
    return f"""
WITH p AS ({D.PRED_SQL})
SELECT count(*) AS n_predictions, avg(probability) AS avg_probability, count(actual_label) AS n_labelled,
       avg(CASE WHEN actual_label IS NOT NULL THEN CAST(prediction = actual_label AS DOUBLE) END) AS accuracy,
       (SELECT count(*) FROM ({_perf_drift_sql()})) AS n_drift_alerts
FROM p WHERE timestamp > TIMESTAMP '{SINCE}'"""


register("performance_summary", ops=("M9", "M10", "A10"), sql=_performance_summary_sql())(performance_summary_q)


def alert_lifecycle(spark, sf):
    sent = _cooled(spark, sf).filter("emitted").withColumn(
        "alert_id", F.concat_ws(":", "alert_type", "detail", F.col("ts").cast("string")))
    # Actions derived from the alerts: high and critical alerts are acknowledged
    # after 10 minutes; model-error alerts are resolved after an hour.
    ack = sent.filter(F.col("severity").isin("high", "critical")).select(
        "alert_id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"), F.lit("acknowledge").alias("action"))
    res = sent.filter(F.col("alert_type") == "model_error").select(
        "alert_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit("resolve").alias("action"))
    state = AL.alert_state(sent, ack.unionByName(res), "alert_id", "ts")
    return state.groupBy("alert_type", "status").agg(F.count(F.lit(1)).alias("n"))


register("alert_lifecycle", ops=("M14", "W2"), sql=f"""
WITH RECURSIVE {COOLDOWN_SQL},
s AS (SELECT * FROM r WHERE emitted)
SELECT alert_type, CASE WHEN alert_type = 'model_error' THEN 'resolved'
                        WHEN severity IN ('high', 'critical') THEN 'acknowledged' ELSE 'active' END AS status,
       count(*) AS n
FROM s GROUP BY 1, 2""")(alert_lifecycle)


# ---- O5 -----------------------------------------------------------------------------------
def cohort_sample(spark, sf):
    """A limited cohort (the limit is the feature): the 50 lowest patient ids of
    the recent cohort, after an explicit sort."""
    return O.limit_cohort(recent_cohort_q(spark, sf).select("patient_id", "risk_score", "risk_level"), 50,
                          ["patient_id"])


register("cohort_sample", ops=("O5", "O1"), sql=f"""
WITH c AS ({_recent_sql()})
SELECT patient_id, risk_score, risk_level FROM c ORDER BY patient_id LIMIT 50""")(cohort_sample)
