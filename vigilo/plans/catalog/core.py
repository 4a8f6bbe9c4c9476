"""Registered queries: cleaning, joins, look-back features on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilo.functions import scalar as S
from vigilo.operators import aggregates as A
from vigilo.operators import joins as J
from vigilo.operators import windows as W
from vigilo.plans import cleaning as CL
from vigilo.plans.registry import register
from vigilo.presets import driver as D
from vigilo.session import scratch_dir
from vigilo.sources.tables import table

TS_AS_OF = f"TIMESTAMP '{D.AS_OF}'"


def _events(spark, sf):
    return table(spark, sf, "events")


def raw_patients(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"),
        F.expr(D.CUSTOMER_BIRTH_YEAR).alias("birth_year"),
        F.expr(D.CUSTOMER_GENDER).alias("gender"),
        F.col("c_mktsegment").alias("segment"))


RAW_PATIENTS_SQL = f"""
SELECT c_custkey AS patient_id, {D.CUSTOMER_BIRTH_YEAR} AS birth_year,
       {D.CUSTOMER_GENDER} AS gender, c_mktsegment AS segment FROM customer"""


def raw_physicians(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("physician_id"),
        F.expr(D.SUPPLIER_STATE).alias("state"),
        F.expr(D.SUPPLIER_TYPE).alias("physician_type"),
        F.expr(D.SUPPLIER_BIRTH_YEAR).alias("birth_year"))


RAW_PHYSICIANS_SQL = f"""
SELECT s_suppkey AS physician_id, {D.SUPPLIER_STATE} AS state, {D.SUPPLIER_TYPE} AS physician_type,
       {D.SUPPLIER_BIRTH_YEAR} AS birth_year FROM supplier"""


def raw_transactions(spark, sf):
    return _events(spark, sf).select(
        F.expr(D.EVENT_DT_TEXT).alias("txn_dt"),
        F.col("user_id").alias("patient_id"),
        F.expr(D.EVENT_PROVIDER).alias("physician_id"),
        F.col("event_type").alias("txn_type"),
        F.expr(D.EVENT_DESC).alias("txn_desc"),
        F.col("value"))


RAW_TXN_SQL = f"""
SELECT {D.EVENT_DT_TEXT} AS txn_dt, user_id AS patient_id, {D.EVENT_PROVIDER} AS physician_id,
       event_type AS txn_type, {D.EVENT_DESC} AS txn_desc, value FROM events"""

WS = D.WS_SQL


def _blank_sql(c: str, default: str = "Unknown") -> str:
    t = f"trim({c}, {WS})"
    return f"CASE WHEN {c} IS NULL OR {t} IN ('', 'nan', 'None', 'NaN') THEN '{default}' ELSE {t} END"


def _gender_sql(c: str) -> str:
    return (f"CASE {_blank_sql(c)} WHEN 'M' THEN 'M' WHEN 'm' THEN 'M' WHEN 'Male' THEN 'M' "
            f"WHEN 'male' THEN 'M' WHEN 'F' THEN 'F' WHEN 'f' THEN 'F' WHEN 'Female' THEN 'F' "
            f"WHEN 'female' THEN 'F' WHEN 'Unknown' THEN 'Unknown' ELSE 'Unknown' END")


# --- 7.2 slice: W1 + J5 + A1 + J7 ------------------------------------------
def index_lookback(spark, sf):
    ev = _events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    idx = (W.index_event(ev.select("user_id", "ts", "event_id"), "user_id", "ts",
                         pred=ev.event_type == D.INDEX_TYPE, tie=["event_id"])
           .select("user_id", F.col("ts").alias("index_ts")))
    errors = ev.filter(F.col("event_type") == "error").select("user_id", "ts")
    hits = J.lookback_within(errors, idx, "user_id", "ts", "index_ts", 5)
    counts = A.count_by(hits, "user_id", "n_errors_5d")
    return J.left_fill(idx, counts, "user_id", {"n_errors_5d": 0})


register("index_lookback", ops=("W1", "J5", "A1", "J7"), sql="""
WITH idx AS (
  SELECT user_id, min(ts) AS index_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id),
hits AS (
  SELECT i.user_id, count(*) AS n FROM idx i JOIN events e
    ON e.user_id = i.user_id AND e.event_type = 'error'
   AND e.ts >= i.index_ts - INTERVAL 5 DAY AND e.ts <= i.index_ts
  GROUP BY i.user_id)
SELECT i.user_id, i.index_ts, coalesce(h.n, 0) AS n_errors_5d
FROM idx i LEFT JOIN hits h USING (user_id)""")(index_lookback)


# --- F1 ----------------------------------------------------------------------
def clean_patients_q(spark, sf):
    return CL.clean_patients(raw_patients(spark, sf), D.AS_OF, order=("birth_year", "gender", "segment"))


register("clean_patients", ops=("F1", "P1", "P2", "P4", "W3", "P7", "O1"), sql=f"""
WITH r AS ({RAW_PATIENTS_SQL}),
c AS (
  SELECT patient_id,
         CAST(CASE WHEN birth_year BETWEEN 1900 AND {D.AS_OF_YEAR} THEN birth_year ELSE -1 END AS INT) AS birth_year,
         {_gender_sql('gender')} AS gender, segment
  FROM r),
d AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY birth_year, gender, segment) AS rn FROM c)
SELECT patient_id, birth_year, gender, segment FROM d WHERE rn = 1 AND patient_id > 0""")(clean_patients_q)


# --- F2 ----------------------------------------------------------------------
def clean_physicians_q(spark, sf):
    return CL.clean_physicians(raw_physicians(spark, sf))


register("clean_physicians", ops=("F2", "P1", "P3", "P4", "W3", "P7"), sql=f"""
WITH r AS ({RAW_PHYSICIANS_SQL})
SELECT physician_id,
       upper({_blank_sql('state')}) AS state,
       -- title case: every test value is letters and single spaces
       array_to_string(list_transform(string_split({_blank_sql('physician_type')}, ' '),
           lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS physician_type,
       CAST(CASE WHEN birth_year BETWEEN 1930 AND 2005 THEN birth_year ELSE -1 END AS DOUBLE) AS birth_year
FROM r WHERE physician_id > 0""")(clean_physicians_q)


# --- F3 ----------------------------------------------------------------------
def clean_transactions_q(spark, sf):
    return CL.clean_transactions(raw_transactions(spark, sf), D.AS_OF) \
        .withColumn("txn_dt", F.col("txn_dt").cast("timestamp_ntz"))


_CLEAN_TXN_SQL = f"""r AS ({RAW_TXN_SQL}),
c AS (
  SELECT CASE WHEN TRY_CAST(txn_dt AS TIMESTAMP) > {TS_AS_OF} THEN {TS_AS_OF}
              ELSE TRY_CAST(txn_dt AS TIMESTAMP) END AS txn_dt,
         patient_id, CAST(coalesce(physician_id, -1) AS BIGINT) AS physician_id,
         upper({_blank_sql('txn_type')}) AS txn_type,
         upper({_blank_sql('txn_desc')}) AS txn_desc, value
  FROM r),
cleaned AS (SELECT DISTINCT * FROM c WHERE patient_id > 0 AND (physician_id > 0 OR physician_id = -1))"""

register("clean_transactions", ops=("F3", "P5", "P6", "P1", "P3", "P7", "W3", "O1"),
         sql=f"WITH {_CLEAN_TXN_SQL} SELECT * FROM cleaned")(clean_transactions_q)


# --- Q9 ----------------------------------------------------------------------
def cleaning_report(spark, sf):
    """Counts of the pass that writes the cleaned facts, and the rows that a reader of the written table finds."""
    path = scratch_dir(spark, f"cleaned-{uuid.uuid4().hex[:8]}")
    report = CL.write_cleaned(raw_transactions(spark, sf), D.AS_OF, path)
    return report.withColumn("read_rows", spark.read.parquet(path).agg(F.count(F.lit(1))).scalar())


register("cleaning_report", ops=("Q9", "S5"), sql=f"""
WITH {_CLEAN_TXN_SQL}
SELECT count(*) AS initial_rows,
  CAST(sum(CASE WHEN txn_dt IS NOT NULL AND TRY_CAST(txn_dt AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS invalid_dates,
  CAST(sum(CASE WHEN TRY_CAST(txn_dt AS TIMESTAMP) > {TS_AS_OF} THEN 1 ELSE 0 END) AS BIGINT) AS future_dates,
  CAST(sum(CASE WHEN physician_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled_physician_ids,
  CAST(sum(CASE WHEN patient_id IS NULL OR patient_id <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_patient_ids,
  CAST(sum(CASE WHEN coalesce(physician_id, -1) = -1 OR coalesce(physician_id, -1) > 0 THEN 0 ELSE 1 END) AS BIGINT)
    AS invalid_physician_ids,
  (SELECT count(*) FROM cleaned) AS final_rows, (SELECT count(*) FROM cleaned) AS read_rows
FROM r""")(cleaning_report)


# --- J2 ----------------------------------------------------------------------
def referential_filter(spark, sf):
    txn = raw_transactions(spark, sf).withColumn("physician_id", S.fill_cast("physician_id", -1))
    phys = table(spark, sf, "supplier")
    kept = J.keep_referenced(txn, phys, "physician_id", dim_key="s_suppkey", allow=[-1])
    return kept.groupBy("physician_id").agg(F.count(F.lit(1)).alias("n_rows"))


register("referential_filter", ops=("J2", "P6"), sql=f"""
WITH r AS ({RAW_TXN_SQL}),
t AS (SELECT CAST(coalesce(physician_id, -1) AS BIGINT) AS physician_id FROM r)
SELECT physician_id, count(*) AS n_rows FROM t
WHERE physician_id = -1 OR physician_id IN (SELECT s_suppkey FROM supplier)
GROUP BY physician_id""")(referential_filter)


# --- J3 ----------------------------------------------------------------------
def orphan_keys_q(spark, sf):
    txn = raw_transactions(spark, sf)
    return J.orphan_keys(txn, table(spark, sf, "supplier"), "physician_id", dim_key="s_suppkey",
                         exclude=[-1]).withColumnRenamed("physician_id", "orphan_physician_id")


register("orphan_keys", ops=("J3", "X1"), sql=f"""
WITH r AS ({RAW_TXN_SQL})
SELECT DISTINCT physician_id AS orphan_physician_id FROM r
WHERE physician_id IS NOT NULL AND physician_id <> -1
  AND physician_id NOT IN (SELECT s_suppkey FROM supplier)""")(orphan_keys_q)


# --- Q10 ---------------------------------------------------------------------
def integrity_report(spark, sf):
    txn = CL.clean_transactions(raw_transactions(spark, sf), D.AS_OF, sort=False)
    pats = CL.clean_patients(raw_patients(spark, sf), D.AS_OF, order=("birth_year", "gender", "segment"),
                             sort=False)
    phys = CL.clean_physicians(raw_physicians(spark, sf), sort=False)
    orphan_pat = J.orphan_keys(txn, pats, "patient_id", exclude=[]).agg(F.count(F.lit(1)).alias("n"))
    orphan_phys = J.orphan_keys(txn, phys, "physician_id", exclude=[-1]).agg(F.count(F.lit(1)).alias("n"))
    kept = J.keep_referenced(J.keep_referenced(txn, pats, "patient_id"), phys, "physician_id", allow=[-1])
    young = (J.enrich(kept.select("txn_dt", "physician_id"),
                      phys.select("physician_id", F.col("birth_year").alias("phys_birth_year")), "physician_id")
             .withColumn("age", S.age_at("txn_dt", "phys_birth_year")))
    stats = young.agg(F.count(F.lit(1)).alias("rows_after"),
                      F.sum(F.when(F.col("age") < 25, 1).otherwise(0)).cast("long").alias("young_physician_rows"))
    before = txn.agg(F.count(F.lit(1)).alias("rows_before"))
    return before.select(
        "rows_before", orphan_pat.scalar().alias("orphan_patient_keys"),
        orphan_phys.scalar().alias("orphan_physician_keys"),
        stats.select("rows_after").scalar().alias("rows_after"),
        stats.select("young_physician_rows").scalar().alias("young_physician_rows"))


register("integrity_report", ops=("Q10", "J1", "J2", "J3", "P9"), sql=f"""
WITH r AS ({RAW_TXN_SQL}),
c AS (
  SELECT CASE WHEN TRY_CAST(txn_dt AS TIMESTAMP) > {TS_AS_OF} THEN {TS_AS_OF}
              ELSE TRY_CAST(txn_dt AS TIMESTAMP) END AS txn_dt,
         patient_id, CAST(coalesce(physician_id, -1) AS BIGINT) AS physician_id,
         upper({_blank_sql('txn_type')}) AS txn_type, upper({_blank_sql('txn_desc')}) AS txn_desc, value
  FROM r),
txn AS (SELECT DISTINCT * FROM c WHERE patient_id > 0 AND (physician_id > 0 OR physician_id = -1)),
pats AS (SELECT c_custkey AS patient_id FROM customer WHERE c_custkey > 0),
phys AS (SELECT s_suppkey AS physician_id,
                CASE WHEN {D.SUPPLIER_BIRTH_YEAR} BETWEEN 1930 AND 2005 THEN {D.SUPPLIER_BIRTH_YEAR} ELSE -1 END AS by
         FROM supplier WHERE s_suppkey > 0),
kept AS (SELECT t.* FROM txn t WHERE t.patient_id IN (SELECT patient_id FROM pats)
           AND (t.physician_id = -1 OR t.physician_id IN (SELECT physician_id FROM phys)))
SELECT (SELECT count(*) FROM txn) AS rows_before,
       (SELECT count(DISTINCT patient_id) FROM txn WHERE patient_id NOT IN (SELECT patient_id FROM pats))
         AS orphan_patient_keys,
       (SELECT count(DISTINCT physician_id) FROM txn WHERE physician_id <> -1
          AND physician_id NOT IN (SELECT physician_id FROM phys)) AS orphan_physician_keys,
       (SELECT count(*) FROM kept) AS rows_after,
       (SELECT CAST(coalesce(sum(CASE WHEN p.by > 0 AND year(k.txn_dt) - p.by < 25 THEN 1 ELSE 0 END), 0) AS BIGINT)
          FROM kept k LEFT JOIN phys p USING (physician_id)) AS young_physician_rows""")(integrity_report)


# --- W2 ----------------------------------------------------------------------
def latest_event_q(spark, sf):
    ev = _events(spark, sf).select("user_id", "ts", "event_id", "event_type", "value")
    return W.latest_event(ev, "user_id", "ts", tie=["event_id"]) \
        .select("user_id", F.col("ts").alias("last_ts"), F.col("event_type").alias("last_type"),
                F.col("value").alias("last_value"))


register("latest_event", ops=("W2",), sql="""
SELECT user_id, ts AS last_ts, event_type AS last_type, value AS last_value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")(latest_event_q)


# --- J6 + P12 + P13 ------------------------------------------------------------
def asof_symptom(spark, sf):
    ev = _events(spark, sf)
    idx = W.index_event(ev.select("user_id", "ts", "event_id"), "user_id", "ts",
                        pred=ev.event_type == D.INDEX_TYPE, tie=["event_id"]) \
        .select("user_id", F.col("ts").alias("index_ts"))
    sym = ev.filter(F.col("event_type").isin(*D.SYMPTOM_TYPES)).select("user_id", "ts")
    last = J.asof_latest(sym, idx, "user_id", "ts", "index_ts", prefix="symptom_")
    diff = S.day_diff("index_ts", "symptom_ts")
    return last.select("user_id", "index_ts", F.col("symptom_ts"),
                       diff.alias("symptom_to_index_days"),
                       S.within_days(diff, 5).alias("within_5_days"))


register("asof_symptom", ops=("J6", "J4", "P12", "P13"), sql="""
WITH idx AS (SELECT user_id, min(ts) AS index_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id),
last AS (SELECT i.user_id, max(e.ts) AS symptom_ts FROM idx i JOIN events e
           ON e.user_id = i.user_id AND e.event_type IN ('error', 'click') AND e.ts <= i.index_ts
         GROUP BY i.user_id)
SELECT i.user_id, i.index_ts, l.symptom_ts,
       CAST(floor((epoch_us(i.index_ts) - epoch_us(l.symptom_ts)) / 86400000000.0) AS BIGINT)
         AS symptom_to_index_days,
       CAST(coalesce(floor((epoch_us(i.index_ts) - epoch_us(l.symptom_ts)) / 86400000000.0), 0) <= 5 AS INT)
         AS within_5_days
FROM idx i LEFT JOIN last l USING (user_id)""")(asof_symptom)
