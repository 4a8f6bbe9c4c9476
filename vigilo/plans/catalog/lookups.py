"""Registered queries: keyed flags and labels, key sets, logs and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilo.operators import aggregates as A
from vigilo.operators import alerts as AL
from vigilo.operators import evaluation as EV
from vigilo.operators import joins as J
from vigilo.operators import monitor as MO
from vigilo.operators import ordering as O
from vigilo.functions import scalar as S
from vigilo.plans import features as FE
from vigilo.plans.catalog.features import clinical_fact
from vigilo.plans.catalog.evaluation import MINIMA, MODEL_SQL, model_comparison
from vigilo.plans.catalog.monitoring import COOLDOWN_SQL, SINCE, SIGNALS_SQL, _cooled, signals
from vigilo.plans.registry import register
from vigilo.presets import clinical as C
from vigilo.presets import driver as D
from vigilo.sources.tables import table

STATES = ["ny", "CA", "N1", "TEX", "wa"]
REQUEST_AS_OF = "2024-01-30 12:00:00"

# ---- A2 / A3 / A4 / A5: one row per customer --------------------------------------------
PRIORITY_GROUPS = {"urgent": ["1-URGENT"], "high": ["2-HIGH"], "other": ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
LARGE_ORDER = 150000.0


def customer_flags(spark, sf):
    o = table(spark, sf, "orders").withColumn("large", F.col("o_totalprice") > LARGE_ORDER)
    c = table(spark, sf, "customer").select("c_custkey")
    o = o.withColumnRenamed("o_custkey", "c_custkey")
    out = J.left_fill(c, A.flags_by(o, "c_custkey", "o_orderpriority", PRIORITY_GROUPS), "c_custkey",
                      {k: 0 for k in PRIORITY_GROUPS})
    level = A.max_level_by(o.withColumn("level", F.length("o_orderstatus")), "c_custkey", "level")
    out = J.left_fill(out, level, "c_custkey", {"max_level": 0})
    out = J.left_fill(out, A.rate_by(o, "c_custkey", "large", "large_rate"), "c_custkey", {"large_rate": 0.0})
    return A.label_ever(out, o, "c_custkey", F.col("large"), "never_large")


register("customer_flags", ops=("A2", "A3", "A4", "A5", "J7"), sql=f"""
WITH o AS (SELECT o_custkey AS c_custkey, {", ".join(
    f"max(CASE WHEN o_orderpriority IN ({', '.join(repr(x) for x in v)}) THEN 1 ELSE 0 END) AS {k}"
    for k, v in PRIORITY_GROUPS.items())},
  max(length(o_orderstatus)) AS max_level, avg(CASE WHEN o_totalprice > {LARGE_ORDER} THEN 1.0 ELSE 0.0 END) AS large_rate,
  max(CASE WHEN o_totalprice > {LARGE_ORDER} THEN 1 ELSE 0 END) AS ever FROM orders GROUP BY 1)
SELECT c.c_custkey, {", ".join(f"coalesce({k}, 0)::INTEGER AS {k}" for k in PRIORITY_GROUPS)},
       coalesce(max_level, 0)::INTEGER AS max_level, coalesce(large_rate, 0.0) AS large_rate,
       (1 - coalesce(ever, 0))::INTEGER AS never_large
FROM customer c LEFT JOIN o USING (c_custkey)""")(customer_flags)


# ---- J8: supplier-part pairs that were ever returned ------------------------------------
def returned_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    pairs = li.select("l_suppkey", "l_partkey")
    flagged = J.join_flag(pairs, li.filter(F.col("l_returnflag") == "R"), ["l_suppkey", "l_partkey"], "returned")
    return flagged.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("returned").alias("returned"))


register("returned_pairs", ops=("J8",), sql="""
WITH p AS (SELECT l_suppkey, l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS pairs, sum(r)::BIGINT AS returned FROM p GROUP BY 1""")(returned_pairs)


# ---- J11 / J12: two periods ---------------------------------------------------------------
CUT = "1997-01-01 00:00:00"


def _halves(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut)


def priority_counts(spark, sf):
    a, b = _halves(spark, sf)
    return J.contingency(a, b, "o_orderpriority", ["o_orderstatus"])


register("priority_counts", ops=("J11",), sql=f"""
SELECT o_orderstatus, o_orderpriority, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{CUT}') AS ref_count,
       count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{CUT}') AS new_count
FROM orders GROUP BY 1, 2""")(priority_counts)

METRICS = ["mean_price", "urgent_share"]


def baseline_comparison(spark, sf):
    a, b = (x.agg(F.avg("o_totalprice").alias("mean_price"),
                  F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_share"))
            for x in _halves(spark, sf))
    return J.compare_to_baseline(b, a, METRICS)


register("baseline_comparison", ops=("J12",), sql=f"""
WITH h AS (SELECT o_orderdate >= TIMESTAMP '{CUT}' AS new, avg(o_totalprice) AS mean_price,
                  avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS urgent_share FROM orders GROUP BY 1),
l AS (UNPIVOT h ON mean_price, urgent_share INTO NAME metric VALUE v)
SELECT n.metric, n.v AS current_value, o.v AS baseline_value,
       CASE WHEN o.v <> 0 THEN (o.v - n.v) / o.v ELSE 0.0 END AS decline
FROM l n JOIN l o USING (metric) WHERE n.new AND NOT o.new""")(baseline_comparison)


# ---- X1 / X2 / X3: key sets -----------------------------------------------------------------
def key_sets(spark, sf):
    a, b = _halves(spark, sf)
    lost = O.key_except(a, b, "o_custkey").agg(F.count(F.lit(1)).alias("n_lost")).select(F.lit("lost").alias("kind"), "n_lost")
    return O.union_results(lost, O.coverage(a, b, "o_custkey").withColumn("kind", F.lit("coverage")))


register("key_sets", ops=("X1", "X2", "X3"), sql=f"""
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'),
b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}')
SELECT 'lost' AS kind, (SELECT count(*) FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)) AS n_lost,
       NULL::BIGINT AS n_test_values, NULL::BIGINT AS n_seen, NULL::DOUBLE AS coverage
UNION ALL
SELECT 'coverage', NULL, count(*), count(*) FILTER (WHERE o_custkey IN (SELECT o_custkey FROM a)),
       count(*) FILTER (WHERE o_custkey IN (SELECT o_custkey FROM a)) / count(*) FROM b""")(key_sets)


# ---- M10: hourly error rates as drift alerts, looked up by age and level --------------------
def drift_alert_log(spark, sf):
    s = signals(spark, sf).filter(F.col("alert_type") == "model_error").select(
        "ts", "value", F.when(F.col("value") >= 0.3, "critical").when(F.col("value") >= 0.2, "high")
        .otherwise("medium").alias("alert_level"))
    return MO.drift_alerts(s, SINCE, "critical", "ts")


register("drift_alert_log", ops=("M10",), sql=f"""
WITH {SIGNALS_SQL}
SELECT ts, value, 'critical' AS alert_level FROM sig
WHERE alert_type = 'model_error' AND value >= 0.3 AND ts > TIMESTAMP '{SINCE}'""")(drift_alert_log)


# ---- M15: sent alerts since a point in time --------------------------------------------------
def alert_history_log(spark, sf):
    sent = _cooled(spark, sf).filter("emitted").select("alert_type", "metric", "detail", "ts", "severity")
    return AL.alert_history(sent, SINCE)


register("alert_history_log", ops=("M15",), sql=f"""
WITH RECURSIVE {COOLDOWN_SQL}
SELECT alert_type, metric, detail, ts, severity FROM r WHERE emitted AND ts > TIMESTAMP '{SINCE}'""")(alert_history_log)


# ---- M17: the rule table after an upsert and a removal, with the signals each rule matches ----
STRICT = ("model_error_strict", "model_error", 0.4, "critical", ["email"], 5)


def rule_matches(spark, sf):
    gone = C.DEFAULT_ALERT_RULES[0][0]
    rules = AL.remove_rule(AL.upsert_rules(AL.rules_table(spark), AL.rules_table(spark, [STRICT])), gone)
    hit = signals(spark, sf).join(F.broadcast(rules.select("name", F.col("alert_type").alias("_t"), "threshold")),
                                  (F.col("alert_type") == F.col("_t")) & (F.col("value") >= F.col("threshold")))
    return J.left_fill(rules.select("name", "severity"), hit.groupBy("name").agg(F.count(F.lit(1)).alias("matches")),
                       "name", {"matches": 0})


def _rule_matches_sql() -> str:
    rules = [r for r in C.DEFAULT_ALERT_RULES[1:] if r[0] != STRICT[0]] + [STRICT]
    rows = ", ".join(f"('{n}', '{t}', {float(th)!r}, '{sev}')" for n, t, th, sev, _, _ in rules)
    return f"""
WITH {SIGNALS_SQL}, rules AS (SELECT * FROM (VALUES {rows}) r(name, rtype, threshold, severity))
SELECT name, any_value(severity) AS severity, count(sig.value) AS matches
FROM rules LEFT JOIN sig ON sig.alert_type = rtype AND sig.value >= threshold GROUP BY name"""


register("rule_matches", ops=("M17", "M11"), sql=_rule_matches_sql())(rule_matches)


# ---- L28: the recorded choice ------------------------------------------------------------------
DECIDED = "2025-10-17 00:00:00"


def selection_log(spark, sf):
    return EV.selection_record(model_comparison(spark, sf), "model", MINIMA, DECIDED)


register("selection_log", ops=("L28",), sql=f"""
WITH {MODEL_SQL},
p AS (SELECT * FROM rk WHERE pr_auc >= 0.8 AND roc_auc >= 0.5 AND recall >= 0.3 AND precision >= 0.8),
choice AS (SELECT count(*) AS n_qualified, arg_min(model, (-composite_score, model)) AS selected_model,
             max(composite_score) AS selected_score FROM p)
SELECT n_qualified, selected_model, selected_score, {", ".join("rk." + m for m in C.RANKING_WEIGHTS)},
       (SELECT count(*) FROM rk) AS n_models, '{",".join(f"{k}>={v}" for k, v in MINIMA.items())}' AS minima,
       '{",".join(f"{k}*{v}" for k, v in C.RANKING_WEIGHTS.items())}' AS criteria, TIMESTAMP '{DECIDED}' AS decided_at
FROM choice LEFT JOIN rk ON model = selected_model""")(selection_log)


# ---- S3 / S6 / P27 / P23: patient documents in both layouts, as events and as form risks ------
DOCUMENT_ROWS = 500      # patients of one document
PATIENT = "id: bigint, age: int, diagnosisDate: string, comorbidities: array<string>, symptoms: array<string>"
DOCUMENT = f"patients array<struct<{PATIENT}>>, doctor_input_patients array<struct<{PATIENT}>>"


def patient_documents_frame(spark, sf):
    """Documents written as JSON (every second one in the legacy layout) and read back."""
    import uuid
    from vigilo.session import scratch_dir
    from vigilo.sources import tables as TB
    fact = clinical_fact(spark, sf)
    named = lambda kind: F.array_sort(F.collect_set(F.when(
        (F.col("txn_type") == kind) & (F.col("txn_desc") != C.INDEX_CODE), F.col("txn_desc"))))
    per = fact.groupBy(F.col("patient_id").alias("id")).agg(
        (F.lit(20) + F.max("patient_id") % 70).cast("int").alias("age"),
        F.date_format(F.min("txn_dt"), "yyyy-MM-dd").alias("diagnosisDate"),
        named("CONDITIONS").alias("comorbidities"), named("SYMPTOMS").alias("symptoms"))
    docs = per.withColumn("_doc", F.floor(F.col("id") / DOCUMENT_ROWS)).groupBy("_doc").agg(
        F.collect_list(F.struct("id", "age", "diagnosisDate", "comorbidities", "symptoms")).alias("p"))
    legacy = F.col("_doc") % 2 == 1
    path = scratch_dir(spark, f"patients-{uuid.uuid4().hex[:8]}")
    (docs.select(F.when(~legacy, F.col("p")).alias("patients"), F.when(legacy, F.col("p")).alias("doctor_input_patients"))
     .write.option("maxRecordsPerFile", 1).json(path))
    return TB.read_documents(spark, path, DOCUMENT)


PER_SQL = f"""per AS (SELECT patient_id AS id, (20 + patient_id % 70)::INTEGER AS age, min(txn_dt)::DATE AS d,
  coalesce(list(DISTINCT txn_desc) FILTER (WHERE txn_type = 'CONDITIONS' AND txn_desc <> '{C.INDEX_CODE}'), []) AS co,
  coalesce(list(DISTINCT txn_desc) FILTER (WHERE txn_type = 'SYMPTOMS' AND txn_desc <> '{C.INDEX_CODE}'), []) AS sy
  FROM ({D.FACT_SQL}) GROUP BY 1, 2)"""


def patient_documents(spark, sf):
    events = FE.documents_to_events(patient_documents_frame(spark, sf))
    return events.groupBy("txn_type", "txn_desc").agg(
        F.count(F.lit(1)).alias("n"), F.min("txn_dt").cast("timestamp_ntz").alias("first_dt"))


register("patient_documents", ops=("S3", "S6", "P27"), sql=f"""
WITH {PER_SQL},
e AS (SELECT 'CONDITIONS' AS txn_type, unnest(co) AS txn_desc, d FROM per
      UNION ALL SELECT 'SYMPTOMS', unnest(sy), d FROM per
      UNION ALL SELECT 'CONDITIONS', '{C.INDEX_CODE}', d FROM per WHERE len(co) = 0)
SELECT txn_type, txn_desc, count(*) AS n, min(d)::TIMESTAMP AS first_dt FROM e GROUP BY 1, 2""")(patient_documents)


def form_risks(spark, sf):
    docs = patient_documents_frame(spark, sf).withColumn(
        "contraindicationLevel", F.element_at(F.array(*[F.lit(x) for x in C.FORM_CONTRA_MULTIPLIER]),
                                              (F.col("id") % 3 + 1).cast("int")))
    return FE.form_risk(docs).select("id", "risk_score", "risk_level", "has_alert")


register("form_risks", ops=("P23", "S3"), sql=f"""
WITH {PER_SQL},
s AS (SELECT id, age, len(co) AS n_co, (2 * len(co) + len(sy) + CASE WHEN age >= 65 THEN 3 WHEN age >= 50 THEN 1 ELSE 0 END)
             * ([{", ".join(str(x) for x in C.FORM_CONTRA_MULTIPLIER.values())}])[id % 3 + 1] AS risk_score FROM per)
SELECT id, risk_score::DOUBLE AS risk_score, CASE {" ".join(f"WHEN risk_score >= {a} THEN '{b}'" for a, b in C.FORM_RISK_LEVELS)}
         ELSE 'Low Risk' END AS risk_level,
       risk_score >= {C.FORM_ALERT_SCORE} OR (age >= 65 AND n_co >= 2) AS has_alert
FROM s""")(form_risks)


# ---- P25 in full: checks of a request before it is scored ---------------------------------------
def request_validation(spark, sf):
    fact = clinical_fact(spark, sf)
    as_of = F.lit(REQUEST_AS_OF).cast("timestamp_ntz")
    per = fact.groupBy("patient_id").agg(
        F.max((F.col("txn_type") == "CONDITIONS").cast("int")).alias("has_condition"),
        F.max("txn_dt").alias("last_dt"), F.min("txn_dt").alias("first_dt"))
    state = F.element_at(F.array(*[F.lit(x) for x in STATES]), (F.col("patient_id") % len(STATES) + 1).cast("int"))
    age = (F.col("patient_id") % 130).cast("int")
    days = S.day_diff("last_dt", "first_dt")
    errors = S.validate_rows([
        (F.col("has_condition") == 0, "At least one CONDITIONS transaction is required"),
        (F.col("last_dt") > as_of, "Diagnosis date cannot be in the future"),
        ((age < 0) | (age > 120), "Patient age must be between 0 and 120"),
        ((days < 0) | (days > 30), "Symptom to diagnosis days must be between 0 and 30"),
        (~state.rlike("^[A-Za-z]{2}$"), "Physician state must be a 2-letter code")])
    return per.select("patient_id", F.array_join(errors, "; ").alias("errors"))


register("request_validation", ops=("P25",), sql=f"""
WITH per AS (SELECT patient_id, max(CASE WHEN txn_type = 'CONDITIONS' THEN 1 ELSE 0 END) AS c, max(txn_dt) AS l,
                    min(txn_dt) AS f FROM ({D.FACT_SQL}) GROUP BY 1),
v AS (SELECT *, floor((epoch_us(l) - epoch_us(f)) / 86400000000.0) AS days,
             ([{", ".join(repr(x) for x in STATES)}])[patient_id % {len(STATES)} + 1] AS state FROM per)
SELECT patient_id, concat_ws('; ',
  CASE WHEN c = 0 THEN 'At least one CONDITIONS transaction is required' END,
  CASE WHEN l > TIMESTAMP '{REQUEST_AS_OF}' THEN 'Diagnosis date cannot be in the future' END,
  CASE WHEN patient_id % 130 > 120 THEN 'Patient age must be between 0 and 120' END,
  CASE WHEN days < 0 OR days > 30 THEN 'Symptom to diagnosis days must be between 0 and 30' END,
  CASE WHEN NOT regexp_full_match(state, '[A-Za-z]{{2}}') THEN 'Physician state must be a 2-letter code' END) AS errors
FROM v""")(request_validation)
