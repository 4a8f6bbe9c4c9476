"""Registered queries: model-ready features, provider experience, eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilo.plans import cleaning as CL
from vigilo.plans import features as FE
from vigilo.plans.catalog.core import (RAW_PATIENTS_SQL, RAW_PHYSICIANS_SQL, _blank_sql, _gender_sql,
                                       raw_patients, raw_physicians)
from vigilo.plans.registry import register
from vigilo.presets import clinical as C
from vigilo.presets import driver as D
from vigilo.sources.tables import table

FC = FE.FactColumns(tie=("event_id",))


def clinical_fact(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("txn_dt"), F.col("user_id").alias("patient_id"),
        F.expr(D.FACT_PHYSICIAN).alias("physician_id"), F.expr(D.FACT_TYPE).alias("txn_type"),
        F.expr(D.FACT_DESC).alias("txn_desc"))


def clean_dims(spark, sf):
    pats = CL.clean_patients(raw_patients(spark, sf), D.AS_OF, order=("birth_year", "gender", "segment"),
                             sort=False)
    phys = CL.clean_physicians(raw_physicians(spark, sf), sort=False)
    return pats, phys


PATS_SQL = f"""SELECT patient_id,
  CAST(CASE WHEN birth_year BETWEEN 1900 AND {D.AS_OF_YEAR} THEN birth_year ELSE -1 END AS INT) AS birth_year,
  {_gender_sql('gender')} AS gender FROM ({RAW_PATIENTS_SQL}) WHERE patient_id > 0"""
PHYS_SQL = f"""SELECT physician_id, upper({_blank_sql('state')}) AS state,
  array_to_string(list_transform(string_split({_blank_sql('physician_type')}, ' '),
     lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS physician_type
  FROM ({RAW_PHYSICIANS_SQL}) WHERE physician_id > 0"""


def _level_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in C.CONTRAINDICATION_LEVELS.items()) + \
        " ELSE 0 END"


EXP_SQL = """
dx AS (SELECT CASE WHEN physician_id = -1 THEN NULL ELSE physician_id END AS physician_id, patient_id
       FROM fact WHERE txn_desc = 'DISEASE_X'),
tot AS (SELECT physician_id, count(*) AS phys_total_dx FROM dx WHERE physician_id IS NOT NULL GROUP BY 1),
tr AS (SELECT DISTINCT patient_id FROM fact WHERE txn_type = 'TREATMENTS' AND txn_desc = 'DRUG A'),
rate AS (SELECT d.physician_id, avg(CASE WHEN tr.patient_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS phys_treat_rate_all
         FROM (SELECT DISTINCT * FROM dx WHERE physician_id IS NOT NULL) d LEFT JOIN tr USING (patient_id) GROUP BY 1),
exp AS (SELECT physician_id, phys_total_dx, CAST(phys_treat_rate_all AS DOUBLE) AS phys_treat_rate_all,
               CASE WHEN phys_total_dx >= 200 THEN 'High' WHEN phys_total_dx >= 20 THEN 'Medium' ELSE 'Low' END
                 AS phys_experience_level
        FROM tot JOIN rate USING (physician_id))"""


# ---- F7 -----------------------------------------------------------------------
def provider_experience_q(spark, sf):
    return FE.provider_experience(clinical_fact(spark, sf), FC, FE.Preset())


register("provider_experience", ops=("F7", "P22", "A1", "J8", "A4", "P15"), sql=f"""
WITH fact AS ({D.FACT_SQL}), {EXP_SQL}
SELECT * FROM exp""")(provider_experience_q)


# ---- F4 (with F5, F6, F7, W1, J1, J4, J5, J6, J7, A1-A5, P9-P16, P20) ------------
def model_ready_features(spark, sf):
    pats, phys = clean_dims(spark, sf)
    out = FE.build_features(clinical_fact(spark, sf), pats, phys, FC, FE.Preset())
    return out.withColumn("symptom_onset_dt", F.col("symptom_onset_dt").cast("timestamp_ntz"))


def _features_sql() -> str:
    sym_flags = ",\n   ".join(
        f"max(CASE WHEN txn_type = 'SYMPTOMS' AND txn_dt <= diseasex_dt AND txn_desc = '{s}' THEN 1 ELSE 0 END)"
        f" AS sym_{s.lower()}" for s in C.SYMPTOMS)
    risk_flags = ",\n   ".join(
        "max(CASE WHEN txn_type = 'CONDITIONS' AND txn_dt <= diseasex_dt AND txn_desc IN ("
        + ", ".join(f"'{n}'" for n in names) + f") THEN 1 ELSE 0 END) AS {g.lower()}"
        for g, names in C.RISK_GROUPS.items())
    sym_cols = ", ".join(f"sym_{s.lower()}" for s in C.SYMPTOMS)
    return f"""
WITH fact AS ({D.FACT_SQL}),
pats AS ({PATS_SQL}),
phys AS ({PHYS_SQL}),
idx AS (SELECT patient_id, txn_dt AS diseasex_dt, physician_id FROM (
          SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY txn_dt, event_id) AS rn
          FROM fact WHERE txn_desc = 'DISEASE_X') WHERE rn = 1),
b0 AS (SELECT i.*, CASE WHEN coalesce(p.birth_year, -1) > 0 THEN CAST(year(i.diseasex_dt) - p.birth_year AS INT) END
                     AS patient_age,
              coalesce(p.gender, 'UNKNOWN') AS patient_gender
       FROM idx i LEFT JOIN pats p USING (patient_id)),
b1 AS (SELECT b0.*, coalesce(ph.state, 'UNKNOWN') AS physician_state,
              coalesce(ph.physician_type, 'UNKNOWN') AS physician_type
       FROM b0 LEFT JOIN phys ph USING (physician_id) WHERE patient_age >= 12),
h AS (SELECT f.patient_id,
   max(CASE WHEN txn_type = 'SYMPTOMS' AND txn_dt <= diseasex_dt THEN txn_dt END) AS symptom_onset_dt,
   CAST(sum(CASE WHEN txn_type = 'SYMPTOMS' AND txn_dt <= diseasex_dt
                  AND txn_dt >= diseasex_dt - INTERVAL 5 DAY THEN 1 ELSE 0 END) AS INT) AS sym_count_5d,
   {sym_flags},
   {risk_flags},
   CAST(coalesce(max(CASE WHEN txn_type = 'CONTRAINDICATIONS' AND txn_dt <= diseasex_dt
                     THEN {_level_sql('txn_desc')} END), 0) AS INT) AS prior_contra_lvl,
   max(CASE WHEN txn_type = 'TREATMENTS' AND txn_desc = 'DRUG A' THEN 1 ELSE 0 END) AS has_treat
  FROM fact f JOIN b1 USING (patient_id) GROUP BY 1),
{EXP_SQL.strip()},
j AS (SELECT b1.*, h.* EXCLUDE (patient_id),
             greatest(CAST(floor((epoch_us(diseasex_dt) - epoch_us(symptom_onset_dt)) / 86400000000.0) AS BIGINT), 0)
               AS days
      FROM b1 LEFT JOIN h USING (patient_id))
SELECT j.patient_id, j.physician_id, diseasex_dt, patient_age, patient_gender, physician_state, physician_type,
       symptom_onset_dt, sym_count_5d, {sym_cols},
       risk_immuno, risk_cvd, risk_diabetes, risk_obesity,
       risk_immuno + risk_cvd + risk_diabetes + risk_obesity AS risk_num,
       CAST(patient_age >= 65 AS INT) AS risk_age_flag, prior_contra_lvl,
       CASE WHEN month(diseasex_dt) IN (12, 1, 2) THEN 'Winter' WHEN month(diseasex_dt) IN (3, 4, 5) THEN 'Spring'
            WHEN month(diseasex_dt) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS dx_season,
       days AS symptom_to_diagnosis_days, CAST(coalesce(days, 0) <= 5 AS INT) AS diagnosis_within_5days_flag,
       e.phys_total_dx, e.phys_treat_rate_all, coalesce(e.phys_experience_level, 'Low') AS phys_experience_level,
       CAST(1 - has_treat AS INT) AS target
FROM j LEFT JOIN exp e ON j.physician_id = e.physician_id"""


register("model_ready_features",
         ops=("F4", "F5", "F6", "F7", "W1", "J1", "J4", "J5", "J6", "J7", "A1", "A2", "A3", "A4", "A5",
              "P9", "P10", "P11", "P12", "P13", "P14", "P15", "P16", "P20", "P22"),
         sql=_features_sql())(model_ready_features)


# ---- F9 + L24 + L25 -----------------------------------------------------------------
def _eligibility(spark, sf):
    fact = clinical_fact(spark, sf)
    pats, _ = clean_dims(spark, sf)
    idx = FE.index_rows(fact, FC, FE.Preset()).select("patient_id", F.col("diseasex_dt").alias("diagnosis_dt"))
    return FE.eligibility(fact, idx, pats.select("patient_id", F.when(F.col("birth_year") > 0, F.col("birth_year"))
                                                .alias("birth_year")), FC, FE.Preset())


def eligibility_q(spark, sf):
    e = _eligibility(spark, sf)
    return e.select("patient_id", F.col("diagnosis_dt").cast("timestamp_ntz").alias("diagnosis_dt"),
                    "patient_age", "age_eligible", "symptom_to_diagnosis_days", "within_5day_window",
                    "is_high_risk_by_age", F.array_join("risk_factors_found", ",").alias("risk_factors_found"),
                    "is_high_risk", "contraindication_level", "no_severe_contraindication",
                    F.array_join("contraindication_details", ",").alias("contraindication_details"),
                    "meets_criteria")


def _eligibility_sql() -> str:
    groups = list(C.HIGH_RISK_KEYWORDS.items())
    gflags = ",\n  ".join(
        "max(CASE WHEN txn_type = 'CONDITIONS' AND txn_dt <= diagnosis_dt AND regexp_matches(txn_desc, '"
        + "(?i)(" + "|".join(words) + f")') THEN 1 ELSE 0 END) AS g{i}" for i, (_, words) in enumerate(groups))
    found = ", ".join(["CASE WHEN coalesce(patient_age >= 65, false) THEN 'age_65_or_older' END"] +
                      [f"CASE WHEN g{i} = 1 THEN '{name}' END" for i, (name, _) in enumerate(groups)])
    return f"""
WITH fact AS ({D.FACT_SQL}),
pats AS ({PATS_SQL}),
idx AS (SELECT patient_id, txn_dt AS diagnosis_dt FROM (
          SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY txn_dt, event_id) AS rn
          FROM fact WHERE txn_desc = 'DISEASE_X') WHERE rn = 1),
per AS (SELECT f.patient_id,
  min(CASE WHEN txn_type = 'SYMPTOMS' AND txn_dt <= diagnosis_dt THEN txn_dt END) AS earliest_symptom,
  {gflags},
  max(CASE WHEN txn_type = 'CONTRAINDICATIONS' AND txn_dt <= diagnosis_dt THEN {_level_sql('txn_desc')} END) AS lvl,
  list_sort(list(DISTINCT txn_desc) FILTER (WHERE txn_type = 'CONTRAINDICATIONS' AND txn_dt <= diagnosis_dt))
    AS details
  FROM fact f JOIN idx USING (patient_id) GROUP BY 1),
b AS (SELECT i.patient_id, i.diagnosis_dt,
             CAST(year(i.diagnosis_dt) - CASE WHEN p.birth_year > 0 THEN p.birth_year END AS INT) AS patient_age,
             CAST(floor((epoch_us(i.diagnosis_dt) - epoch_us(earliest_symptom)) / 86400000000.0) AS INT) AS days,
             per.* EXCLUDE (patient_id)
      FROM idx i LEFT JOIN pats p USING (patient_id) LEFT JOIN per USING (patient_id)),
c AS (SELECT *, list_filter([{found}], lambda x: x IS NOT NULL) AS found,
             CAST(coalesce(lvl, 0) AS INT) AS level FROM b)
SELECT patient_id, diagnosis_dt, patient_age, coalesce(patient_age >= 12, false) AS age_eligible,
       days AS symptom_to_diagnosis_days, (days IS NULL OR days <= 5) AS within_5day_window,
       coalesce(patient_age >= 65, false) AS is_high_risk_by_age, array_to_string(found, ',') AS risk_factors_found,
       len(found) > 0 AS is_high_risk, level AS contraindication_level, level < 3 AS no_severe_contraindication,
       coalesce(array_to_string(details, ','), '') AS contraindication_details,
       coalesce(patient_age >= 12, false) AND (days IS NULL OR days <= 5) AND len(found) > 0 AND level < 3
         AS meets_criteria
FROM c"""


register("eligibility", ops=("F9", "P9", "P17", "A3", "A21", "J4", "W1"), sql=_eligibility_sql())(eligibility_q)


def alert_decisions(spark, sf):
    """L24 + L25: the score is the provider's treated share (a stand-in model
    output derived from the tables); alerts need prediction, probability and rules."""
    e = _eligibility(spark, sf)
    fact = clinical_fact(spark, sf)
    exp = FE.provider_experience(fact, FC, FE.Preset())
    idx = FE.index_rows(fact, FC, FE.Preset()).select("patient_id", "physician_id")
    scored = (e.join(idx, ["patient_id"], "left").join(exp, ["physician_id"], "left")
              .withColumn("probability", F.coalesce(F.lit(1.0) - F.col("phys_treat_rate_all"), F.lit(0.5)))
              .withColumn("prediction", (F.col("probability") >= 0.5).cast("int")))
    decided = FE.decide_alerts(scored)
    return FE.score_summary(decided).select(
        F.col("total").cast("long").alias("total"), F.col("alerts").cast("long").alias("alerts"),
        F.col("eligible").cast("long").alias("eligible"))


register("alert_decisions", ops=("L24", "L25", "F9", "F7"), sql=f"""
WITH e AS ({_eligibility_sql()}),
fact AS ({D.FACT_SQL}), {EXP_SQL.strip()},
idx AS (SELECT patient_id, physician_id FROM (
          SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY txn_dt, event_id) AS rn
          FROM fact WHERE txn_desc = 'DISEASE_X') WHERE rn = 1),
s AS (SELECT e.meets_criteria, coalesce(1.0 - x.phys_treat_rate_all, 0.5) AS probability
      FROM e LEFT JOIN idx USING (patient_id) LEFT JOIN exp x ON idx.physician_id = x.physician_id)
SELECT count(*) AS total,
       CAST(sum(CASE WHEN probability >= 0.5 AND probability >= 0.7 AND coalesce(meets_criteria, false)
                THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
       CAST(sum(CASE WHEN meets_criteria THEN 1 ELSE 0 END) AS BIGINT) AS eligible
FROM s""")(alert_decisions)
