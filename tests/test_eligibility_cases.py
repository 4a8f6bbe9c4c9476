"""The eight request cases of the reference application (F8 -> F9 -> L24).

Inputs and expected eligibility values are transcribed from the stored test
stored data fed to the alert decision.
"""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigilo.plans import features as FE

DX = datetime(2025, 10, 21)
COND_DT = datetime(2025, 10, 1)

# case: (birth_year, symptoms, symptom date, conditions, contraindication (desc, date) or None)
CASES = {
    "age_under_12_child": (2015, ["FEVER"], datetime(2025, 10, 19), ["DIABETES"], None),
    "contraindication_patient": (1955, ["FEVER"], datetime(2025, 10, 18), ["DIABETES"],
                                 ("HIGH_CONTRAINDICATION", datetime(2025, 10, 11))),
    "elderly_multiple_risk_factors": (1940, ["FEVER", "COUGH", "DIFFICULTY_BREATHING"], datetime(2025, 10, 19),
                                      ["DIABETES", "HEART_DISEASE", "OBESITY", "COPD"], None),
    "healthy_young_adult": (1995, ["FEVER"], datetime(2025, 10, 18), [], None),
    "high_risk_senior_patient": (1957, ["FEVER"], datetime(2025, 10, 18), ["DIABETES", "HEART_DISEASE"], None),
    "immunocompromised_patient": (1953, ["FEVER", "COUGH", "FATIGUE", "MUSCLE_ACHE"], datetime(2025, 10, 20),
                                  ["IMMUNOCOMPROMISED", "DIABETES", "HEART_DISEASE"], None),
    "late_symptoms_patient": (1955, ["FEVER"], datetime(2025, 10, 14), [], None),
    "obese_copd_patient": (1960, ["FEVER", "COUGH", "DIFFICULTY_BREATHING", "FATIGUE"], datetime(2025, 10, 18),
                           ["OBESITY", "COPD", "DIABETES", "HEART_DISEASE"], None),
}

# case: (age, days, level, risk factors, meets criteria, probability, alert)
EXPECTED = {
    "age_under_12_child": (10, 2, 0, ["diabetes"], False, 0.8014, False),
    "contraindication_patient": (70, 3, 3, ["age_65_or_older", "diabetes"], False, 0.5177, False),
    "elderly_multiple_risk_factors": (85, 2, 0, ["age_65_or_older", "chronic_lung_disease",
                                                 "cardiovascular_disease", "obesity", "diabetes"], True, 0.7670, True),
    "healthy_young_adult": (30, 3, 0, [], False, 0.7516, False),
    "high_risk_senior_patient": (68, 3, 0, ["age_65_or_older", "cardiovascular_disease", "diabetes"],
                                 True, 0.6694, False),
    "immunocompromised_patient": (72, 1, 0, ["age_65_or_older", "cardiovascular_disease", "immunocompromised",
                                             "diabetes"], True, 0.7382, True),
    "late_symptoms_patient": (70, 7, 0, ["age_65_or_older"], False, 0.6052, False),
    "obese_copd_patient": (65, 3, 0, ["age_65_or_older", "chronic_lung_disease", "cardiovascular_disease",
                                      "obesity", "diabetes"], True, 0.7331, True),
}

REQUEST_SCHEMA = ("case string, patient_id bigint, birth_year int, gender string, diagnosis_date timestamp, "
                  "transactions array<struct<txn_dt: timestamp, physician_id: bigint, txn_type: string, "
                  "txn_desc: string>>, physician_info struct<physician_id: bigint, state: string, "
                  "physician_type: string>")


def _requests(spark):
    rows = []
    for i, (case, (by, syms, sym_dt, conds, contra)) in enumerate(sorted(CASES.items())):
        txns = [(DX, 7, "CONDITIONS", "DISEASE_X")]
        txns += [(sym_dt, 7, "SYMPTOMS", s) for s in syms]
        txns += [(COND_DT, 7, "CONDITIONS", c) for c in conds]
        if contra:
            txns.append((contra[1], 7, "CONTRAINDICATIONS", contra[0]))
        rows.append((case, 1000 + i, by, "M", DX, txns, (7, "CA", "Internal Medicine")))
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


@pytest.fixture(scope="module")
def decided(spark):
    req = _requests(spark)
    fact, index, pats = FE.requests_to_fact(req)
    elig = FE.eligibility(fact, index, pats)
    probs = spark.createDataFrame([(c, EXPECTED[c][5]) for c in CASES], "case string, probability double")
    scored = (elig.join(req.select("patient_id", "case"), "patient_id").join(probs, "case")
              .withColumn("prediction", (F.col("probability") >= 0.5).cast("int")))
    return {r["case"]: r for r in FE.decide_alerts(scored).collect()}


@pytest.mark.parametrize("case", sorted(CASES))
def test_case(decided, case):
    age, days, level, factors, meets, _, alert = EXPECTED[case]
    r = decided[case]
    assert r["patient_age"] == age
    assert r["symptom_to_diagnosis_days"] == days
    assert r["contraindication_level"] == level
    assert list(r["risk_factors_found"]) == factors
    assert r["meets_criteria"] is meets
    assert r["alert_recommended"] is alert


def test_request_features(spark):
    req = _requests(spark)
    f = {r["case"]: r for r in FE.request_features(req).join(req.select("patient_id", "case"), "patient_id")
         .collect()}
    e = f["elderly_multiple_risk_factors"]
    assert (e["patient_age"], e["sym_count_5d"], e["risk_diabetes"], e["risk_cvd"], e["risk_obesity"],
            e["risk_num"], e["risk_age_flag"]) == (85, 3, 1, 1, 1, 3, 1)
    assert e["symptom_to_diagnosis_days"] == 2 and e["diagnosis_within_5days_flag"] == 1
    assert e["phys_total_dx"] == 50 and e["phys_experience_level"] == "Medium"   # default provider total
    assert f["contraindication_patient"]["prior_contra_lvl"] == 3
    late = f["late_symptoms_patient"]
    assert late["symptom_to_diagnosis_days"] == 7 and late["diagnosis_within_5days_flag"] == 0
    assert late["sym_count_5d"] == 0 and late["dx_season"] == "Fall"
