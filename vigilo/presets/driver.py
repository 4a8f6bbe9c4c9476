"""Mapping of the clinical roles onto the driver's TPC-H-like tables.

fact events      events(event_id, ts, user_id, event_type, value, props)
index code       event_type = 'purchase'
symptoms         'error', 'click'
treatment        'signup'
conditions       'view' (risk codes and contraindication levels derive from value)
entity dimension customer (user_id joins c_custkey)
provider         supplier; volume and return rate from lineitem by l_suppkey

The dirty-input derivations below are SQL expression text valid in both
Spark SQL and DuckDB, so the two engines see identical inputs.  They derive
values (blank spellings, out-of-range years, bad ids, unparseable dates);
they never drop rows.
"""

AS_OF = "2025-10-17 00:00:00"
AS_OF_YEAR = 2025

INDEX_TYPE = "purchase"
SYMPTOM_TYPES = ["error", "click"]
TREATMENT_TYPE = "signup"
CONDITION_TYPE = "view"

# Whitespace set of Python's str.strip, spelled with chr() for both engines.
WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

CUSTOMER_GENDER = ("CASE c_custkey % 8 WHEN 0 THEN 'male' WHEN 1 THEN 'MALE' "
                   "WHEN 2 THEN ' F' || chr(9) WHEN 3 THEN 'nan' WHEN 4 THEN '' "
                   "WHEN 5 THEN 'Female' WHEN 6 THEN NULL ELSE 'M' END")
CUSTOMER_BIRTH_YEAR = ("CAST(CASE WHEN c_custkey % 11 = 0 THEN 1899 WHEN c_custkey % 13 = 0 THEN NULL "
                       "WHEN c_custkey % 17 = 0 THEN 2031 ELSE 1925 + c_custkey % 90 END AS INT)")
SUPPLIER_BIRTH_YEAR = "CAST(CASE WHEN s_suppkey % 9 = 0 THEN -1 ELSE 1925 + s_suppkey % 85 END AS DOUBLE)"
SUPPLIER_STATE = ("CASE s_suppkey % 6 WHEN 0 THEN ' ny ' WHEN 1 THEN 'NaN' WHEN 2 THEN 'ca' "
                  "WHEN 3 THEN 'TX' || chr(9) ELSE 'WA' END")
SUPPLIER_TYPE = ("CASE s_suppkey % 4 WHEN 0 THEN 'family practice' WHEN 1 THEN 'INTERNAL MEDICINE' "
                 "WHEN 2 THEN ' pediatrics' ELSE 'None' END")

EVENT_PROVIDER = ("CASE WHEN event_id % 37 = 0 THEN -1 WHEN event_id % 31 = 0 THEN NULL "
                  "WHEN event_id % 53 = 0 THEN -7 ELSE user_id % 130 END")
EVENT_DT_TEXT = ("CASE WHEN event_id % 23 = 0 THEN 'not a date' "
                 "WHEN event_id % 29 = 0 THEN '2031-06-01 00:00:00' ELSE CAST(ts AS STRING) END")
EVENT_DESC = ("CASE WHEN event_id % 41 = 0 THEN ' ' || event_type || chr(9) "
              "WHEN event_id % 43 = 0 THEN 'None' ELSE event_type END")

# Provider of each entity (the fact table has none): a supplier key.
USER_PROVIDER = "user_id % 100"

# Condition code of a 'view' event, from its value: contraindication levels
# and risk-group codes of the clinical preset.
CONDITION_CODE = ("CASE WHEN value >= 300 THEN 'HIGH_CONTRAINDICATION' "
                  "WHEN value >= 250 THEN 'MEDIUM_CONTRAINDICATION' "
                  "WHEN value >= 200 THEN 'LOW_CONTRAINDICATION' "
                  "WHEN value >= 150 THEN 'HEART_DISEASE' WHEN value >= 100 THEN 'DIABETES' "
                  "WHEN value >= 60 THEN 'OBESITY' WHEN value >= 30 THEN 'IMMUNOCOMPROMISED' "
                  "ELSE 'OTHER' END")

# Document score for evaluation queries: longer documents score higher.
DOC_SCORE = "LEAST(CAST(n_chars AS DOUBLE) / 4000.0, CAST(1 AS DOUBLE))"


def _symptom_case() -> str:
    from vigilo.presets.clinical import SYMPTOMS
    whens = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SYMPTOMS))
    return f"CASE CAST(floor(value) AS BIGINT) % {len(SYMPTOMS)} {whens} END"


# Clinical-shaped fact rows derived from events (shared by Spark and DuckDB).
FACT_TYPE = ("CASE event_type WHEN 'purchase' THEN 'CONDITIONS' WHEN 'error' THEN 'SYMPTOMS' "
             "WHEN 'click' THEN 'SYMPTOMS' WHEN 'signup' THEN 'TREATMENTS' "
             "ELSE CASE WHEN value >= 200 THEN 'CONTRAINDICATIONS' ELSE 'CONDITIONS' END END")
FACT_DESC = ("CASE event_type WHEN 'purchase' THEN 'DISEASE_X' "
             "WHEN 'signup' THEN CASE WHEN value >= 100 THEN 'DRUG A' ELSE 'DRUG B' END "
             f"WHEN 'view' THEN {CONDITION_CODE} ELSE {_symptom_case()} END")
FACT_PHYSICIAN = "CASE WHEN event_id % 97 = 0 THEN -1 ELSE event_id % 120 END"

FACT_SQL = (f"SELECT event_id, ts AS txn_dt, user_id AS patient_id, {FACT_PHYSICIAN} AS physician_id, "
            f"{FACT_TYPE} AS txn_type, {FACT_DESC} AS txn_desc FROM events")

# Prediction log derived from events: a probability from the value, labels for
# purchases/signups (1), views/clicks (0) and none for errors.
PRED_SQL = ("SELECT ts AS timestamp, CAST(value >= 100 AS INT) AS prediction, "
            "LEAST(value / 400.0, CAST(1 AS DOUBLE)) AS probability, "
            "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN NULL ELSE 0 END "
            "AS actual_label, value AS response_time_ms, 'v' || CAST(user_id % 3 AS STRING) AS model_version "
            "FROM events")
MONITOR_SINCE = "2024-01-15 00:00:00"
MONITOR_AS_OF = "2024-01-30 12:00:00"
