"""Domain constants of the clinical preset.

Fixed values: these must equal the application's own lists for results to
match, so they are stated plainly here, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
INDEX_CODE = "DISEASE_X"
TREATMENT = "DRUG A"
MIN_AGE_YEARS = 12
HIGH_RISK_AGE = 65
SYMPTOM_WINDOW_DAYS = 5
EXPERIENCE_THRESHOLDS = [(200, "High"), (20, "Medium")]  # else "Low"
EXPERIENCE_DEFAULT = "Low"

SYMPTOMS = [
    "ACUTE_PHARYNGITIS", "ACUTE_URI", "CHILLS", "CONGESTION", "COUGH",
    "DIARRHEA", "DIFFICULTY_BREATHING", "FATIGUE", "FEVER", "HEADACHE",
    "LOSS_OF_TASTE_OR_SMELL", "MUSCLE_ACHE", "NAUSEA_AND_VOMITING",
    "SORE_THROAT",
]

RISK_GROUPS = {
    "RISK_IMMUNO": ["IMMUNOCOMPROMISED"],
    "RISK_CVD": ["HEART_DISEASE", "HYPERTENSION", "STROKE"],
    "RISK_DIABETES": ["DIABETES"],
    "RISK_OBESITY": ["OBESITY"],
}

CONTRAINDICATION_LEVELS = {
    "LOW_CONTRAINDICATION": 1,
    "MEDIUM_CONTRAINDICATION": 2,
    "HIGH_CONTRAINDICATION": 3,
}
SEVERE_CONTRAINDICATION = 3

HIGH_RISK_KEYWORDS = {
    "chronic_lung_disease": ["COPD", "CHRONIC_OBSTRUCTIVE_PULMONARY_DISEASE",
                             "ASTHMA", "CHRONIC_BRONCHITIS", "EMPHYSEMA", "PULMONARY"],
    "cardiovascular_disease": ["HEART_DISEASE", "HEART_FAILURE", "CORONARY_ARTERY_DISEASE",
                               "HYPERTENSION", "STROKE", "CARDIAC", "CHF", "MYOCARDIAL"],
    "cancer": ["CANCER", "MALIGNANCY", "CARCINOMA", "LYMPHOMA",
               "LEUKEMIA", "CHEMOTHERAPY", "ONCOLOGY", "TUMOR"],
    "immunocompromised": ["IMMUNOCOMPROMISED", "IMMUNOSUPPRESSED", "IMMUNODEFICIENCY",
                          "ORGAN_TRANSPLANT", "TRANSPLANT", "HIV", "AIDS"],
    "obesity": ["OBESITY", "OBESE", "BMI_30", "OVERWEIGHT"],
    "diabetes": ["DIABETES", "DIABETIC", "TYPE_1_DIABETES", "TYPE_2_DIABETES",
                 "HYPERGLYCEMIA"],
    "smoking": ["SMOKING", "SMOKER", "TOBACCO_USE", "TOBACCO", "NICOTINE"],
}
AGE_RISK_FACTOR = "age_65_or_older"

BLANK_STRINGS = ["", "nan", "None", "NaN"]
GENDER_MAP = {"M": "M", "m": "M", "Male": "M", "male": "M",
              "F": "F", "f": "F", "Female": "F", "female": "F",
              "Unknown": "Unknown"}
PATIENT_BIRTH_YEAR_MIN = 1900
PHYSICIAN_BIRTH_YEAR_RANGE = (1930, 2005)
PHYSICIAN_MIN_AGE_AT_EVENT = 25

# Seasons by month (batch spelling; serving used upper case).
SEASONS = [((12, 1, 2), "Winter"), ((3, 4, 5), "Spring"),
           ((6, 7, 8), "Summer"), ((9, 10, 11), "Fall")]

# Alert decision (model AND rules).
ALERT_PROBABILITY_CUTOFF = 0.7

# Composite model ranking weights.
RANKING_WEIGHTS = {"precision": 0.30, "pr_auc": 0.25, "recall": 0.15,
                   "f1": 0.15, "roc_auc": 0.10, "accuracy": 0.05}

# Drift severity bands on the drift score, highest first (inclusive cuts).
DRIFT_SEVERITY = [(0.3, "critical"), (0.2, "high"), (0.1, "medium")]
DRIFT_SEVERITY_DEFAULT = "low"
DRIFT_P_VALUE = 0.05
CATEGORICAL_DISTINCT_SHARE = 0.05
LABEL_COLUMNS = ["target", "label", "y"]

# Quality grade bands (inclusive, highest first).
QUALITY_GRADES = [(90, "A (Excellent)"), (80, "B (Good)"), (70, "C (Fair)"), (60, "D (Poor)")]
QUALITY_GRADE_DEFAULT = "F (Critical)"

# Performance decline bands (inclusive, highest first).
DECLINE_LEVELS = [(0.15, "critical"), (0.10, "high"), (0.05, "medium")]
DECLINE_LEVEL_DEFAULT = "low"

# Alert severities in ordinal order (lowest first).
SEVERITY_ORDER = ["low", "medium", "high", "critical"]
# --- end fixed values -------------------------------------------------------

# --- fixed values: monitoring ---------------------------------------------------
BASELINE_METRICS = {"pr_auc": 0.881, "precision": 0.844, "recall": 0.849, "f1_score": 0.846,
                    "accuracy": 0.746}
DECLINE_THRESHOLDS = {"pr_auc": 0.05, "precision": 0.03, "recall": 0.03, "f1_score": 0.03,
                      "accuracy": 0.05}
MIN_PREDICTIONS_FOR_DRIFT = 100
MAX_ALERTS_PER_HOUR = 10
RETENTION_DAYS = 30
ROLLUP_WINDOWS = ["1 minute", "5 minutes", "15 minutes", "1 hour"]

# Default alert rules: name, alert type, threshold, severity, channels, cooldown minutes.
DEFAULT_ALERT_RULES = [
    ("Performance Drift - High", "performance_drift", 0.10, "high", ["log", "console"], 60),
    ("Performance Drift - Critical", "performance_drift", 0.15, "critical", ["log", "console", "email"], 30),
    ("Data Drift - High", "data_drift", 0.2, "high", ["log", "console"], 120),
    ("Data Drift - Critical", "data_drift", 0.3, "critical", ["log", "console", "email"], 60),
    ("Model Error Rate", "model_error", 0.05, "medium", ["log", "console"], 30),
]
# --- end fixed values -----------------------------------------------------------

# --- fixed values: patient records and forms -------------------------------------
FORM_CONTRA_MULTIPLIER = {"Low": 1.0, "Medium": 1.5, "High": 2.0}
FORM_RISK_LEVELS = [(8, "High Risk"), (5, "Medium Risk")]   # else "Low Risk"
FORM_ALERT_SCORE = 6
RECORD_RISK_LEVELS = [(6, "High Risk"), (4, "Medium Risk")]  # else "Low Risk"
RECORD_HIGH_RISK_CONDITIONS = ["IMMUNOCOMPROMISED", "DIABETES", "HEART_DISEASE"]
RECORD_SEVERE_SYMPTOMS = ["SHORTNESS_OF_BREATH", "CHEST_PAIN", "FEVER"]
RECENT_DAYS = 365
# --- end fixed values -------------------------------------------------------------

# Words that make an event count for the recent cohort (any case).
COHORT_KEYWORDS = ["DISEASE_X", "IMMUNOCOMPROMISED", "DIABETES", "HEART_DISEASE", "HYPERTENSION", "COUGH", "FEVER",
                   "SHORTNESS_OF_BREATH", "CHEST_PAIN", "FATIGUE", "OBESITY"]

# Titles of the recommended action, by priority.
ACTION_TITLES = {"high": "Consider Drug A Prescription", "medium": "Clinical Review Recommended",
                 "low": "Continue Current Treatment"}
# Advice per quality dimension that scores low.
QUALITY_ADVICE = {"completeness_score": "Review missing data",
                  "consistency_score": "Check for duplicates and format issues",
                  "validity_score": "Review outliers and data ranges"}
