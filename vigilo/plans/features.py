"""Entity feature tables from event histories.

The fact table is read once per branch with its filter and projection pushed
into the scan.  All per-entity features (symptom onset and counts, symptom and
risk flags, contraindication level, treatment label) come from **one** join
of the fact rows to the entity's index row and **one** conditional aggregate,
instead of a merge per flag.  Provider statistics are a second aggregate keyed
by provider.  Nothing is collected; every step partitions by entity or
provider key, and hot keys are combined map-side by the partial aggregates.

Fact columns (renamable): patient_id, physician_id, txn_dt, txn_type,
txn_desc, plus a tie-break column for equal timestamps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.functions import scalar as S
from vigilo.operators.windows import index_event
from vigilo.presets import clinical as C


@dataclass
class FactColumns:
    patient: str = "patient_id"
    physician: str = "physician_id"
    ts: str = "txn_dt"
    type: str = "txn_type"
    desc: str = "txn_desc"
    tie: tuple[str, ...] = ()


@dataclass
class Preset:
    index_code: str = C.INDEX_CODE
    treatment: str = C.TREATMENT
    min_age: int = C.MIN_AGE_YEARS
    high_risk_age: int = C.HIGH_RISK_AGE
    window_days: int = C.SYMPTOM_WINDOW_DAYS
    symptoms: Sequence[str] = tuple(C.SYMPTOMS)
    risk_groups: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(C.RISK_GROUPS))
    contra_levels: Mapping[str, int] = field(default_factory=lambda: dict(C.CONTRAINDICATION_LEVELS))
    experience: Sequence[tuple] = tuple(C.EXPERIENCE_THRESHOLDS)
    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(C.HIGH_RISK_KEYWORDS))


def index_rows(fact: DataFrame, fc: FactColumns, preset: Preset) -> DataFrame:
    """Each patient's earliest index-code row (explicit tie-break)."""
    src = fact.filter(F.col(fc.desc) == preset.index_code).select(
        fc.patient, fc.ts, *fc.tie, fc.physician)
    idx = index_event(src, fc.patient, fc.ts, tie=list(fc.tie))
    return idx.select(fc.patient, F.col(fc.ts).alias("diseasex_dt"), F.col(fc.physician).alias("physician_id"))


# F5 + F6 + A5 in one pass ----------------------------------------------------------
def entity_history_features(fact: DataFrame, index: DataFrame, fc: FactColumns, preset: Preset) -> DataFrame:
    """Symptom, risk, contraindication and label features per indexed patient."""
    ts, typ, desc = F.col(fc.ts), F.col(fc.type), F.col(fc.desc)
    rows = fact.select(fc.patient, fc.ts, fc.type, fc.desc).join(
        index.select(fc.patient, "diseasex_dt"), [fc.patient], "inner")
    before = ts <= F.col("diseasex_dt")
    lo = F.col("diseasex_dt") - F.expr(f"INTERVAL {int(preset.window_days)} DAYS")
    sym = (typ == "SYMPTOMS") & before
    cond = (typ == "CONDITIONS") & before
    contra = (typ == "CONTRAINDICATIONS") & before
    treated = (typ == "TREATMENTS") & (desc == preset.treatment)

    def flag(c: Column) -> Column:
        return F.max(F.when(c, 1).otherwise(0))

    aggs = [F.max(F.when(sym, ts)).alias("symptom_onset_dt"),
            F.sum(F.when(sym & (ts >= lo), 1).otherwise(0)).cast("int").alias("sym_count_5d")]
    aggs += [flag(sym & (desc == s)).alias("sym_" + s.lower()) for s in preset.symptoms]
    aggs += [flag(cond & desc.isin(*names)).alias(g.lower()) for g, names in preset.risk_groups.items()]
    aggs += [F.coalesce(F.max(F.when(contra, S.level_of(desc, preset.contra_levels))), F.lit(0))
             .cast("int").alias("prior_contra_lvl"),
             flag(treated).alias("has_treat")]
    feats = rows.groupBy(fc.patient).agg(*aggs)
    return feats


# F7 -------------------------------------------------------------------------
def provider_experience(fact: DataFrame, fc: FactColumns, preset: Preset) -> DataFrame:
    """Per provider: index diagnoses (rows), treated share of distinct diagnosed
    patients, and the experience band.  The -1 sentinel is not a provider."""
    dx = (fact.filter(F.col(fc.desc) == preset.index_code)
          .select(S.null_if(F.col(fc.physician), -1).alias("physician_id"), F.col(fc.patient).alias("patient_id"))
          .filter(F.col("physician_id").isNotNull()))
    total = dx.groupBy("physician_id").agg(F.count(F.lit(1)).alias("phys_total_dx"))
    treated = (fact.filter((F.col(fc.type) == "TREATMENTS") & (F.col(fc.desc) == preset.treatment))
               .select(F.col(fc.patient).alias("patient_id")).distinct().withColumn("treated", F.lit(1.0)))
    pairs = dx.distinct().join(treated, ["patient_id"], "left").fillna({"treated": 0.0})
    rate = pairs.groupBy("physician_id").agg(F.avg("treated").alias("phys_treat_rate_all"))
    out = total.join(rate, ["physician_id"], "inner")
    return out.withColumn("phys_experience_level",
                          S.band("phys_total_dx", preset.experience, C.EXPERIENCE_DEFAULT))


# F4 -------------------------------------------------------------------------
FEATURE_ORDER = [
    "patient_id", "physician_id", "diseasex_dt", "patient_age", "patient_gender",
    "physician_state", "physician_type", "symptom_onset_dt", "sym_count_5d",
] + ["sym_" + s.lower() for s in C.SYMPTOMS] + [
    "risk_immuno", "risk_cvd", "risk_diabetes", "risk_obesity", "risk_num", "risk_age_flag",
    "prior_contra_lvl", "dx_season", "symptom_to_diagnosis_days", "diagnosis_within_5days_flag",
    "phys_total_dx", "phys_treat_rate_all", "phys_experience_level", "target",
]


def build_features(fact: DataFrame, patients: DataFrame, physicians: DataFrame,
                   fc: FactColumns = FactColumns(), preset: Preset = Preset(),
                   order: Sequence[str] = tuple(FEATURE_ORDER)) -> DataFrame:
    """Model-ready table: one row per patient with an index event, age >= minimum.

    ``patients``: patient_id, birth_year, gender.  ``physicians``:
    physician_id, state, physician_type (both already cleaned, unique keys).
    """
    idx = index_rows(fact, fc, preset).withColumnRenamed(fc.patient, "patient_id")
    pats = patients.select("patient_id", F.col("birth_year").alias("_by"), F.col("gender").alias("_g"))
    base = idx.join(pats, ["patient_id"], "left").withColumns({
        "patient_age": S.age_at("diseasex_dt", F.coalesce(F.col("_by"), F.lit(-1))),
        "patient_gender": F.coalesce(F.col("_g"), F.lit("UNKNOWN")),
    })
    base = S.filter_min(base, "patient_age", preset.min_age)
    phys = physicians.select("physician_id", F.col("state").alias("_st"), F.col("physician_type").alias("_pt"))
    base = base.join(phys, ["physician_id"], "left").withColumns({
        "physician_state": F.coalesce(F.col("_st"), F.lit("UNKNOWN")),
        "physician_type": F.coalesce(F.col("_pt"), F.lit("UNKNOWN")),
    })
    fact_p = fact.withColumnRenamed(fc.patient, "patient_id") if fc.patient != "patient_id" else fact
    fcp = FactColumns("patient_id", fc.physician, fc.ts, fc.type, fc.desc, fc.tie)
    hist = entity_history_features(fact_p, base.select("patient_id", "diseasex_dt"), fcp, preset)
    flags0 = {c: 0 for c in hist.columns if c not in ("patient_id", "symptom_onset_dt")}
    out = base.join(hist, ["patient_id"], "left").fillna(flags0)
    days = F.greatest(S.day_diff("diseasex_dt", "symptom_onset_dt"), F.lit(0))
    risk_cols = [g.lower() for g in preset.risk_groups]
    out = out.withColumns({
        "risk_num": S.count_flags(risk_cols),
        "risk_age_flag": S.flag_ge("patient_age", preset.high_risk_age),
        "dx_season": S.season("diseasex_dt"),
        "symptom_to_diagnosis_days": days,
        "diagnosis_within_5days_flag": S.within_days(days, preset.window_days),
        "target": (F.lit(1) - F.col("has_treat")).cast("int"),
    })
    exp = provider_experience(fact, fc, preset)
    out = out.join(exp, ["physician_id"], "left").withColumn(
        "phys_experience_level", F.coalesce(F.col("phys_experience_level"), F.lit(C.EXPERIENCE_DEFAULT)))
    return S.align_columns(out, list(order))


# F9 -------------------------------------------------------------------------
def eligibility(fact: DataFrame, index: DataFrame, patients: DataFrame, fc: FactColumns = FactColumns(),
                preset: Preset = Preset()) -> DataFrame:
    """Rule-based eligibility per indexed entity.

    ``index``: patient_id, diagnosis_dt.  ``patients``: patient_id, birth_year.
    Uses the *earliest* symptom at or before diagnosis; no symptom counts as
    inside the window.  Risk groups match condition text case-insensitively.
    """
    ts, typ, desc = F.col(fc.ts), F.col(fc.type), F.col(fc.desc)
    rows = fact.select(F.col(fc.patient).alias("patient_id"), fc.ts, fc.type, fc.desc) \
        .join(index.select("patient_id", "diagnosis_dt"), ["patient_id"], "inner")
    before = ts <= F.col("diagnosis_dt")
    cond = (typ == "CONDITIONS") & before
    contra = (typ == "CONTRAINDICATIONS") & before
    groups = list(preset.keywords)
    aggs = [F.min(F.when((typ == "SYMPTOMS") & before, ts)).alias("earliest_symptom")]
    aggs += [F.max(F.when(cond & desc.rlike(S.keyword_pattern(words)), 1).otherwise(0)).alias("_g" + str(i))
             for i, words in enumerate(preset.keywords.values())]
    aggs += [F.max(F.when(contra, S.level_of(desc, preset.contra_levels))).alias("_lvl"),
             F.array_sort(F.collect_set(F.when(contra, desc))).alias("contraindication_details")]
    per = rows.groupBy("patient_id").agg(*aggs)
    base = index.join(patients.select("patient_id", "birth_year"), ["patient_id"], "left") \
        .join(per, ["patient_id"], "left")
    age = (F.year("diagnosis_dt") - F.col("birth_year")).cast("int")
    days = S.day_diff("diagnosis_dt", "earliest_symptom").cast("int")
    # A missing birth year makes the patient neither age-eligible nor high-risk by age.
    by_age = F.coalesce(age >= preset.high_risk_age, F.lit(False))
    found = F.array_compact(F.array(
        F.when(by_age, F.lit(C.AGE_RISK_FACTOR)),
        *[F.when(F.col("_g" + str(i)) == 1, F.lit(name)) for i, name in enumerate(groups)]))
    lvl = F.coalesce(F.col("_lvl"), F.lit(0)).cast("int")
    out = base.select(
        "patient_id", "diagnosis_dt",
        age.alias("patient_age"),
        F.coalesce(age >= preset.min_age, F.lit(False)).alias("age_eligible"),
        days.alias("symptom_to_diagnosis_days"),
        (days.isNull() | (days <= preset.window_days)).alias("within_5day_window"),
        by_age.alias("is_high_risk_by_age"),
        found.alias("risk_factors_found"),
        lvl.alias("contraindication_level"),
        (lvl < C.SEVERE_CONTRAINDICATION).alias("no_severe_contraindication"),
        F.coalesce(F.col("contraindication_details"), F.array().cast("array<string>"))
        .alias("contraindication_details"))
    out = out.withColumn("is_high_risk", F.size("risk_factors_found") > 0)
    return out.withColumn("meets_criteria", F.col("age_eligible") & F.col("within_5day_window") &
                          F.col("is_high_risk") & F.col("no_severe_contraindication"))


# F8 / S4 ---------------------------------------------------------------------------
def requests_to_fact(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested requests -> (fact rows, index rows, patient rows), keeping the real id."""
    fact = (requests.select("patient_id", F.explode_outer("transactions").alias("t"))
            .select("patient_id", "t.txn_dt", "t.physician_id", "t.txn_type", "t.txn_desc"))
    index = requests.select("patient_id", F.col("diagnosis_date").alias("diagnosis_dt"))
    pats = requests.select("patient_id", "birth_year")
    return fact, index, pats


DEFAULT_PROVIDER_TOTAL = 50


def request_features(requests: DataFrame, provider_totals: DataFrame | None = None,
                     preset: Preset = Preset()) -> DataFrame:
    """F8: model features straight from nested requests.

    The transactions are exploded (S4) and go through the same single-pass
    feature aggregate as the batch build; the request's diagnosis date is the
    index time.  The provider's diagnosis total comes from ``provider_totals``
    (physician_id, phys_total_dx) when given, else the default of 50.
    """
    fact, index, _ = requests_to_fact(requests)
    idx = index.select("patient_id", F.col("diagnosis_dt").alias("diseasex_dt"))
    hist = entity_history_features(fact, idx, FactColumns(), preset)
    base = requests.select("patient_id", F.col("diagnosis_date").alias("diseasex_dt"), "birth_year", "gender",
                           F.col("physician_info.physician_id").alias("physician_id"),
                           F.col("physician_info.state").alias("physician_state"),
                           F.col("physician_info.physician_type").alias("physician_type"))
    out = base.join(hist, ["patient_id"], "left").fillna(
        {c: 0 for c in hist.columns if c not in ("patient_id", "symptom_onset_dt")})
    if provider_totals is not None:
        out = out.join(provider_totals.select("physician_id", "phys_total_dx"), ["physician_id"], "left")
    else:
        out = out.withColumn("phys_total_dx", F.lit(None).cast("long"))
    days = F.greatest(S.day_diff("diseasex_dt", "symptom_onset_dt"), F.lit(0))
    total = F.coalesce(F.col("phys_total_dx"), F.lit(DEFAULT_PROVIDER_TOTAL))
    risk_cols = [g.lower() for g in preset.risk_groups]
    return out.withColumns({
        "patient_age": (F.year("diseasex_dt") - F.col("birth_year")).cast("int"),
        "risk_num": S.count_flags(risk_cols),
        "dx_season": S.season("diseasex_dt"),
        "symptom_to_diagnosis_days": days,
        "diagnosis_within_5days_flag": S.within_days(days, preset.window_days),
        "phys_total_dx": total,
        "phys_experience_level": S.band(total, preset.experience, C.EXPERIENCE_DEFAULT),
    }).withColumn("risk_age_flag", S.flag_ge("patient_age", preset.high_risk_age))


# L24 ------------------------------------------------------------------------
def decide_alerts(scored: DataFrame, cutoff: float = C.ALERT_PROBABILITY_CUTOFF,
                  prediction: str = "prediction", probability: str = "probability",
                  meets: str = "meets_criteria") -> DataFrame:
    """Alert = model predicts 1, probability >= cutoff, and the rules are met
    (missing eligibility counts as not eligible); reasons as an array."""
    met = F.coalesce(F.col(meets), F.lit(False))
    p1 = F.col(prediction) == 1
    hi = F.col(probability) >= cutoff
    return scored.withColumns({
        "alert_recommended": p1 & hi & met,
        "alert_reasons": F.array_compact(F.array(
            F.when(~p1, F.lit("model predicts no missed prescription")),
            F.when(p1 & ~hi, F.lit(f"probability below {cutoff}")),
            F.when(~met, F.lit("clinical criteria not met")))),
    })


# L25 ------------------------------------------------------------------------
def score_summary(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count(F.lit(1)).alias("total"),
                       F.sum(F.col("alert_recommended").cast("int")).alias("alerts"),
                       F.sum(F.col("meets_criteria").cast("int")).alias("eligible"))


# P23 / F10 ------------------------------------------------------------------------
def record_risk(records: DataFrame, comorbidities: str = "comorbidities", symptoms: str = "symptoms",
                age: str = "age") -> DataFrame:
    """Risk score, level and alert flag of assembled patient records."""
    score = S.record_risk_score(age, comorbidities, symptoms)
    return records.withColumns({"risk_score": score, "risk_level": S.record_risk_level(score),
                                "has_alert": S.record_alert(age, comorbidities, symptoms)})


def form_risk(forms: DataFrame, comorbidities: str = "comorbidities", symptoms: str = "symptoms",
              age: str = "age", contraindication: str | None = "contraindicationLevel") -> DataFrame:
    score = S.form_risk_score(comorbidities, symptoms, age, contraindication)
    return forms.withColumns({"risk_score": score, "risk_level": S.form_risk_level(score),
                              "has_alert": S.form_alert(score, age, comorbidities)})


def recent_cohort(fact: DataFrame, patients: DataFrame, as_of: str, days: int = C.RECENT_DAYS,
                  fc: FactColumns = FactColumns()) -> DataFrame:
    """patients with an event that names one of the cohort keywords (any case)
    in the last ``days`` - in all history when no patient has a recent one -
    assembled into one record each (J9) with their distinct conditions and
    symptoms, latest transaction (W2) and record risk (P23), which is scored on
    the full lists.  Patients without a dimension row are skipped."""
    from vigilo.operators.joins import assemble_records
    t = F.lit(as_of).cast(fact.schema[fc.ts].dataType)
    recent = (F.col(fc.ts) >= t - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(fc.ts) <= t)
    named = fact.filter(F.upper(F.col(fc.desc)).rlike("|".join(C.COHORT_KEYWORDS))).select(
        F.col(fc.patient).alias("patient_id"), F.coalesce(recent, F.lit(False)).alias("_recent"))
    any_recent = F.coalesce(named.agg(F.max("_recent")).scalar(), F.lit(False))
    ids = named.filter(F.col("_recent") | ~any_recent).select("patient_id").distinct()
    events = fact.select(F.col(fc.patient).alias("patient_id"), fc.ts, fc.type,
                         F.when(F.col(fc.desc) != C.INDEX_CODE, F.col(fc.desc)).alias("_desc")) \
        .join(ids, ["patient_id"], "left_semi")
    ents = patients.select("patient_id", (F.lit(int(str(as_of)[:4])) - F.col("birth_year")).alias("age"))
    rec = assemble_records(ents, events, "patient_id", "_desc", fc.type, ["CONDITIONS", "SYMPTOMS"])
    last = events.groupBy("patient_id").agg(F.max(fc.ts).alias("last_transaction_dt"))
    rec = rec.withColumnsRenamed({"conditions": "comorbidities", "symptoms": "symptoms"}).join(last, ["patient_id"])
    return record_risk(rec)


# F11 ------------------------------------------------------------------------
def visit_attributes(fact: DataFrame, fc: FactColumns = FactColumns(), attrs: Sequence[str] = ()) -> DataFrame:
    """Visit attributes from the index event, else from the first event."""
    cols = list(attrs)
    first = F.min(F.struct(F.col(fc.ts).isNull().alias("_undated"), F.col(fc.ts), *[F.col(c) for c in cols]))
    first_any = fact.groupBy(fc.patient).agg(first.alias("_f"))
    first_dx = fact.filter(F.col(fc.desc) == C.INDEX_CODE).groupBy(fc.patient).agg(first.alias("_i"))
    j = first_any.join(first_dx, [fc.patient], "left")
    pick = F.coalesce(F.col("_i"), F.col("_f"))
    return j.select(fc.patient, pick[fc.ts].alias("visit_dt"), *[pick[c].alias(c) for c in cols])


# P27 ------------------------------------------------------------------------
def documents_to_events(docs: DataFrame, id_col: str = "id", date_col: str = "diagnosisDate") -> DataFrame:
    """Patient documents' arrays to event rows; a DISEASE_X row is added only
    when the document has no CONDITIONS row of its own."""
    ts = F.try_to_timestamp(F.col(date_col))
    cond = docs.select(F.col(id_col).alias("patient_id"), ts.alias("txn_dt"),
                       F.lit("CONDITIONS").alias("txn_type"), F.explode("comorbidities").alias("txn_desc"))
    sym = docs.select(F.col(id_col).alias("patient_id"), ts.alias("txn_dt"),
                      F.lit("SYMPTOMS").alias("txn_type"), F.explode("symptoms").alias("txn_desc"))
    fallback = docs.filter(F.coalesce(F.size("comorbidities"), F.lit(0)) == 0).select(
        F.col(id_col).alias("patient_id"), ts.alias("txn_dt"), F.lit("CONDITIONS").alias("txn_type"),
        F.lit(C.INDEX_CODE).alias("txn_desc"))
    return cond.unionByName(sym).unionByName(fallback)
