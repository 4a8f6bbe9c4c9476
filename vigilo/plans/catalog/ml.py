"""Registered queries: ML preparation (with oracles) and training (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilo.operators import ml as ML
from vigilo.operators import neighbours as NB
from vigilo.plans.catalog.core import RAW_PATIENTS_SQL, raw_patients
from vigilo.plans.catalog.features import model_ready_features
from vigilo.plans.registry import register
from vigilo.sources.tables import table

SEED = 42
NUMERIC = ["patient_age", "risk_num", "risk_age_flag", "sym_count_5d", "prior_contra_lvl",
           "symptom_to_diagnosis_days", "diagnosis_within_5days_flag", "phys_total_dx",
           "risk_immuno", "risk_cvd", "risk_diabetes", "risk_obesity"]
CATEGORICAL = ["patient_gender", "phys_experience_level", "physician_state", "physician_type", "dx_season"]


def _embedding_long(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select("label", F.posexplode("embedding").alias("feature", "value")) \
        .withColumn("value", F.col("value").cast("double"))


EMB_LONG_SQL = """SELECT label, CAST(g.i AS INTEGER) AS feature, CAST(embedding[g.i + 1] AS DOUBLE) AS value
  FROM embeddings, range(0, 64) g(i) WHERE g.i < len(embedding)"""


# ---- L5 -----------------------------------------------------------------------------
def split_q(spark, sf):
    out = ML.stratified_split(table(spark, sf, "labels"), "quality", "doc_id", 0.2, SEED)
    return out.select("doc_id", "quality", "is_test")


register("stratified_split", ops=("L5",), sql=f"""
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}')) AS pos,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, pos <= round(n * 0.2) AS is_test FROM r""")(split_q)


# ---- L7 -----------------------------------------------------------------------------
def class_weight_q(spark, sf):
    lab = table(spark, sf, "labels")
    w = ML.with_class_weight(lab, "quality").groupBy("quality").agg(F.first("weight").alias("weight"))
    return w.withColumn("pos_weight", ML.positive_weight(lab, "quality").scalar())


register("class_weight", ops=("L7",), sql="""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight,
       (SELECT sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)
        FROM labels) AS pos_weight
FROM c""")(class_weight_q)


# ---- L8 / L9 ------------------------------------------------------------------------
def anova_q(spark, sf):
    top = ML.select_k_best(ML.anova_f(_embedding_long(spark, sf), "label"), 10)
    return top.select("feature", F.round("f_score", 4).alias("f_score"))


register("anova_select", ops=("L8", "O2"), sql=f"""
WITH l AS ({EMB_LONG_SQL}),
per AS (SELECT feature, label, count(value) AS n, sum(value) AS s, sum(value * value) AS ss FROM l GROUP BY 1, 2),
tot AS (SELECT feature, sum(n) AS nn, sum(s) AS ss_, count(*) AS c FROM per GROUP BY 1),
f AS (SELECT per.feature,
             sum(n * (s / n - ss_ / nn) * (s / n - ss_ / nn)) / (any_value(c) - 1)
               / (sum(ss - s * s / n) / (any_value(nn) - any_value(c))) AS f_score
      FROM per JOIN tot USING (feature) GROUP BY 1)
SELECT feature, round(f_score, 4) AS f_score FROM f ORDER BY f_score DESC, feature LIMIT 10""")(anova_q)


def mutual_info_q(spark, sf):
    mi = ML.mutual_info_binned(_embedding_long(spark, sf), "label", bins=10)
    return mi.select("feature", F.round("mutual_info", 6).alias("mutual_info"))


register("mutual_info", ops=("L9",), sql=f"""
WITH l AS ({EMB_LONG_SQL}),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1),
b AS (SELECT l.feature, l.label,
             CAST(CASE WHEN (hi - lo) / 10 > 0 THEN least(floor((value - lo) / ((hi - lo) / 10)), 9) ELSE 0 END AS INT)
               AS bin
      FROM l JOIN r USING (feature)),
j AS (SELECT feature, bin, label, count(*) AS nxy FROM b GROUP BY 1, 2, 3),
x AS (SELECT feature, bin, sum(nxy) AS nx FROM j GROUP BY 1, 2),
y AS (SELECT feature, label, sum(nxy) AS ny FROM j GROUP BY 1, 2),
n AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY 1)
SELECT j.feature, round(sum((nxy / n) * ln(nxy * n / (nx * ny))), 6) AS mutual_info
FROM j JOIN x USING (feature, bin) JOIN y USING (feature, label) JOIN n USING (feature)
GROUP BY 1""")(mutual_info_q)


# ---- L1 / L2 / L4 ----------------------------------------------------------------------
def impute_q(spark, sf):
    return ML.fit_imputer(raw_patients(spark, sf), ["birth_year"], ["gender", "segment"])


register("impute_values", ops=("L1", "A8"), sql=f"""
WITH r AS ({RAW_PATIENTS_SQL}),
m AS (SELECT 'gender' AS "column", gender AS v, count(*) AS n FROM r WHERE gender IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'segment', segment, count(*) FROM r WHERE segment IS NOT NULL GROUP BY 2)
SELECT 'birth_year' AS "column", 'numeric' AS kind,
       CAST(quantile_cont(CAST(birth_year AS DOUBLE), 0.5) AS VARCHAR) AS fill FROM r
UNION ALL
SELECT "column", 'categorical', arg_min(v, (-n, v)) FROM m GROUP BY 1""")(impute_q)


def encoding_q(spark, sf):
    return ML.fit_encoder(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


register("label_encoding", ops=("L2", "L3"), sql="""
WITH l AS (SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
           UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders)
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INT) AS code
FROM l WHERE value IS NOT NULL""")(encoding_q)


def scaler_q(spark, sf):
    return ML.fit_scaler(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


register("standardize_stats", ops=("L4",), sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS std FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))(scaler_q)


# ---- L11-L16, L21, L26, L27 (no SQL oracle) -------------------------------------------------
def model_training(spark, sf):
    feats = model_ready_features(spark, sf)
    return ML.train_and_evaluate(feats, NUMERIC, CATEGORICAL, "target", "patient_id", seed=SEED)


register("model_training", ops=("L1", "L2", "L4", "L5", "L7", "L11", "L12", "L13", "L14", "L15", "L16",
                                "L21", "L23", "L26", "L27"))(model_training)


def _prepared(spark, sf):
    feats = model_ready_features(spark, sf).checkpoint(eager=True)
    split, tr = ML.prepare_split(feats, "target", "patient_id", 0.2, SEED)
    codes = ML.fit_encoder(tr, CATEGORICAL).checkpoint(eager=True)
    prep = ML.apply_encoder(ML.apply_imputer(split, ML.fit_imputer(tr, NUMERIC, CATEGORICAL)), codes, CATEGORICAL)
    return ML.spread(prep.withColumn("target", F.col("target").cast("double")))


# ---- J13 / L6 ---------------------------------------------------------------------
def minority_neighbours_q(spark, sf):
    train = _prepared(spark, sf).filter(~F.col("is_test"))
    return NB.minority_neighbours(train, "target", "patient_id", NUMERIC + CATEGORICAL)


def oversample_q(spark, sf):
    train = _prepared(spark, sf).filter(~F.col("is_test"))
    return NB.oversample(train, "target", "patient_id", NUMERIC + CATEGORICAL, seed=SEED)


def _rare_class_sql() -> str:
    """CTEs up to ``p``: nearest rows of every rare training row, and ``m``: those rows with their turn."""
    from vigilo.plans.catalog.features import _features_sql
    feats = NUMERIC + CATEGORICAL
    fill = ", ".join(f"CAST(trunc(quantile_cont(CAST({c} AS DOUBLE), 0.5)) AS BIGINT) AS {c}" for c in NUMERIC)
    nums = ", ".join(f"CAST(coalesce(tr.{c}, fill.{c}) AS DOUBLE) AS {c}" for c in NUMERIC)
    codes = ", ".join(f"CAST(dense_rank() OVER (ORDER BY tr.{c}) - 1 AS DOUBLE) AS {c}" for c in CATEGORICAL)
    squares = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in feats)
    return f"""
WITH f AS ({_features_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(CAST(patient_id AS VARCHAR) || ':{SEED}')) AS pos,
             count(*) OVER (PARTITION BY target) AS n FROM f),
tr AS (SELECT * FROM r WHERE pos > round(n * 0.2)),
fill AS (SELECT {fill} FROM tr),
x AS (SELECT patient_id, target, {nums}, {codes} FROM tr, fill),
c AS (SELECT target, count(*) AS rows_, (SELECT max(k) FROM (SELECT count(*) AS k FROM tr GROUP BY target)) AS most
      FROM tr GROUP BY target),
rare AS (SELECT target, rows_, CAST(floor(most * {NB.TARGET_RATIO}) AS BIGINT) - rows_ AS more FROM c
         WHERE most > {NB.LEAST_IMBALANCE} * rows_ AND floor(most * {NB.TARGET_RATIO}) > rows_
           AND rows_ = (SELECT min(rows_) FROM c)),
m AS (SELECT x.*, rare.rows_, rare.more,
             row_number() OVER (ORDER BY md5(CAST(patient_id AS VARCHAR) || ':{SEED}')) AS turn
      FROM x JOIN rare USING (target)),
p AS (SELECT * FROM (
        SELECT a.patient_id, b.patient_id AS neighbour, {squares} AS distance2,
               CAST(row_number() OVER (PARTITION BY a.patient_id ORDER BY {squares}, b.patient_id) AS INT) AS rank
        FROM m a JOIN m b ON a.patient_id <> b.patient_id) WHERE rank <= {NB.NEIGHBOURS})"""


def _oversample_sql() -> str:
    made = ", ".join(f"x.{c} + weight * (y.{c} - x.{c}) AS {c}" for c in NUMERIC + CATEGORICAL)
    return _rare_class_sql() + f""",
t AS (SELECT patient_id, rows_, unnest(range(1, more // rows_ + CAST(turn <= more % rows_ AS BIGINT) + 1)) AS copy
      FROM m),
h AS (SELECT *, md5(patient_id || ':' || copy || ':{SEED}') AS h FROM t),
d AS (SELECT patient_id, CAST(copy AS INT) AS copy,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) % least({NB.NEIGHBOURS}, rows_ - 1) + 1 AS pick,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0 AS weight FROM h)
SELECT d.patient_id, d.copy, p.neighbour, d.weight, {made}, CAST(x.target AS DOUBLE) AS target
FROM d JOIN p ON p.patient_id = d.patient_id AND p.rank = d.pick
       JOIN m x ON x.patient_id = d.patient_id JOIN m y ON y.patient_id = p.neighbour"""


register("minority_neighbours", ops=("J13",),
         sql=_rare_class_sql() + " SELECT patient_id, rank, neighbour, distance2 FROM p")(minority_neighbours_q)
register("oversample", ops=("L6", "J13"), sql=_oversample_sql())(oversample_q)


def feature_importance_q(spark, sf):
    prep = _prepared(spark, sf)
    model = ML.train("random_forest", prep.filter(~F.col("is_test")), NUMERIC + CATEGORICAL, "target", SEED)
    return ML.feature_importance(model, NUMERIC + CATEGORICAL)


register("feature_importance", ops=("L12", "L20"))(feature_importance_q)


def cross_validation_q(spark, sf):
    prep = _prepared(spark, sf)
    res = ML.cross_validate("logistic_regression", prep, NUMERIC + CATEGORICAL, "target", "patient_id", k=5,
                            seed=SEED)
    return spark.createDataFrame([(res["metric"], res["mean"], res["std"])], "metric string, mean double, std double")


register("cross_validation", ops=("L17",))(cross_validation_q)


# Four boosted-tree parameters, every combination by five folds.
GRID = {"maxDepth": [2, 4], "stepSize": [0.05, 0.2], "subsamplingRate": [0.7, 1.0], "columnShare": [0.7, 1.0]}
GRID_TREES = 2
DRAWS = 9
BUDGETS = (2, 6)


def grid_search_q(spark, sf):
    grid = [{**p, "maxIter": GRID_TREES} for p in ML.parameter_grid(GRID)]
    res = ML.grid_search("gradient_boosting", _prepared(spark, sf), NUMERIC + CATEGORICAL, "target", "patient_id",
                         grid, k=5, seed=SEED)
    return spark.createDataFrame(
        [(i + 1, p["maxDepth"], p["stepSize"], p["subsamplingRate"], p["columnShare"], r["mean"], r["std"])
         for i, r in enumerate(res) for p in [r["params"]]],
        "rank int, max_depth int, learning_rate double, subsample double, column_share double, mean_pr_auc double, "
        "std_pr_auc double")


register("grid_search", ops=("L18", "L17"))(grid_search_q)


def hyperparameter_search_q(spark, sf):
    res = ML.successive_halving("gradient_boosting", _prepared(spark, sf), NUMERIC + CATEGORICAL, "target",
                                "patient_id", n=DRAWS, budgets=BUDGETS, k=5, seed=SEED)
    return spark.createDataFrame(
        [(r["draw"], r["round"], r["budget"], p["stepSize"], p["maxDepth"], p["subsamplingRate"], p["columnShare"],
          p["minInstancesPerNode"], p["totalGain"], r["mean"], r["std"]) for r in res for p in [r["params"]]],
        "draw int, round int, trees int, learning_rate double, max_depth int, subsample double, column_share double, "
        "least_rows int, total_gain double, mean_pr_auc double, std_pr_auc double")


register("hyperparameter_search", ops=("L19", "L17"))(hyperparameter_search_q)


# ---- S11 + L10 + P19 + P20 + P8 + P21 + P24 + X4: the model input table -----------------------
# --- fixed values: columns that leak the label or identify rows -------------------
LEAKAGE = ["phys_treat_rate_all", "patient_id", "physician_id", "diseasex_dt", "symptom_onset_dt"]
# --- end fixed values ----------------------------------------------------------------


def feature_dictionary(spark, sf):
    """The dictionary of the model-ready table, derived from its schema: model
    features 'Yes', the label 'Yes (Target)', everything else 'No'."""
    from vigilo.plans.features import FEATURE_ORDER
    feats = model_ready_features(spark, sf)
    kinds = {f.name: f.dataType.simpleString() for f in feats.schema.fields}
    rows = [(c, {"bigint": "int", "int": "int", "double": "float", "string": "category"}.get(kinds[c], "date"),
             "Yes (Target)" if c == "target" else ("Yes" if c in NUMERIC + CATEGORICAL else "No"))
            for c in FEATURE_ORDER]
    return spark.createDataFrame(rows, "Variable string, Type string, `Included in Model` string")


def model_input_table(spark, sf):
    import uuid
    from vigilo.functions import scalar as S
    from vigilo.operators.ordering import missing_share, schema_diff
    from vigilo.session import scratch_dir
    from vigilo.sources import tables as TB
    path = scratch_dir(spark, f"dictionary-{uuid.uuid4().hex[:8]}")
    TB.write_table(feature_dictionary(spark, sf).coalesce(1), path, "csv")
    dictionary = TB.load_feature_dictionary(spark, path, "csv")                      # S11
    chosen = ML.production_features(dictionary, LEAKAGE)                              # L10
    rows = chosen.select("Variable", "Type").collect()   # one row per column: metadata
    order = [r["Variable"] for r in rows]
    feats = model_ready_features(spark, sf)
    missing = schema_diff(feats, order)["missing"]                                    # X4
    if missing:
        raise ValueError(f"model-ready table lacks {missing}")
    aligned = S.align_columns(feats, order, always=["dx_season"])                     # P20
    typed = S.coerce_by_dictionary(aligned, {r["Variable"]: r["Type"] for r in rows})  # P19
    typed = typed.withColumn("target_inverted", S.invert_label("target"))             # P21
    out = S.round_cols(typed, 4)                                                      # P24
    return S.project(out, upper=True)                                                 # P8


def _model_input_sql() -> str:
    from vigilo.plans.catalog.features import _features_sql
    casts = {c: "BIGINT" for c in NUMERIC}
    cols = [f"CAST({c} AS {casts[c]}) AS {c.upper()}" for c in NUMERIC] + \
        [f"CAST({c} AS VARCHAR) AS {c.upper()}" for c in CATEGORICAL] + \
        ["CAST(target AS BIGINT) AS TARGET", "1 - CAST(target AS BIGINT) AS TARGET_INVERTED"]
    return f"WITH f AS ({_features_sql()}) SELECT {', '.join(cols)} FROM f"


register("model_input_table", ops=("S11", "L10", "P19", "P20", "P8", "P21", "P24", "X4", "S5"),
         sql=_model_input_sql())(model_input_table)


# ---- A20 + S10 ----------------------------------------------------------------------------
# --- fixed values: feature categories by name fragment (a feature may fall in two) ---
IMPORTANCE_CATEGORIES = {"symptom": ["sym_", "symptom"], "risk": ["risk"], "physician": ["phys"],
                         "demographic": ["patient_", "dx_season"], "contraindication": ["contra"]}
# --- end fixed values ----------------------------------------------------------------


def importance_summary_q(spark, sf):
    """Mean importance over two tree models (the random forest goes through a
    save/load round trip, S10) and totals per feature category (A20)."""
    import uuid
    from pyspark.ml import PipelineModel
    from vigilo.operators.aggregates import importance_summary
    from vigilo.session import scratch_dir
    from vigilo.sources.tables import load_model, save_model
    prep = _prepared(spark, sf)
    tr = prep.filter(~F.col("is_test"))
    feats = NUMERIC + CATEGORICAL
    path = scratch_dir(spark, f"models-{uuid.uuid4().hex[:8]}")
    save_model(ML.train("random_forest", tr, feats, "target", SEED), path, "rf-1", {"seed": SEED})
    rf = load_model(path, PipelineModel)
    gbt = ML.train("xgboost", tr, feats, "target", SEED)
    imp = ML.feature_importance(rf, feats).withColumn("model", F.lit("random_forest")).unionByName(
        ML.feature_importance(gbt, feats).withColumn("model", F.lit("xgboost")))
    cats = spark.createDataFrame([(cat, f) for cat, frags in IMPORTANCE_CATEGORIES.items() for f in feats
                                  if any(x in f for x in frags)], "category string, feature string")
    return importance_summary(imp, "feature", "importance", cats)


register("importance_summary", ops=("A20", "L20", "S10"))(importance_summary_q)
