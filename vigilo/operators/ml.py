"""Machine-learning data work (L1-L23, L26, L27) on Spark ML.

Preprocessing is *fitted on training rows only* and applied as column
expressions (no per-row Python): medians and modes for imputation, sorted
category codes, mean and **population** standard deviation for scaling.  The
fitted statistics are one value per column; they travel as a small table or
scalar subqueries.  The split ranks rows per class by a seeded hash with a
distributed running count, so the same rows are chosen by any engine and no
class is sorted in one task.  Model fitting is Spark ML (distributed).
"""

from __future__ import annotations

import itertools
import math
import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators.aggregates import mode_of, unpivot_numeric
from vigilo.operators.evaluation import compare_models, evaluate
from vigilo.operators.ordered import exact_quantiles, prefix_sums
from vigilo.session import delete_dir, scratch_dir


# L1 -------------------------------------------------------------------------
def fit_imputer(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(column, kind, fill) with the exact median per numeric and the mode
    (smallest on ties) per categorical column, from training rows."""
    parts = []
    if numeric:
        med = exact_quantiles(unpivot_numeric(train, numeric, var="column"), ["column"], "value", [0.5])
        parts.append(med.select("column", F.lit("numeric").alias("kind"), F.col("value").cast("string").alias("fill")))
    if categorical:
        long = (train.select(*[F.col(c).cast("string").alias(c) for c in categorical])
                .unpivot([], list(categorical), "column", "value"))
        parts.append(mode_of(long, "value", ["column"]).select(
            "column", F.lit("categorical").alias("kind"), F.col("mode").alias("fill")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_imputer(df: DataFrame, fills: DataFrame) -> DataFrame:
    """Fill nulls from the fitted table (one row per column: read on the driver)."""
    values = {r["column"]: (r["kind"], r["fill"]) for r in fills.collect()}
    exprs = {}
    for c, (kind, v) in values.items():
        if v is None or c not in df.columns:
            continue
        lit = F.lit(float(v)).cast(df.schema[c].dataType) if kind == "numeric" else F.lit(v).cast(df.schema[c].dataType)
        exprs[c] = F.coalesce(F.col(c), lit)
    return df.withColumns(exprs)


# L2 / L3 ------------------------------------------------------------------------
def fit_encoder(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): codes follow the sorted order of training values."""
    long = (train.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "column", "value").filter(F.col("value").isNotNull())
            .distinct().withColumn("_one", F.lit(1)))
    ranked = prefix_sums(long, "value", ["_one"], ["column"])
    return ranked.select("column", "value", (F.col("cum__one") - 1).cast("int").alias("code"))


def apply_encoder(df: DataFrame, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each category by its code; unseen values get 0 (the first class)."""
    out = df
    for c in cols:
        m = codes.filter(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        # No hint: a vocabulary may be large (a provider id).  AQE broadcasts it
        # when its measured size allows, else a hot category is split as a skewed join.
        out = (out.join(m, out[c].cast("string") == F.col("_v"), "left")
               .withColumn(c, F.coalesce(F.col("_code"), F.lit(0))).drop("_v", "_code"))
    return out


# L4 -------------------------------------------------------------------------
def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = unpivot_numeric(train, cols, var="column")
    return long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    vals = {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in vals.items()})


# L5 -------------------------------------------------------------------------
def split_rank(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Per-class position of each row in the order of md5(id:seed)."""
    keyed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))) \
        .withColumn("_one", F.lit(1)).withColumn("_hn", F.conv(F.substring("_h", 1, 12), 16, 10).cast("double"))
    ranked = prefix_sums(keyed, "_hn", ["_one"], [label], tie=["_h"]).drop("_hn")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # One row per class: broadcast (a shuffle keyed on the label would put each
    # class in one task).
    return ranked.join(F.broadcast(sizes), [label], "left") \
        .withColumn("_pos", F.col("cum__one").cast("long")).drop("_one", "cum__one")


def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first round(n_class x fraction) rows of each class by hash."""
    r = split_rank(df, label, id_col, seed)
    n_test = F.round(F.col("_n") * F.lit(float(test_fraction)))
    return r.withColumn("is_test", F.col("_pos") <= n_test).drop("_h", "_n", "_pos")


def prepare_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                  seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The split, materialised once (it feeds several fitted transforms), and its training rows."""
    split = stratified_split(df, label, id_col, test_fraction, seed).checkpoint(eager=True)
    return split, split.filter(~F.col("is_test"))


def fold_column(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold id = per-class hash position modulo k."""
    r = split_rank(df, label, id_col, seed)
    return r.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_n", "_pos")


# L7 -------------------------------------------------------------------------
def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights: each class weighs n / (2 x n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = df.agg(F.count(F.lit(1))).scalar()
    n_cls = counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select(label, (total / (n_cls * F.col("_c"))).alias(name))
    return df.join(F.broadcast(w), [label], "left")   # one row per class


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """count(0) / count(1): the scale for the positive class."""
    return df.agg((F.sum(F.when(F.col(label) == 0, 1).otherwise(0)) /
                    F.sum(F.when(F.col(label) == 1, 1).otherwise(0))).alias("pos_weight"))


# L8 -------------------------------------------------------------------------
def anova_f(long: DataFrame, label: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """One-way ANOVA F per feature from grouped sums: F = (SSB/(c-1)) / (SSW/(n-c))."""
    per = long.groupBy(feature, label).agg(F.count(value).alias("n"), F.sum(value).alias("s"),
                                           F.sum(F.col(value) * F.col(value)).alias("ss"))
    tot = per.groupBy(feature).agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"),
                                   F.count(F.lit(1)).alias("c"))
    j = per.join(tot, [feature])
    mean_c = F.col("s") / F.col("n")
    grand = F.col("s_all") / F.col("n_all")
    parts = j.groupBy(feature).agg(
        F.sum(F.col("n") * (mean_c - grand) * (mean_c - grand)).alias("ssb"),
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("ssw"),
        F.first("n_all").alias("n_all"), F.first("c").alias("c"))
    return parts.select(feature, (F.col("ssb") / (F.col("c") - 1) / (F.col("ssw") / (F.col("n_all") - F.col("c"))))
                        .alias("f_score"))


def select_k_best(scores: DataFrame, k: int, score: str = "f_score", feature: str = "feature") -> DataFrame:
    """Top-k features (TakeOrderedAndProject; ties by feature name)."""
    return scores.orderBy(F.col(score).desc(), F.col(feature).asc()).limit(k)


# L9 -------------------------------------------------------------------------
def mutual_info_binned(long: DataFrame, label: str, bins: int = 10, feature: str = "feature",
                       value: str = "value") -> DataFrame:
    """Mutual information (nats) between equal-width bins of each feature and the label.

    Differs from the source's nearest-neighbour estimator by design (binned
    contingency); the ranking it gives is what the selection uses.
    """
    rng = long.groupBy(feature).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = long.join(F.broadcast(rng), [feature]).withColumn(   # one row per feature
        "_bin", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
        .otherwise(F.lit(0)).cast("int"))
    joint = b.groupBy(feature, "_bin", label).agg(F.count(F.lit(1)).alias("nxy"))
    nx = joint.groupBy(feature, "_bin").agg(F.sum("nxy").alias("nx"))
    ny = joint.groupBy(feature, label).agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy(feature).agg(F.sum("nxy").alias("n"))
    j = joint.join(nx, [feature, "_bin"]).join(ny, [feature, label]).join(n, [feature])
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy(feature).agg(F.sum(term).alias("mutual_info"))


# L10 ------------------------------------------------------------------------
INCLUDED = ("Yes", "Yes (Target)", "Yes (Engineered)")


def production_features(dictionary: DataFrame, leakage: Sequence[str] = ()) -> DataFrame:
    """Dictionary rows marked for the model, leakage columns removed."""
    d = dictionary.filter(F.btrim(F.col("Included in Model")).isin(*INCLUDED))
    return d.filter(~F.col("Variable").isin(*leakage)) if leakage else d


ROWS_PER_PART = 500_000
LEAST_PARTS = 4


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Training rows dealt to ``parts`` partitions by a hash of the row, sorted there and written once.

    Forests and boosted trees draw their samples per partition and row, so rows
    lie in the same place in every run and after every retry, however the input
    was cut.  The default is one partition per 500,000 rows and four at least:
    an optimizer step is a job of its own, whose tasks should be worth starting.
    """
    parts = parts or max(LEAST_PARTS, -(-df.count() // ROWS_PER_PART))
    return df.repartition(parts, F.xxhash64(*df.columns)).sortWithinPartitions(*df.columns).checkpoint(eager=True)


# L11-L15 ----------------------------------------------------------------------
def make_estimator(kind: str, features: str = "features", label: str = "label", weight: str | None = "weight",
                   seed: int = 42, params: Mapping | None = None, rows: int | None = None):
    """The Spark estimator of a model type.

    ``rows`` (training rows) turns ``totalGain`` of the boosted trees, a loss
    reduction summed over rows, into Spark's gain per row; without it no least
    gain is asked for.
    """
    p = dict(params or {})
    common = dict(featuresCol=features, labelCol=label)
    if kind == "logistic_regression":
        # L2 penalty; the source's C = 0.1 is a strong penalty.
        est = LogisticRegression(**common, regParam=p.get("regParam", 0.1), elasticNetParam=0.0,
                                 maxIter=p.get("maxIter", 2000))
    elif kind == "random_forest":
        est = RandomForestClassifier(**common, numTrees=p.get("numTrees", 50), maxDepth=p.get("maxDepth", 6),
                                     minInstancesPerNode=p.get("minInstancesPerNode", 15),
                                     featureSubsetStrategy="sqrt", seed=seed)
    elif kind in BOOSTED:
        # One Spark learner, two presets; only xgboost stops early, on a 20 %
        # hold-out of the training rows (VALIDATION_COL).
        preset = dict(BOOSTED_PRESETS["gradient_boosting" if kind == "gbt" else kind], **p)
        est = GBTClassifier(**common, maxIter=preset["maxIter"], maxDepth=preset["maxDepth"],
                            stepSize=preset["stepSize"], subsamplingRate=preset["subsamplingRate"],
                            featureSubsetStrategy=f"{preset.get('columnShare', 1.0):.6f}",
                            minInstancesPerNode=preset.get("minInstancesPerNode", 1),
                            minInfoGain=preset.get("totalGain", 0.0) / rows if rows else 0.0,
                            validationTol=preset.get("validationTol", 0.01), seed=seed)
        if kind in EARLY_STOPPING:
            est.setValidationIndicatorCol(VALIDATION_COL)
    elif kind == "naive_bayes":
        est = NaiveBayes(**common, modelType="gaussian")
    elif kind == "svm":
        est = LinearSVC(**common, regParam=p.get("regParam", 0.1), maxIter=p.get("maxIter", 100))
    else:
        raise ValueError(f"unknown model type {kind!r}")
    if weight and kind != "naive_bayes":
        est.setWeightCol(weight)
    return est


MODEL_TYPES = ("xgboost", "gradient_boosting", "random_forest", "logistic_regression", "svm", "naive_bayes")
BOOSTED = ("gbt", "gradient_boosting", "xgboost")
EARLY_STOPPING = ("xgboost",)
# --- fixed values: boosted-tree presets (trees, depth, learning rate, row and column shares, least rows, gain) ---
BOOSTED_PRESETS = {
    "xgboost": {"maxIter": 799, "maxDepth": 7, "stepSize": 0.2610570842357371,
                "subsamplingRate": 0.9130034518395074, "columnShare": 0.8549084927445061,
                "minInstancesPerNode": 3, "totalGain": 0.029685899839029244},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 1.0},
}
# --- end fixed values -------------------------------------------------------------
VALIDATION_COL = "_is_validation"


def with_validation_flag(df: DataFrame, features: Sequence[str], seed: int = 42, share: float = 0.2) -> DataFrame:
    """Repeatable hold-out flag from a hash of the row's features and the seed."""
    h = F.abs(F.xxhash64(*[F.col(c) for c in features], F.lit(seed))) % 1000
    return df.withColumn(VALIDATION_COL, h < int(share * 1000))


def assemble(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def fit_plain(est, rows: DataFrame):
    """The fitted model without its training summary.

    A summary holds the session, which cannot be sent to tasks once any query of
    the session has used an ``Observation``; scoring would fail with it.  Spark
    leaves it out of a stored model, so such a model is stored and read again.
    """
    model = est.fit(rows)
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_dir(rows.sparkSession, f"model-{uuid.uuid4().hex}")
    model.write().save(path)
    try:
        return type(model).load(path)
    finally:
        delete_dir(rows.sparkSession, path)


def train(kind: str, df: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42,
          params: Mapping | None = None) -> PipelineModel:
    data = with_class_weight(df, label) if kind != "naive_bayes" else df
    if kind == "svm":
        return calibrated_svm(data, features, label, seed, params)
    rows = None
    if kind in BOOSTED:
        rows = df.count()
    if kind in EARLY_STOPPING:
        data = with_validation_flag(data, features, seed)
    est = make_estimator(kind, label=label, seed=seed, params=params, rows=rows)
    asm = assemble(features)
    return PipelineModel([asm, fit_plain(est, asm.transform(data))])


PARALLEL_FITS = 8      # fits that the driver submits at a time; their tasks share the cluster
CALIBRATION_FOLDS = 3


def in_parallel(jobs: Sequence[Callable], parallelism: int = PARALLEL_FITS) -> list:
    """Results of driver-side calls that each run Spark jobs, in their order."""
    if not jobs:
        return []
    pool = ThreadPool(min(parallelism, len(jobs)))
    try:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs, chunksize=1)
    finally:
        pool.close()


def platt(margins: DataFrame, label: str, margin: str = "margin") -> LogisticRegressionModel:
    """P(class 1 | margin) by an unpenalised logistic fit.

    Targets are smoothed to (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), each row as a
    weighted pair of both classes, so that separable margins keep a finite slope.
    """
    n = {r[label]: r["n"] for r in margins.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    up, down = (n.get(1, 0) + 1) / (n.get(1, 0) + 2), 1 / (n.get(0, 0) + 2)
    share = F.when(F.col(label) == 1, F.lit(up)).otherwise(F.lit(down))
    pairs = margins.select(margin, F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), share.alias("w")),
        F.struct(F.lit(0.0).alias("y"), (1 - share).alias("w")))).alias("t")).select(margin, "t.y", "t.w")
    est = LogisticRegression(featuresCol=margin, labelCol="y", weightCol="w", regParam=0.0, maxIter=100,
                             predictionCol="calibrated", rawPredictionCol="calibrated_raw",
                             probabilityCol="probability")
    return fit_plain(est, pairs)


def calibrated_svm(data: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42,
                   params: Mapping | None = None, folds: int = CALIBRATION_FOLDS) -> PipelineModel:
    """A linear SVM whose ``probability`` is fitted on the margins of held-out folds.

    Folds come from a hash of the row's features; a fold without which a class
    would be missing is not held out.  ``data`` carries ``weight``;
    ``prediction`` stays the side of the plane.
    """
    asm = assemble(features)
    fold = F.pmod(F.xxhash64(*[F.col(c) for c in features], F.lit(seed)), F.lit(folds))
    rows = asm.transform(data).select("features", label, "weight", fold.alias("_fold")).checkpoint(eager=True)
    margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
    est = make_estimator("svm", label=label, seed=seed, params=params)

    def held_out(f: int) -> Callable:
        def job():
            model = fit_plain(est, rows.filter(F.col("_fold") != f))
            return margin.transform(model.transform(rows.filter(F.col("_fold") == f))).select("margin", label)
        return job

    counts = {(r["_fold"], r[label]): r["n"] for r in rows.groupBy("_fold", label)
              .agg(F.count(F.lit(1)).alias("n")).collect()}                    # folds x classes
    classes = {c for _, c in counts}
    present = [f for f in sorted({f for f, _ in counts}) if {c for g, c in counts if g != f} == classes]
    *parts, final = in_parallel([held_out(f) for f in present] + [lambda: fit_plain(est, rows)])
    # Without a fold that can be held out: the margins of the rows themselves.
    margins = reduce(DataFrame.unionByName, parts or [margin.transform(final.transform(rows)).select("margin", label)])
    return PipelineModel([asm, final, margin, platt(margins.checkpoint(eager=True), label)])


# L23 ------------------------------------------------------------------------
def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring: ``score`` = positive-class probability (raw margin where a model has none)."""
    out = model.transform(df)
    col = "probability" if "probability" in out.columns else "rawPrediction"
    # A model fitted on one class has a one-element probability vector: no score.
    return out.withColumn("score", F.try_element_at(vector_to_array(F.col(col)), F.lit(2))).withColumn(
        "prediction", F.col("prediction").cast("int"))


# L16 ------------------------------------------------------------------------
def evaluate_model(model: PipelineModel, test: DataFrame, label: str = "label") -> DataFrame:
    """Score the test rows once (three narrow columns, checkpointed: the
    metrics, the range sampling and the prefix pass all read them), then
    evaluate."""
    scored = score(model, test).select(label, "prediction", "score").checkpoint(eager=True)
    return evaluate(scored, label, "prediction", "score")


# L17 ------------------------------------------------------------------------
SCORED_AT_ONCE = 40    # fitted models whose held-out scores are written by one job


def fold_data(df: DataFrame, features: Sequence[str], label: str, id_col: str, k: int = 5,
              seed: int = 42) -> DataFrame:
    """Rows prepared once for any number of fits: features as a vector, label, fold and hold-out flag."""
    flagged = with_validation_flag(fold_column(df, label, id_col, k, seed), features, seed)
    return assemble(features).transform(spread(flagged)).select(
        "features", F.col(label).cast("double").alias("label"), "fold", VALIDATION_COL).checkpoint(eager=True)


def evaluate_folds(kind: str, folds: DataFrame, param_sets: Sequence[Mapping], seed: int = 42, metric: str = "pr_auc",
                   parallelism: int = PARALLEL_FITS) -> list[dict]:
    """``params, metric, mean, std, folds`` for every parameter set, in their order.

    All fits (sets x folds) run ``parallelism`` at a time over ``fold_data``
    rows; held-out scores of all models are evaluated together, by model and
    fold.  The standard deviation is that of the population; a fold without a
    value (one class only) is left out, and without any the mean is NaN.
    """
    counts = {(r["fold"], r["label"]): r["n"] for r in folds.groupBy("fold", "label")
              .agg(F.count(F.lit(1)).alias("n")).collect()}                    # folds x classes
    numbers = sorted({f for f, _ in counts})
    classes = sorted({c for _, c in counts})

    def fit(number: int, params: Mapping, fold: int) -> Callable:
        def job():
            sizes = {c: sum(n for (f, d), n in counts.items() if f != fold and d == c) for c in classes}
            total, present = sum(sizes.values()), [c for c in classes if sizes[c]]
            if not present:
                return None
            weight = F.lit(None).cast("double")
            for c in present:
                weight = F.when(F.col("label") == c, F.lit(total / (len(present) * sizes[c]))).otherwise(weight)
            rows = folds.filter(F.col("fold") != fold).withColumn("weight", weight)
            model = fit_plain(make_estimator(kind, seed=seed, params=params, rows=total), rows)
            return score(model, folds.filter(F.col("fold") == fold)).select(
                F.lit(number).alias("number"), "fold", "label", "prediction", "score")
        return job

    jobs = [fit(i, p, f) for i, p in enumerate(param_sets) for f in numbers]
    values: dict[int, list] = {i: [] for i in range(len(param_sets))}
    for at in range(0, len(jobs), SCORED_AT_ONCE):
        parts = [x for x in in_parallel(jobs[at:at + SCORED_AT_ONCE], parallelism) if x is not None]
        if not parts:
            continue
        scored = reduce(DataFrame.unionByName, parts).checkpoint(eager=True)
        for r in evaluate(scored, "label", "prediction", "score", ["number", "fold"]).collect():
            values[r["number"]].append((r["fold"], r[metric]))
    out = []
    for i, p in enumerate(param_sets):
        per = [v for _, v in sorted(values[i])]
        known = [v for v in per if v is not None]
        mean = sum(known) / len(known) if known else float("nan")
        std = math.sqrt(sum((v - mean) ** 2 for v in known) / len(known)) if known else float("nan")
        out.append({"params": dict(p), "metric": metric, "mean": mean, "std": std, "folds": per})
    return out


def cross_validate(kind: str, df: DataFrame, features: Sequence[str], label: str, id_col: str, k: int = 5,
                   seed: int = 42, params: Mapping | None = None, metric: str = "pr_auc") -> dict:
    """k stratified folds (hash-ranked); mean and population std of the metric."""
    return evaluate_folds(kind, fold_data(df, features, label, id_col, k, seed), [params or {}], seed, metric)[0]


# L18 / L19 ------------------------------------------------------------------------
def _best_first(results: Sequence[dict]) -> list[dict]:
    return sorted(results, key=lambda r: -r["mean"] if r["mean"] == r["mean"] else math.inf)


def parameter_grid(values: Mapping[str, Sequence]) -> list[dict]:
    """Every combination, names in sorted order, the last name running fastest."""
    names = sorted(values)
    return [dict(zip(names, v)) for v in itertools.product(*(values[n] for n in names))]


def grid_search(kind: str, df: DataFrame, features: Sequence[str], label: str, id_col: str,
                grid: Sequence[Mapping], k: int = 5, seed: int = 42) -> list[dict]:
    """Every parameter set by k-fold average precision; best first, ties in grid order."""
    return _best_first(evaluate_folds(kind, fold_data(df, features, label, id_col, k, seed), grid, seed))


# --- fixed values: search ranges of the boosted trees (low, high, scale) -------
SEARCH_SPACE = {
    "stepSize": (0.01, 0.3, "log"),
    "maxDepth": (3, 10, "int"),
    "subsamplingRate": (0.6, 1.0, "linear"),
    "columnShare": (0.6, 1.0, "linear"),
    "minInstancesPerNode": (1, 10, "int"),
    "totalGain": (0.0, 1.0, "linear"),
}
# --- end fixed values -----------------------------------------------------------


def draw(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """n seeded parameter sets from (low, high, scale) ranges."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for name, (lo, hi, scale) in space.items():
            if scale == "int":
                p[name] = rnd.randint(lo, hi)
            elif scale == "log":
                p[name] = math.exp(rnd.uniform(math.log(lo), math.log(hi)))
            else:
                p[name] = rnd.uniform(lo, hi)
        out.append(p)
    return out


def random_search(kind: str, df: DataFrame, features: Sequence[str], label: str, id_col: str,
                  space: Mapping[str, tuple] = SEARCH_SPACE, n: int = 100, k: int = 5, seed: int = 42) -> list[dict]:
    """Seeded draws, each by k folds; best first."""
    return grid_search(kind, df, features, label, id_col, draw(space, n, seed), k, seed)


def successive_halving(kind: str, df: DataFrame, features: Sequence[str], label: str, id_col: str,
                       space: Mapping[str, tuple] = SEARCH_SPACE, n: int = 100, budgets: Sequence[int] = (8, 32, 128),
                       resource: str = "maxIter", k: int = 5, seed: int = 42) -> list[dict]:
    """Draws that meet growing budgets of trees; those that fall behind leave early.

    Every draw is evaluated by k folds at the first budget, then the best part
    (as much fewer as the budget grows, one at least, ties to the earlier
    draw) at the next, so each round costs about the same.  Returns one record per draw and
    round: ``draw, round, budget, params, mean, std``, the last round first,
    best first in it.
    """
    folds = fold_data(df, features, label, id_col, k, seed)
    alive = list(enumerate(draw(space, n, seed)))
    rounds = []
    for number, budget in enumerate(budgets):
        res = evaluate_folds(kind, folds, [{**p, resource: budget} for _, p in alive], seed)
        ranked = _best_first([dict(r, draw=i, round=number, budget=budget) for (i, _), r in zip(alive, res)])
        rounds.append(ranked)
        if number + 1 < len(budgets):
            keep = max(1, len(alive) * budget // budgets[number + 1])
            best = {r["draw"] for r in ranked[:keep]}
            alive = [(i, p) for i, p in alive if i in best]
    return [r for ranked in reversed(rounds) for r in ranked]


# L20 ------------------------------------------------------------------------
def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame | None:
    est = model.stages[-1]
    spark = SparkSession.getActiveSession()
    if hasattr(est, "featureImportances"):
        imp = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficients"):
        imp = [abs(x) for x in est.coefficients.toArray().tolist()]
    else:
        return None
    rows = sorted(zip(features, imp), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance double")


# L26 / L27 --------------------------------------------------------------------------
def train_and_evaluate(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
                       id_col: str, kinds: Sequence[str] = MODEL_TYPES, test_fraction: float = 0.2,
                       seed: int = 42) -> DataFrame:
    """Split first, fit preprocessing on the training rows, train every model
    type, evaluate each on the test rows and rank them (L21).  A model that
    fails is reported with null metrics; the others continue."""
    spark = df.sparkSession
    # Cut the (possibly deep) input lineage once: reliable checkpoint in the
    # shared checkpoint folder, so model fitting never re-plans the input.
    df = df.checkpoint(eager=True)
    split, train_rows = prepare_split(df, label, id_col, test_fraction, seed)
    fills = fit_imputer(train_rows, numeric, categorical)
    codes = fit_encoder(train_rows, categorical).checkpoint(eager=True)   # read once per column
    prep = apply_encoder(apply_imputer(split, fills), codes, categorical)
    stats = fit_scaler(prep.filter(~F.col("is_test")), numeric)
    prep = apply_scaler(prep, stats).withColumn(label, F.col(label).cast("double"))
    # Reliable checkpoint (shared checkpoint dir): every model reads the same
    # prepared rows without recomputing the split and the fitted transforms.
    prep = spread(prep)
    features = list(numeric) + list(categorical)
    tr, te = prep.filter(~F.col("is_test")), prep.filter(F.col("is_test"))
    rows, failed = None, []
    for kind in kinds:
        try:
            m = evaluate_model(train(kind, tr, features, label, seed), te, label)
            m = m.withColumn("model", F.lit(kind))
        except Exception as exc:  # one failed model does not stop the rest
            failed.append(exc)
            if len(failed) == len(kinds):
                raise
            m = spark.createDataFrame([(kind, str(exc)[:200])], "model string, error string")
        rows = m if rows is None else rows.unionByName(m, allowMissingColumns=True)
    # One row per model: materialise before ranking reads it twice.
    return compare_models(rows.checkpoint(eager=True))
