"""Model evaluation tables without training.

Everything is grouped by a model (or any grouping) column, so many models are
evaluated in one pass over the scored rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.operators.aggregates import classification_metrics
from vigilo.operators.windows import rank_desc, roc_pr
from vigilo.presets import clinical as C


# L16 ------------------------------------------------------------------------
def evaluate(scored: DataFrame, label: str, prediction: str, score: str,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, rates, ROC AUC (average ranks) and step-sum PR AUC."""
    g = list(group_cols)
    m = classification_metrics(scored, label, prediction, g)
    curves = roc_pr(scored, label, score, g)
    if g:
        return m.join(curves, g, "left")
    return m.select("*", curves.select("roc_auc").scalar().alias("roc_auc"),
                    curves.select("pr_auc").scalar().alias("pr_auc"))


# L21 ------------------------------------------------------------------------
def compare_models(metrics: DataFrame, weights: Mapping[str, float] = C.RANKING_WEIGHTS) -> DataFrame:
    """Weighted composite score, competition rank (highest first)."""
    comp = None
    for m, w in weights.items():
        term = F.coalesce(F.col(m), F.lit(0.0)) * F.lit(w)
        comp = term if comp is None else comp + term
    scored = metrics.withColumn("composite_score", F.round(comp, 10))
    return rank_desc(scored, "composite_score", "rank")


# L22 ------------------------------------------------------------------------
def select_model(ranked: DataFrame, model_col: str, minima: Mapping[str, float],
                 strict: bool = True) -> DataFrame:
    """Models passing every minimum (``strict=False`` applies only the AUC minima,
    as the source did) and the best of them by composite score (first wins ties)."""
    applied = dict(minima) if strict else {k: v for k, v in minima.items() if k in ("pr_auc", "roc_auc")}
    ok = F.lit(True)
    for m, v in applied.items():
        ok = ok & (F.col(m) >= F.lit(v))
    passing = ranked.filter(ok)
    return passing.agg(
        F.count(F.lit(1)).alias("n_qualified"),
        # Best composite score; ties go to the first model name.
        F.min_by(F.col(model_col), F.struct(-F.col("composite_score"), F.col(model_col))).alias("selected_model"),
        F.max("composite_score").alias("selected_score"))


# L28 ------------------------------------------------------------------------
def selection_record(ranked: DataFrame, model_col: str, minima: Mapping[str, float], decided_at: str,
                     strict: bool = True) -> DataFrame:
    """The choice as a row to append: chosen model with its figures, number of models,
    minima in force and the criteria's order; no chosen model when none qualifies."""
    chosen = select_model(ranked, model_col, minima, strict)
    names = list(C.RANKING_WEIGHTS)
    best = ranked.select(F.col(model_col).alias("_m"), *names)
    out = chosen.join(best, F.col("selected_model") == F.col("_m"), "left").drop("_m")
    return out.withColumns({
        "n_models": ranked.agg(F.count(F.lit(1))).scalar(),
        "minima": F.lit(",".join(f"{k}>={v}" for k, v in minima.items())),
        "criteria": F.lit(",".join(f"{k}*{v}" for k, v in C.RANKING_WEIGHTS.items())),
        "decided_at": F.lit(decided_at).cast("timestamp_ntz")})
