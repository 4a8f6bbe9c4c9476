"""Distribution drift between a reference and a new dataset.

Numeric features are unpivoted once into ``(feature, value, side)`` and the
two empirical CDFs are built with a distributed prefix sum per feature
(:func:`vigilo.operators.windows.ecdf_pair`), so all features run in parallel
and no feature's values are gathered into one task.  KS statistic and
Wasserstein-1 distance then come from one aggregate over the ECDF table.
Categorical features become an aligned contingency table (J11) and a
chi-square statistic from its margins.

p-values: the KS p-value is the asymptotic Kolmogorov series (documented
difference: the scipy default switches to an exact method for small samples);
the chi-square p-value is the regularised upper incomplete gamma function,
evaluated by a vectorised pandas UDF on the one-row-per-feature result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilo.functions import scalar as S
from vigilo.operators.aggregates import unpivot_numeric
from vigilo.operators.windows import ecdf_pair
from vigilo.presets import clinical as C

KS_TERMS = 100


# ---- numeric helpers (pure functions, used inside pandas UDFs) ----------------
def _gammainc_lower_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    n = a
    while True:
        n += 1.0
        term *= x / n
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gammaincc_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in count(1):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(stat: float, dof: float) -> float:
    """Survival function of the chi-square distribution (regularised Q(dof/2, stat/2))."""
    if stat is None or dof is None or (isinstance(stat, float) and math.isnan(stat)):
        return float("nan")
    if dof <= 0:
        return 1.0
    a, x = dof / 2.0, stat / 2.0
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return max(0.0, 1.0 - _gammainc_lower_series(a, x))
    return min(1.0, _gammaincc_cf(a, x))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(s), float(d)) if pd.notna(s) and pd.notna(d) else float("nan")
                      for s, d in zip(stat, dof)])


def kolmogorov_sf(x: Column) -> Column:
    """Asymptotic two-sample KS p-value for x = D * sqrt(n1 n2 / (n1 + n2))."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
                         lambda acc, k: acc + 2 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def severity(score: Column) -> Column:
    return S.band(score, C.DRIFT_SEVERITY, C.DRIFT_SEVERITY_DEFAULT)


def _two_sided(ref: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    a = unpivot_numeric(ref, cols).withColumn("side", F.lit(0))
    b = unpivot_numeric(new, cols).withColumn("side", F.lit(1))
    return a.unionByName(b)


# D3 + D4 ------------------------------------------------------------------------
def ks_drift(ref: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per numeric feature: KS statistic, asymptotic p, range-normalised Wasserstein-1."""
    ecdf = ecdf_pair(_two_sided(ref, new, cols), "feature", "value", "side")
    gap = F.abs(F.col("cdf_ref") - F.col("cdf_new"))
    per = ecdf.groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"),
        F.sum(F.when(F.col("_next").isNotNull(), gap * (F.col("_next") - F.col("value")))
              .otherwise(F.lit(0.0))).alias("wasserstein"),
        (F.max("value") - F.min("value")).alias("_range"),
        F.first("tot_ref").alias("n_ref"), F.first("tot_new").alias("n_new"))
    en = F.col("n_ref") * F.col("n_new") / (F.col("n_ref") + F.col("n_new"))
    x = F.col("ks_statistic") * F.sqrt(en)
    out = per.withColumn("_x", x)
    return out.select(
        "feature", F.col("n_ref").cast("long").alias("n_ref"), F.col("n_new").cast("long").alias("n_new"),
        "ks_statistic", kolmogorov_sf(F.col("_x")).alias("p_value"),
        F.when(F.col("_range") > 0, F.col("wasserstein") / F.col("_range")).otherwise(F.lit(0.0))
        .alias("wasserstein_normalized"))


# D2 -------------------------------------------------------------------------
def chi2_statistics(ref: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per categorical feature: chi-square with Yates' correction when dof = 1."""
    def longform(df, side):
        return (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
                .unpivot([], list(cols), "feature", "category")
                .filter(F.col("category").isNotNull()).withColumn("side", F.lit(side)))
    both = longform(ref, 0).unionByName(longform(new, 1))
    cells = both.groupBy("feature", "category").agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).cast("double").alias("o_ref"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).cast("double").alias("o_new"))
    margins = cells.groupBy("feature").agg(F.sum("o_ref").alias("n_ref"), F.sum("o_new").alias("n_new"),
                                           F.count(F.lit(1)).alias("k"))
    j = cells.join(F.broadcast(margins), ["feature"], "inner")   # one row per feature
    tot = F.col("o_ref") + F.col("o_new")
    n = F.col("n_ref") + F.col("n_new")
    e_ref, e_new = tot * F.col("n_ref") / n, tot * F.col("n_new") / n
    dof1 = F.col("k") == 2

    def term(o, e):
        d = F.abs(o - e)
        d = F.when(dof1, F.greatest(d - 0.5, F.lit(0.0))).otherwise(d)
        return F.when(e > 0, d * d / e).otherwise(F.lit(0.0))
    j = j.withColumn("_t", term(F.col("o_ref"), e_ref) + term(F.col("o_new"), e_new))
    return j.groupBy("feature").agg(
        F.sum("_t").alias("chi2"), (F.first("k") - 1).cast("int").alias("dof"),
        F.first("n_ref").cast("long").alias("n_ref"), F.first("n_new").cast("long").alias("n_new"))


def chi2_drift(ref: DataFrame, new: DataFrame, cols: Sequence[str], with_p: bool = True) -> DataFrame:
    st = chi2_statistics(ref, new, cols)
    st = st.withColumn("drift_score", F.col("chi2") / (F.col("n_ref") + F.col("n_new")))
    p = st.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof").cast("double")))
    st = p.withColumn("drift_detected", (F.col("dof") > 0) & (F.col("p_value") < C.DRIFT_P_VALUE))
    st = st.withColumn("severity", severity(F.col("drift_score")))
    return st if with_p else st.drop("p_value")


# D6 -------------------------------------------------------------------------
def detect_drift(ref: DataFrame, new: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                 min_new_rows: int = 100, max_features: int | None = None,
                 multivariate: Sequence[str] = ()) -> DataFrame:
    """All features with the source's gates; only drifted features are returned.
    ``multivariate`` names the columns of the principal-component check.

    With fewer than ``min_new_rows`` new rows the result is one row that says
    so.  ``max_features`` (off by default) checks the first features only.
    """
    feats = (list(numeric) + list(categorical))[:max_features]
    numeric = [c for c in numeric if c in feats]
    categorical = [c for c in categorical if c in feats]
    parts = []
    if numeric:
        ks = ks_drift(ref, new, numeric)
        parts.append(ks.select("feature", F.lit("ks_test").alias("test_method"),
                               F.col("ks_statistic").alias("test_statistic"), "p_value",
                               F.col("ks_statistic").alias("drift_score"),
                               (F.col("p_value") < C.DRIFT_P_VALUE).alias("drift_detected")))
    if categorical:
        ch = chi2_drift(ref, new, categorical)
        parts.append(ch.select("feature", F.lit("chi2_test").alias("test_method"),
                               F.col("chi2").alias("test_statistic"), "p_value", "drift_score",
                               "drift_detected"))
    if len(multivariate) > 1:
        pc = pca_drift(ref, new, multivariate)
        parts.append(pc.select("feature", F.lit("pca_ks").alias("test_method"), F.col("ks_statistic").alias("test_statistic"),
                               "p_value", F.col("ks_statistic").alias("drift_score"), "drift_detected"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    size = new.agg(F.count(F.lit(1)).alias("n"))
    too_few = size.filter(F.col("n") < min_new_rows).select(
        F.lit("*").alias("feature"), F.lit("too_few_rows").alias("test_method"),
        F.col("n").cast("double").alias("test_statistic"), F.lit(None).cast("double").alias("p_value"),
        F.lit(None).cast("double").alias("drift_score"), F.lit(False).alias("drift_detected"),
        F.lit(None).cast("string").alias("severity"))
    return (out.filter(F.col("drift_detected") & (size.scalar() >= min_new_rows))
            .withColumn("severity", severity(F.col("drift_score"))).unionByName(too_few))


def route_by_profile(profile: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical features of a reference profile (one row per column is read)."""
    kinds = {r["feature"]: r["kind"] for r in profile.select("feature", "kind").collect()}
    return tuple(sorted(f for f, k in kinds.items() if k == kind) for kind in ("numeric", "categorical"))


# D7 -------------------------------------------------------------------------
def compare_distributions(ref: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    def stats(df, prefix):
        long = unpivot_numeric(df, cols)
        v = F.col("value")
        return long.groupBy("feature").agg(F.avg(v).alias(prefix + "mean"), F.stddev_samp(v).alias(prefix + "std"),
                                           F.min(v).alias(prefix + "min"), F.max(v).alias(prefix + "max"))
    j = stats(ref, "ref_").join(stats(new, "new_"), ["feature"], "full_outer")
    out = j
    for s in ("mean", "std", "min", "max"):
        diff = F.col("new_" + s) - F.col("ref_" + s)
        out = out.withColumn(s + "_diff", diff).withColumn(
            s + "_pct_diff", F.when(F.col("ref_" + s) != 0, diff / F.abs(F.col("ref_" + s)) * 100).otherwise(0.0))
    return out


# D8 -------------------------------------------------------------------------
def drift_summary(results: DataFrame, checked: int) -> DataFrame:
    sev = [F.coalesce(F.sum(F.when(F.col("severity") == s, 1).otherwise(0)), F.lit(0)).cast("long")
           .alias("severity_" + s) for s in C.SEVERITY_ORDER]
    return results.agg(
        F.lit(checked).alias("features_checked"),
        F.count(F.lit(1)).alias("features_drifted"), *sev,
        F.max_by(F.col("feature"), F.struct(F.col("drift_score"), F.col("feature"))).alias("most_drifted_feature"),
        F.max("drift_score").alias("max_drift_score"),
        F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("drifted_features"))


# D1 -------------------------------------------------------------------------
def profile_value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, count) rows: the reference profile's value counts in
    long form, one row per distinct value (never one map per feature)."""
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "feature", "value"))
    return long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))


def reference_profile(df: DataFrame, cols: Sequence[str] | None = None,
                      categorical_share: float = C.CATEGORICAL_DISTINCT_SHARE) -> DataFrame:
    """Per column: kind (numeric, or categorical when distinct/count is below
    the share), count, distinct count, and mean/std/min/max for numerics.
    Label columns are excluded.  Value counts: :func:`profile_value_counts`."""
    from vigilo.operators.quality import numeric_columns
    cols = [c for c in (cols or df.columns) if c.lower() not in C.LABEL_COLUMNS]
    nums = set(numeric_columns(df))
    counts = profile_value_counts(df, cols)
    per = counts.groupBy("feature").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("n_distinct"))
    is_num = F.col("feature").isin(*nums) if nums else F.lit(False)
    kind = F.when(is_num & ((F.col("n_distinct") / F.col("count")) >= categorical_share), "numeric") \
        .otherwise("categorical")
    out = per.withColumn("kind", kind)
    num_cols = [c for c in cols if c in nums]
    if num_cols:
        num_stats = (unpivot_numeric(df, num_cols).groupBy("feature")
                     .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                          F.min("value").alias("min"), F.max("value").alias("max")))
        out = out.join(num_stats, ["feature"], "left")
    return out


# D5 -------------------------------------------------------------------------
def pca_drift(ref: DataFrame, new: DataFrame, cols: Sequence[str], min_rows: int = 10) -> DataFrame:
    """KS drift on the first principal component, fitted on the reference only, with
    its flag and severity; no row when a side has fewer than ``min_rows`` rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    cols = list(cols)
    if len(cols) < 2:
        raise ValueError("multivariate drift needs at least two columns")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="skip"),
                            StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
                            PCA(k=1, inputCol="_s", outputCol="_pc")])
    model = pipe.fit(ref.select(*cols))

    def pc(df):
        return model.transform(df.select(*cols)).select(vector_to_array("_pc")[0].alias("pc1"))
    out = ks_drift(pc(ref), pc(new), ["pc1"]).filter((F.col("n_ref") >= min_rows) & (F.col("n_new") >= min_rows))
    return out.withColumns({"feature": F.lit("multivariate_pc1"),
                            "drift_detected": F.col("p_value") < C.DRIFT_P_VALUE,
                            "severity": severity(F.col("ks_statistic"))})
