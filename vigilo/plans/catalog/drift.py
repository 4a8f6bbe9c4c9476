"""Registered queries: distribution drift between two periods of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilo.operators import drift as DR
from vigilo.plans.registry import register
from vigilo.presets import clinical as C
from vigilo.sources.tables import table

SPLIT = "1998-06-01 00:00:00"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
DERIVED = {"ship_day": "strftime(l_shipdate, '%Y-%m-%d')"}     # a category with thousands of values


def periods(spark, sf):
    li = table(spark, sf, "lineitem")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return li.filter(F.col("l_shipdate") < cut), li.filter(F.col("l_shipdate") >= cut)


PERIODS_SQL = f"""ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT}'),
new AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT}')"""


def _ks_sql(x: str) -> str:
    return (f"CASE WHEN {x} < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, "
            f"{DR.KS_TERMS + 1}), lambda k: 2 * pow(-1.0, k - 1) * exp(-2 * k * k * {x} * {x}))), 0.0), 1.0) END")


def ks_sql(cols=NUMERIC) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {side} AS side FROM {src}"
        for c in cols for side, src in ((0, "ref"), (1, "new")))
    return f"""{PERIODS_SQL},
l AS ({long}),
c AS (SELECT feature, value, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS n_ref,
             sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS n_new FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT feature, CAST(sum(n_ref) AS DOUBLE) AS tot_ref, CAST(sum(n_new) AS DOUBLE) AS tot_new
      FROM c GROUP BY 1),
w AS (SELECT c.feature, c.value, t.tot_ref, t.tot_new,
             sum(n_ref) OVER (PARTITION BY c.feature ORDER BY value ROWS UNBOUNDED PRECEDING) / tot_ref AS cdf_ref,
             sum(n_new) OVER (PARTITION BY c.feature ORDER BY value ROWS UNBOUNDED PRECEDING) / tot_new AS cdf_new,
             lead(value) OVER (PARTITION BY c.feature ORDER BY value) AS nxt
      FROM c JOIN t USING (feature)),
a AS (SELECT feature, max(abs(cdf_ref - cdf_new)) AS ks_statistic,
             sum(CASE WHEN nxt IS NOT NULL THEN abs(cdf_ref - cdf_new) * (nxt - value) ELSE 0.0 END) AS wasserstein,
             max(value) - min(value) AS rng, any_value(tot_ref) AS n_ref, any_value(tot_new) AS n_new
      FROM w GROUP BY 1),
b AS (SELECT *, ks_statistic * sqrt(n_ref * n_new / (n_ref + n_new)) AS x FROM a),
ks AS (SELECT feature, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_new AS BIGINT) AS n_new, ks_statistic,
              {_ks_sql('x')} AS p_value,
              CASE WHEN rng > 0 THEN wasserstein / rng ELSE 0.0 END AS wasserstein_normalized FROM b)"""


def _band_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {cut} THEN '{s}'" for cut, s in C.DRIFT_SEVERITY) + \
        f" ELSE '{C.DRIFT_SEVERITY_DEFAULT}' END"


def chi2_sql(cols=CATEGORICAL) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({DERIVED.get(c, c)} AS VARCHAR) AS category, {side} AS side FROM {src}"
        for c in cols for side, src in ((0, "ref"), (1, "new")))
    return f"""{PERIODS_SQL},
cl AS ({long}),
cells AS (SELECT feature, category, CAST(sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS o_ref,
                 CAST(sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS o_new
          FROM cl WHERE category IS NOT NULL GROUP BY 1, 2),
mg AS (SELECT feature, sum(o_ref) AS n_ref, sum(o_new) AS n_new, count(*) AS k FROM cells GROUP BY 1),
e AS (SELECT cells.*, n_ref, n_new, k, (o_ref + o_new) * n_ref / (n_ref + n_new) AS e_ref,
             (o_ref + o_new) * n_new / (n_ref + n_new) AS e_new FROM cells JOIN mg USING (feature)),
d AS (SELECT *, CASE WHEN k = 2 THEN greatest(abs(o_ref - e_ref) - 0.5, 0.0) ELSE abs(o_ref - e_ref) END AS d_ref,
             CASE WHEN k = 2 THEN greatest(abs(o_new - e_new) - 0.5, 0.0) ELSE abs(o_new - e_new) END AS d_new
      FROM e),
st AS (SELECT feature, sum(CASE WHEN e_ref > 0 THEN d_ref * d_ref / e_ref ELSE 0.0 END
                           + CASE WHEN e_new > 0 THEN d_new * d_new / e_new ELSE 0.0 END) AS chi2,
              CAST(any_value(k) - 1 AS INT) AS dof, CAST(any_value(n_ref) AS BIGINT) AS n_ref,
              CAST(any_value(n_new) AS BIGINT) AS n_new FROM d GROUP BY 1),
-- Lower tail as the series of the incomplete gamma function; far in the upper tail a bound decides (p < 0.001).
far AS (SELECT *, chi2 >= dof + 2 * sqrt(8.0 * dof) + 16 AS is_far FROM st),
tail AS (SELECT feature, sum(exp(-x + (a + i) * ln(x) - lgamma(a + i + 1))) AS below
         FROM (SELECT feature, chi2 / 2 AS x, dof / 2.0 AS a, unnest(range(0, 20000)) AS i
               FROM far WHERE chi2 > 0 AND dof > 0 AND NOT is_far) GROUP BY 1),
ch AS (SELECT feature, chi2, dof, n_ref, n_new, chi2 / (n_ref + n_new) AS drift_score,
              dof > 0 AND (is_far OR 1 - coalesce(below, 0) < {C.DRIFT_P_VALUE}) AS drift_detected,
              {_band_sql('chi2 / (n_ref + n_new)')} AS severity FROM far LEFT JOIN tail USING (feature))"""


# ---- D3 + D4 + W6 -----------------------------------------------------------------
def ks_drift_q(spark, sf):
    ref, new = periods(spark, sf)
    return DR.ks_drift(ref, new, NUMERIC)


register("ks_drift", ops=("D3", "D4", "W6"), sql=f"WITH {ks_sql()} SELECT * FROM ks")(ks_drift_q)


# ---- D2 + J11 -----------------------------------------------------------------------
def chi2_drift_q(spark, sf):
    ref, new = periods(spark, sf)
    return DR.chi2_drift(ref, new, CATEGORICAL, with_p=False)


register("chi2_drift", ops=("D2", "J11"), sql=f"WITH {chi2_sql()} SELECT * FROM ch")(chi2_drift_q)


# ---- D6 + D8 --------------------------------------------------------------------------
def _detected(spark, sf):
    ref, new = periods(spark, sf)
    return DR.detect_drift(ref, new, NUMERIC, CATEGORICAL)


def detect_drift_q(spark, sf):
    return _detected(spark, sf).select("feature", "test_method", "test_statistic", "drift_score", "severity")


def detect_sql(numeric=NUMERIC, categorical=CATEGORICAL) -> str:
    return f"""{ks_sql(numeric)},
{chi2_sql(categorical).split(',', 2)[2].lstrip()},
dd AS (
  SELECT feature, 'ks_test' AS test_method, ks_statistic AS test_statistic, ks_statistic AS drift_score,
         {_band_sql('ks_statistic')} AS severity
  FROM ks WHERE p_value < {C.DRIFT_P_VALUE} AND (SELECT count(*) FROM new) >= 100
  UNION ALL
  SELECT feature, 'chi2_test', chi2, drift_score, severity FROM ch
  WHERE drift_detected AND (SELECT count(*) FROM new) >= 100)"""


DETECT_SQL = detect_sql()

register("detect_drift", ops=("D6", "D2", "D3"), sql=f"WITH {DETECT_SQL} SELECT * FROM dd")(detect_drift_q)


# ---- D6 with D1: every feature by the test that its reference profile asks for, many categories included ----
ROUTED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_partkey", "ship_day"]
ROUTED_NUMERIC = ["l_extendedprice"]     # the only one whose values rarely repeat


def detect_drift_routed(spark, sf):
    ref, new = (p.withColumn("ship_day", F.date_format("l_shipdate", "yyyy-MM-dd")) for p in periods(spark, sf))
    numeric, categorical = DR.route_by_profile(DR.reference_profile(ref.select(*ROUTED)))
    return DR.detect_drift(ref, new, numeric, categorical).select(
        "feature", "test_method", "test_statistic", "drift_score", "severity")


register("detect_drift_routed", ops=("D6", "D1", "D2", "D3"),
         sql=f"WITH {detect_sql(ROUTED_NUMERIC, [c for c in ROUTED if c not in ROUTED_NUMERIC])} SELECT * FROM dd")(
    detect_drift_routed)



def drift_summary_q(spark, sf):
    return DR.drift_summary(_detected(spark, sf), len(NUMERIC) + len(CATEGORICAL))


register("drift_summary", ops=("D8",), sql=f"""
WITH {DETECT_SQL}
SELECT {len(NUMERIC) + len(CATEGORICAL)} AS features_checked, count(*) AS features_drifted,
       {", ".join(f"CAST(coalesce(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS severity_{s}"
                  for s in C.SEVERITY_ORDER)},
       arg_max(feature, (drift_score, feature)) AS most_drifted_feature, max(drift_score) AS max_drift_score,
       coalesce(array_to_string(list_sort(list(DISTINCT feature)), ','), '') AS drifted_features
FROM dd""")(drift_summary_q)


# ---- D7 ---------------------------------------------------------------------------------
def compare_distributions_q(spark, sf):
    ref, new = periods(spark, sf)
    out = DR.compare_distributions(ref, new, NUMERIC)
    return out.select("feature", *[F.round(c, 4).alias(c) for c in out.columns if c != "feature"])


def _cmp_sql() -> str:
    def stats(src, p):
        return " UNION ALL ".join(
            f"SELECT '{c}' AS feature, avg({c}) AS {p}mean, stddev_samp({c}) AS {p}std, "
            f"CAST(min({c}) AS DOUBLE) AS {p}min, CAST(max({c}) AS DOUBLE) AS {p}max FROM {src}" for c in NUMERIC)
    cols = ["ref_mean", "ref_std", "ref_min", "ref_max", "new_mean", "new_std", "new_min", "new_max"]
    diffs = []
    for s in ("mean", "std", "min", "max"):
        diffs.append(f"round(new_{s} - ref_{s}, 4) AS {s}_diff")
        diffs.append(f"round(CASE WHEN ref_{s} <> 0 THEN (new_{s} - ref_{s}) / abs(ref_{s}) * 100 ELSE 0.0 END, 4)"
                     f" AS {s}_pct_diff")
    return f"""WITH {PERIODS_SQL}, a AS ({stats('ref', 'ref_')}), b AS ({stats('new', 'new_')})
SELECT feature, {", ".join(f"round({c}, 4) AS {c}" for c in cols)}, {", ".join(diffs)}
FROM a FULL OUTER JOIN b USING (feature)"""


register("compare_distributions", ops=("D7", "A6"), sql=_cmp_sql())(compare_distributions_q)


# ---- D1 / D5 (no SQL oracle: maps and a fitted projection) -------------------------------
def reference_profile_q(spark, sf):
    """D1 profile, saved and read back (S9; replacing it is D9's overwrite)."""
    import uuid
    from vigilo.session import scratch_dir
    from vigilo.sources.tables import load_profile, save_profile
    ref, _ = periods(spark, sf)
    path = scratch_dir(spark, f"profile-{uuid.uuid4().hex[:8]}")
    save_profile(DR.reference_profile(ref.select(*NUMERIC, *CATEGORICAL)), path)
    return load_profile(spark, path)


def _profile_sql() -> str:
    cols = NUMERIC + CATEGORICAL
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM ref" for c in cols)
    nums = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max FROM ref" for c in NUMERIC)
    num_list = ", ".join(f"'{c}'" for c in NUMERIC)
    return f"""WITH {PERIODS_SQL},
l AS ({long}),
c AS (SELECT feature, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
p AS (SELECT feature, sum(count) AS count, count(*) AS n_distinct FROM c GROUP BY 1),
s AS ({nums})
SELECT p.feature, CAST(p.count AS BIGINT) AS count, p.n_distinct,
       CASE WHEN p.feature IN ({num_list}) AND p.n_distinct / p.count >= {C.CATEGORICAL_DISTINCT_SHARE}
            THEN 'numeric' ELSE 'categorical' END AS kind,
       s.mean, s.std, s.min, s.max
FROM p LEFT JOIN s USING (feature)"""


register("reference_profile", ops=("D1", "S9", "D9"), sql=_profile_sql())(reference_profile_q)


def profile_value_counts_q(spark, sf):
    ref, _ = periods(spark, sf)
    return DR.profile_value_counts(ref, CATEGORICAL)


register("profile_value_counts", ops=("D1", "A7"), sql=f"""
WITH {PERIODS_SQL},
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM ref" for c in CATEGORICAL)})
SELECT feature, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2""")(profile_value_counts_q)


def pca_drift_q(spark, sf):
    ref, new = periods(spark, sf)
    return DR.pca_drift(ref, new, NUMERIC)


register("pca_drift", ops=("D5",))(pca_drift_q)
