"""Registered queries: data-quality profiles and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilo.operators import quality as Q
from vigilo.plans.catalog.core import (RAW_PATIENTS_SQL, RAW_PHYSICIANS_SQL, raw_patients,
                                       raw_physicians)
from vigilo.plans.registry import register
from vigilo.presets import clinical as C
from vigilo.presets import driver as D
from vigilo.sources.tables import table

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
LINE_PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---- SQL text generators (oracle side) --------------------------------------
def _long_sql(src: str, cols, cast: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {src}" for c in cols)


def validity_sql(src: str, cols) -> str:
    return f"""
l AS ({_long_sql(src, cols)}),
s AS (SELECT "column", count(*) AS _rows, count(DISTINCT value) AS unique_values, min(value) AS min,
             max(value) AS max, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3
      FROM l GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM s),
o AS (SELECT l."column", sum(CASE WHEN value < lower_fence OR value > upper_fence THEN 1 ELSE 0 END) AS outliers
      FROM l JOIN f USING ("column") GROUP BY 1),
v AS (SELECT f."column", unique_values, round(unique_values * 100.0 / _rows, 2) AS unique_percentage,
             min, max, mean, median, std, q1, q3, lower_fence, upper_fence, CAST(outliers AS BIGINT) AS outliers,
             round(outliers * 100.0 / _rows, 2) AS outliers_percentage
      FROM f JOIN o USING ("column"))"""


def _grade_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {cut} THEN '{g}'" for cut, g in C.QUALITY_GRADES)
    return f"CASE {parts} ELSE '{C.QUALITY_GRADE_DEFAULT}' END"


def score_sql(src_sql: str, cols, num_cols, str_cols, strict: bool, name: str) -> str:
    k = len(cols)
    missing = " + ".join(f"(count(*) - count({c}))" for c in cols)
    ws = D.WS_SQL
    val = "0"
    pre = f"src AS ({src_sql})"
    if num_cols:
        pre += "," + validity_sql("src", num_cols)
        val = "(SELECT coalesce(sum(CASE WHEN outliers_percentage > 10 THEN 1 ELSE 0 END), 0) FROM v)"
    pen = "0"
    if strict and str_cols:
        pre += f""",
sl AS ({_long_sql('src', str_cols, 'VARCHAR')}),
cs AS (SELECT "column",
              sum(CASE WHEN value IS NOT NULL AND trim(value, {ws}) <> value THEN 1 ELSE 0 END) AS ws_rows,
              count(DISTINCT value) AS dv, count(DISTINCT lower(value)) AS dl FROM sl GROUP BY 1)"""
        pen = ("(SELECT coalesce(sum(CASE WHEN ws_rows > 0 THEN 5 ELSE 0 END + "
               "CASE WHEN dv < 100 AND dl < dv THEN 5 ELSE 0 END), 0) FROM cs)")
    return f"""
WITH {pre},
comp AS (SELECT round(CASE WHEN count(*) > 0 THEN (count(*) * {k} - ({missing})) * 100.0 / (count(*) * {k})
                      ELSE 0 END, 2) AS c FROM src),
dup AS (SELECT round(CASE WHEN count(*) > 0 THEN (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)))
                     * 100.0 / count(*) ELSE 0 END, 2) AS d FROM src),
sc AS (SELECT (SELECT c FROM comp) AS cs_, greatest(0.0, 100 - (SELECT d FROM dup) - {pen}) AS ns_,
              greatest(0.0, 100 - {val} * 10.0) AS vs_)
SELECT '{name}' AS table_name, round(cs_, 2) AS completeness_score, round(ns_, 2) AS consistency_score,
       round(vs_, 2) AS validity_score, round(cs_ * 0.4 + ns_ * 0.3 + vs_ * 0.3, 2) AS overall_score,
       {_grade_sql('(cs_ * 0.4 + ns_ * 0.3 + vs_ * 0.3)')} AS quality_grade
FROM sc"""


# ---- Q1 -----------------------------------------------------------------------
def completeness_q(spark, sf):
    return Q.completeness(raw_patients(spark, sf))


_PAT_COLS = ["patient_id", "birth_year", "gender", "segment"]
register("quality_completeness", ops=("Q1",), sql=f"""
WITH r AS ({RAW_PATIENTS_SQL}), n AS (SELECT count(*) AS total FROM r),
z AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM r" for c in _PAT_COLS)})
SELECT "column", total AS total_records, total - null_count AS non_null_count, null_count,
       round(CASE WHEN total > 0 THEN null_count * 100.0 / total ELSE 0 END, 2) AS null_percentage,
       round(100 - CASE WHEN total > 0 THEN null_count * 100.0 / total ELSE 0 END, 2) AS completeness
FROM z, n""")(completeness_q)


# ---- Q2 -----------------------------------------------------------------------
def validity_q(spark, sf):
    return Q.validity(table(spark, sf, "lineitem"), LINE_PROFILE)


register("quality_validity", ops=("Q2", "A6"), sql=f"""
WITH {validity_sql('lineitem', LINE_PROFILE)}
SELECT * FROM v""")(validity_q)


def top_values_q(spark, sf):
    return Q.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


register("quality_top_values", ops=("Q2", "A8"), sql="""
WITH l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
           UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM c)
SELECT "column", value AS most_common_value, n AS most_common_count FROM r WHERE rn = 1""")(top_values_q)


# ---- Q3 -----------------------------------------------------------------------
def consistency_q(spark, sf):
    return Q.consistency(raw_physicians(spark, sf), ["state", "physician_type"])


register("quality_consistency", ops=("Q3",), sql=f"""
WITH r AS ({RAW_PHYSICIANS_SQL}),
l AS (SELECT 'state' AS "column", state AS value FROM r
      UNION ALL SELECT 'physician_type', physician_type FROM r),
g AS (SELECT "column",
             CAST(sum(CASE WHEN value IS NOT NULL AND trim(value, {D.WS_SQL}) <> value THEN 1 ELSE 0 END) AS BIGINT)
               AS whitespace_rows,
             count(DISTINCT value) AS distinct_values, count(DISTINCT lower(value)) AS distinct_lower,
             count(value) AS non_null
      FROM l GROUP BY 1)
SELECT "column", whitespace_rows, distinct_values, distinct_lower,
       (distinct_values < 100 AND distinct_lower < distinct_values) AS mixed_case,
       CAST(CASE WHEN distinct_values < 100 AND distinct_lower < distinct_values THEN non_null ELSE 0 END AS BIGINT)
         AS mixed_case_rows
FROM g""")(consistency_q)


# ---- Q4 -----------------------------------------------------------------------
def accuracy_q(spark, sf):
    pats = raw_patients(spark, sf).withColumn("age", F.lit(D.AS_OF_YEAR) - F.col("birth_year"))
    return Q.accuracy_rules(pats, D.AS_OF_YEAR)


register("quality_accuracy", ops=("Q4",), sql=f"""
WITH r AS (SELECT *, {D.AS_OF_YEAR} - birth_year AS age FROM ({RAW_PATIENTS_SQL})),
z AS (
  SELECT 'birth_year' AS "column", 'Year should be between 1900 and {D.AS_OF_YEAR}' AS rule,
         CAST(sum(CASE WHEN birth_year < 1900 OR birth_year > {D.AS_OF_YEAR} THEN 1 ELSE 0 END) AS BIGINT) AS violations
  FROM r
  UNION ALL
  SELECT 'age', 'Age should be between 0 and 120',
         CAST(sum(CASE WHEN age < 0 OR age > 120 THEN 1 ELSE 0 END) AS BIGINT) FROM r)
SELECT * FROM z WHERE violations > 0""")(accuracy_q)


# ---- Q5 -----------------------------------------------------------------------
def timeliness_q(spark, sf):
    out = Q.timeliness(table(spark, sf, "orders"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("earliest", "latest")})


register("quality_timeliness", ops=("Q5", "P12"), sql="""
SELECT 'o_orderdate' AS "column", min(o_orderdate) AS earliest, max(o_orderdate) AS latest,
       CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0) AS BIGINT)
         AS date_range_days
FROM orders""")(timeliness_q)


# ---- Q6 / Q7 / Q8 ---------------------------------------------------------------
_PHYS_COLS = ["physician_id", "state", "physician_type", "birth_year"]


def _scores(spark, sf):
    pats = Q.quality_score(raw_patients(spark, sf), table_name="patients")
    phys = Q.quality_score(raw_physicians(spark, sf), strict=True, table_name="physicians")
    line = Q.quality_score(table(spark, sf, "lineitem"), table_name="lineitem")
    return pats.unionByName(phys).unionByName(line)


def _scores_sql():
    line_cols = LINE_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"]
    return " UNION ALL ".join([
        f"({score_sql(RAW_PATIENTS_SQL, _PAT_COLS, ['patient_id', 'birth_year'], ['gender', 'segment'], False, 'patients')})",
        f"({score_sql(RAW_PHYSICIANS_SQL, _PHYS_COLS, ['physician_id', 'birth_year'], ['state', 'physician_type'], True, 'physicians')})",
        f"({score_sql('SELECT * FROM lineitem', line_cols, LINE_NUM, ['l_returnflag', 'l_linestatus'], False, 'lineitem')})",
    ])


register("quality_scores", ops=("Q6", "Q7", "Q1", "Q2", "Q3", "A9", "P15"), sql=_scores_sql())(_scores)


def quality_summary_q(spark, sf):
    return Q.quality_summary(_scores(spark, sf))


register("quality_summary", ops=("Q8", "X3"), sql=f"""
WITH s AS ({_scores_sql()}),
per AS (SELECT *, CASE WHEN overall_score < 80 THEN array_to_string(list_filter([
            CASE WHEN completeness_score < 90 THEN 'Review missing data' END,
            CASE WHEN consistency_score < 90 THEN 'Check for duplicates and format issues' END,
            CASE WHEN validity_score < 90 THEN 'Review outliers and data ranges' END], lambda x: x IS NOT NULL), '; ')
          ELSE '' END AS recommendations FROM s),
a AS (SELECT 'ALL' AS table_name, round(avg(completeness_score), 2) AS completeness_score,
             round(avg(consistency_score), 2) AS consistency_score, round(avg(validity_score), 2) AS validity_score,
             round(avg(overall_score), 2) AS overall_score FROM s)
SELECT table_name, completeness_score, consistency_score, validity_score, overall_score, quality_grade,
       recommendations FROM per
UNION ALL
SELECT table_name, completeness_score, consistency_score, validity_score, overall_score,
       {_grade_sql('overall_score')} AS quality_grade, '' AS recommendations FROM a""")(quality_summary_q)


# ---- Q11 / Q12 --------------------------------------------------------------------
def validate_dataset_q(spark, sf):
    return Q.validate_dataset(table(spark, sf, "labels"), "quality")


register("validate_dataset", ops=("Q11", "A9", "A15"), sql="""
SELECT count(DISTINCT quality) >= 2 AS valid,
       CASE WHEN count(DISTINCT quality) < 2 THEN 'fewer than two classes' ELSE 'ok' END AS reason,
       count(DISTINCT quality) AS n_classes, count(*) AS rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) AS duplicates
FROM labels""")(validate_dataset_q)


def _coverage_periods(spark, sf):
    orders = table(spark, sf, "orders")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= cut)


COVERAGE_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


def category_coverage_q(spark, sf):
    train, test = _coverage_periods(spark, sf)
    return Q.category_coverage(train, test, COVERAGE_COLS)


def _coverage_long_sql(src: str) -> str:
    return ("SELECT DISTINCT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {src}" for c in COVERAGE_COLS)
        + ") WHERE value IS NOT NULL")


COVERAGE_SQL = f"""tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
te AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
ltr AS ({_coverage_long_sql('tr')}),
lte AS ({_coverage_long_sql('te')})"""

register("category_coverage", ops=("Q12", "X2"), sql=f"""
WITH {COVERAGE_SQL},
j AS (SELECT lte."column", lte.value, ltr.value IS NOT NULL AS seen FROM lte
      LEFT JOIN ltr ON lte."column" = ltr."column" AND lte.value = ltr.value)
SELECT "column", count(*) AS n_test_values, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS n_seen,
       count(*) - CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown,
       sum(CASE WHEN seen THEN 1 ELSE 0 END) / count(*) AS coverage,
       sum(CASE WHEN seen THEN 1 ELSE 0 END) = count(*) AS valid
FROM j GROUP BY 1""")(category_coverage_q)


def unknown_categories_q(spark, sf):
    train, test = _coverage_periods(spark, sf)
    return Q.unknown_categories(train, test, COVERAGE_COLS)


register("unknown_categories", ops=("Q12", "X1"), sql=f"""
WITH {COVERAGE_SQL}
SELECT "column", value FROM lte
WHERE NOT EXISTS (SELECT 1 FROM ltr WHERE ltr."column" = lte."column" AND ltr.value = lte.value)""")(
    unknown_categories_q)
