"""Composed cleaning plans for dimension and fact tables.

Each plan is one lazy chain of column expressions and filters; the only
shuffles are the de-duplication (a partial aggregate) and the final sort.
The cleaning report (Q9) is observed by the pass that writes the cleaned rows
(:func:`write_cleaned`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vigilo.functions import scalar as S
from vigilo.operators.windows import dedupe
from vigilo.presets import clinical as C


def as_of_year(as_of: str) -> int:
    return int(str(as_of)[:4])


# F1 -------------------------------------------------------------------------
def clean_patients(df: DataFrame, as_of: str, id_col: str = "patient_id",
                   birth_col: str = "birth_year", gender_col: str = "gender",
                   order: tuple[str, ...] | None = None, sort: bool = True) -> DataFrame:
    """Birth year range to -1, gender normalised, de-duplicated, then invalid ids dropped."""
    out = df.withColumns({
        birth_col: S.range_to_sentinel(birth_col, C.PATIENT_BIRTH_YEAR_MIN, as_of_year(as_of)).cast("int"),
        gender_col: S.map_values(S.normalize_blank(gender_col), C.GENDER_MAP, "Unknown"),
    })
    out = dedupe(out, [id_col], list(order or [c for c in df.columns if c != id_col]))
    out = S.filter_valid_ids(out, id_col)
    return out.orderBy(id_col) if sort else out


# F2 -------------------------------------------------------------------------
def clean_physicians(df: DataFrame, id_col: str = "physician_id", birth_col: str = "birth_year",
                     state_col: str = "state", type_col: str = "physician_type",
                     gender_col: str | None = None, sort: bool = True) -> DataFrame:
    lo, hi = C.PHYSICIAN_BIRTH_YEAR_RANGE
    cols = {
        birth_col: S.range_to_sentinel(birth_col, lo, hi).cast("double"),
        state_col: S.standardize_case(S.normalize_blank(state_col), "upper"),
        type_col: S.title_case(S.normalize_blank(type_col)),
    }
    if gender_col:
        cols[gender_col] = S.map_values(S.normalize_blank(gender_col), C.GENDER_MAP, "Unknown")
    out = df.withColumns(cols)
    out = dedupe(out, [id_col], [c for c in out.columns if c != id_col])
    out = S.filter_valid_ids(out, id_col)
    return out.orderBy(id_col) if sort else out


# F3 -------------------------------------------------------------------------
def clean_transactions(df: DataFrame, as_of: str, ts_col: str = "txn_dt",
                       patient_col: str = "patient_id", physician_col: str = "physician_id",
                       type_col: str = "txn_type", desc_col: str = "txn_desc",
                       sort: bool = True) -> DataFrame:
    """Dates coerced (invalid kept as null) and clamped, ids filled and checked,
    text normalised; the id filter runs before whole-row de-duplication."""
    out = df.withColumns({
        ts_col: S.coerce_ts(ts_col, as_of),
        physician_col: S.fill_cast(physician_col, -1),
        type_col: S.standardize_case(S.normalize_blank(type_col), "upper"),
        desc_col: S.standardize_case(S.normalize_blank(desc_col), "upper"),
    })
    out = out.filter(S.valid_id(patient_col) & S.valid_id(physician_col, allow=[-1]))
    out = dedupe(out)
    return out.orderBy(patient_col, ts_col) if sort else out


def _count_exprs(as_of: str, ts_col: str, patient_col: str, physician_col: str) -> list[Column]:
    parsed = S.coerce_ts(ts_col, as_of)
    phys = S.fill_cast(physician_col, -1)
    rules = {
        "invalid_dates": F.col(ts_col).isNotNull() & parsed.isNull(),
        "future_dates": S.coerce_ts(ts_col, "9999-12-31") > F.lit(as_of).cast("timestamp"),
        "filled_physician_ids": F.col(physician_col).isNull(),
        "invalid_patient_ids": ~S.valid_id(patient_col),
        "invalid_physician_ids": ~S.valid_id(phys, allow=[-1]),
    }
    return [F.count(F.lit(1)).alias("initial_rows"),
            *[F.sum(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in rules.items()]]


def write_cleaned(df: DataFrame, as_of: str, path: str, ts_col: str = "txn_dt", patient_col: str = "patient_id",
                  physician_col: str = "physician_id", **columns) -> DataFrame:
    """Q9: clean the fact rows (F3), write them to ``path`` and report what was met on the way.

    The rule counts are observed on the raw rows and the final count on the
    cleaned ones by the pass that writes them: no second scan.
    """
    met, left = Observation(), Observation()
    raw = df.observe(met, *_count_exprs(as_of, ts_col, patient_col, physician_col))
    clean_transactions(raw, as_of, ts_col, patient_col, physician_col, sort=False, **columns) \
        .observe(left, F.count(F.lit(1)).alias("final_rows")).write.parquet(path)
    seen = {**met.get, **left.get}
    # An empty table has no sums.
    return df.sparkSession.createDataFrame([tuple(v or 0 for v in seen.values())],
                                           ", ".join(f"{name} long" for name in seen))
