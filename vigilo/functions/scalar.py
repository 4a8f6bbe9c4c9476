"""Column-level building blocks (cleaning, projection, banding, rules).

Every function returns a ``Column`` built from Spark's own expressions, so it
stays inside whole-stage code generation; none of them runs Python per row.
Column arguments accept a name or a ``Column``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.presets import clinical as C

ColumnOrName = Column | str

# Python's str.strip() whitespace set; Spark's trim() only removes spaces.
WHITESPACE = " \t\n\r\f\v"
MICROS_PER_DAY = 86_400_000_000


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


# P1 -------------------------------------------------------------------------
def normalize_blank(c: ColumnOrName, default: str = "Unknown",
                    blanks: Sequence[str] = tuple(C.BLANK_STRINGS)) -> Column:
    """Strip all whitespace; null or a blank spelling becomes ``default``."""
    s = strip(col(c).cast("string"))
    return F.when(s.isNull() | s.isin(*blanks), F.lit(default)).otherwise(s)


# P2 -------------------------------------------------------------------------
def map_values(c: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """Case-sensitive dictionary lookup with a default for misses."""
    if not mapping:
        return F.lit(default)
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    looked = F.try_element_at(F.create_map(*pairs), col(c))
    return F.coalesce(looked, F.lit(default)) if default is not None else looked


# P3 -------------------------------------------------------------------------
def title_case(c: ColumnOrName) -> Column:
    """Python ``str.title``: a letter is upper-cased when it follows a non-letter.

    ``initcap`` only restarts after whitespace, so split the text into runs of
    letters and non-letters and capitalise each letter run.
    """
    s = col(c)
    runs = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    fixed = F.transform(runs, lambda r: F.when(
        r.rlike(r"^\p{L}"),
        F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))), F.lower(F.substr(r, F.lit(2))))
    ).otherwise(r))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(fixed, ""))


def standardize_case(c: ColumnOrName, how: str = "upper") -> Column:
    s = strip(c)
    if how == "upper":
        return F.upper(s)
    if how == "lower":
        return F.lower(s)
    if how == "title":
        return title_case(s)
    raise ValueError(f"unknown case mode {how!r}")


# P4 -------------------------------------------------------------------------
def range_to_sentinel(c: ColumnOrName, lo, hi, sentinel=-1) -> Column:
    """Values outside ``[lo, hi]`` (and nulls) become the sentinel."""
    v = col(c)
    return F.when(v.between(F.lit(lo), F.lit(hi)), v).otherwise(F.lit(sentinel))


# P5 -------------------------------------------------------------------------
def coerce_ts(c: ColumnOrName, as_of, fmt: str | None = None) -> Column:
    """Parse to timestamp (invalid -> null, row kept); clamp values after ``as_of``."""
    v = col(c)
    parsed = F.try_to_timestamp(v.cast("string"), F.lit(fmt)) if fmt else \
        F.try_to_timestamp(v.cast("string"))
    limit = F.lit(as_of).cast("timestamp")
    return F.when(parsed > limit, limit).otherwise(parsed)


# P6 -------------------------------------------------------------------------
def fill_cast(c: ColumnOrName, value, dtype: str = "long") -> Column:
    return F.coalesce(col(c), F.lit(value)).cast(dtype)


# P7 -------------------------------------------------------------------------
def valid_id(c: ColumnOrName, allow: Iterable = ()) -> Column:
    """Positive ids are valid; ``allow`` lists extra accepted sentinels."""
    v = col(c)
    ok = v.isNotNull() & (v > 0)
    allow = list(allow)
    if allow:
        ok = ok | v.isin(*allow)
    return ok


def filter_valid_ids(df: DataFrame, c: str, allow: Iterable = ()) -> DataFrame:
    return df.filter(valid_id(c, allow))


# P8 -------------------------------------------------------------------------
def project(df: DataFrame, renames: Mapping[str, str] | None = None,
            upper: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    out = df.withColumnsRenamed(dict(renames)) if renames else df
    if upper:
        out = out.toDF(*[n.upper() for n in out.columns])
    if keep:
        out = out.select(*keep)
    return out


# P9 -------------------------------------------------------------------------
def age_at(ts: ColumnOrName, birth_year: ColumnOrName) -> Column:
    """Whole years from birth year to the event year; sentinel/missing -> null."""
    by = col(birth_year)
    return F.when(by > 0, F.year(col(ts)) - by)


# P10 ------------------------------------------------------------------------
def filter_min(df: DataFrame, c: str, minimum) -> DataFrame:
    return df.filter(F.col(c) >= F.lit(minimum))


# P11 ------------------------------------------------------------------------
def season(ts: ColumnOrName, upper: bool = False) -> Column:
    m = F.month(col(ts))
    expr = None
    for months, name in C.SEASONS:
        label = name.upper() if upper else name
        expr = F.when(m.isin(*months), F.lit(label)) if expr is None else \
            expr.when(m.isin(*months), F.lit(label))
    return expr



# P12 ------------------------------------------------------------------------
def day_diff(end: ColumnOrName, start: ColumnOrName) -> Column:
    """Whole 24-hour days from ``start`` to ``end`` (floor), like ``Timedelta.days``.

    ``timestamp_diff`` in microseconds is zone-free for TIMESTAMP_NTZ, so a
    daylight-saving change in the session zone cannot shift the result.
    """
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


# P13 ------------------------------------------------------------------------
def within_days(diff: ColumnOrName, n: int = 5) -> Column:
    """1 when the difference is at most ``n`` days; a missing difference counts as inside."""
    return (F.coalesce(col(diff), F.lit(0)) <= F.lit(n)).cast("int")


# P14 ------------------------------------------------------------------------
def level_of(c: ColumnOrName, mapping: Mapping[str, int]) -> Column:
    return F.coalesce(map_values(c, mapping), F.lit(0))


# P15 ------------------------------------------------------------------------
def band(c: ColumnOrName, cuts: Sequence[tuple], default, strict: bool = False,
         null_label=None) -> Column:
    """Ordered threshold banding, highest cut first (``>=`` unless ``strict``)."""
    v = col(c)
    expr = None
    for cut, label in cuts:
        cond = (v > F.lit(cut)) if strict else (v >= F.lit(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.otherwise(F.lit(default))
    if null_label is not None:
        expr = F.when(v.isNull(), F.lit(null_label)).otherwise(expr)
    return expr


# P16 ------------------------------------------------------------------------
def count_flags(cols: Sequence[ColumnOrName]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(col(c).cast("int"), F.lit(0))
    return total


def flag_ge(c: ColumnOrName, cut) -> Column:
    return (col(c) >= F.lit(cut)).cast("int")


# P17 ------------------------------------------------------------------------
def keyword_pattern(words: Sequence[str]) -> str:
    """Case-insensitive alternation of literal substrings."""
    import re
    return "(?i)(" + "|".join(re.escape(w) for w in words) + ")"


def match_keyword_groups(c: ColumnOrName, groups: Mapping[str, Sequence[str]]) -> Column:
    """Array of group names (in group order) whose keywords occur in the text."""
    v = col(c)
    hits = [F.when(v.rlike(keyword_pattern(words)), F.lit(name)) for name, words in groups.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


# P18 ------------------------------------------------------------------------
def map_exact_or_contains(c: ColumnOrName, names: Sequence[str]) -> Column:
    """Exact name, else the first name (list order) contained in the value."""
    v = col(c)
    arr = F.array(*[F.lit(n) for n in names])
    exact = F.when(F.array_contains(arr, v), v)
    first_sub = F.try_element_at(F.filter(arr, lambda n: F.instr(v, n) > 0), F.lit(1))
    return F.coalesce(exact, first_sub)


# P19 ------------------------------------------------------------------------
TYPE_HINTS = {"int": "bigint", "integer": "bigint", "float": "double",
              "double": "double", "string": "string", "str": "string",
              "object": "string", "category": "string", "date": "timestamp",
              "datetime": "timestamp", "timestamp": "timestamp", "bool": "boolean",
              "boolean": "boolean", "binary": "bigint"}


def coerce_by_dictionary(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Best-effort cast per type hint: bad cells become null (``try_cast``)."""
    exprs = []
    for name in df.columns:
        hint = types.get(name)
        target = TYPE_HINTS.get(str(hint).strip().lower()) if hint else None
        exprs.append(F.expr(f"try_cast(`{name}` AS {target})").alias(name) if target else F.col(name))
    return df.select(*exprs)


# P20 ------------------------------------------------------------------------
def align_columns(df: DataFrame, ordered: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Reorder to the dictionary, add missing as null, drop extras (``always`` kept)."""
    present = set(df.columns)
    out = [F.col(n) if n in present else F.lit(None).alias(n) for n in ordered]
    out += [F.col(n) for n in always if n in present and n not in ordered]
    return df.select(*out)


# P21 ------------------------------------------------------------------------
def invert_label(c: ColumnOrName) -> Column:
    return F.lit(1) - col(c)


# P22 ------------------------------------------------------------------------
def null_if(c: ColumnOrName, value) -> Column:
    return F.nullif(col(c), F.lit(value))


# P23 ------------------------------------------------------------------------
def form_risk_score(comorbidities: ColumnOrName, symptoms: ColumnOrName, age: ColumnOrName,
                    contraindication: ColumnOrName | None = None) -> Column:
    """Form score: 2 per comorbidity + 1 per symptom + age points (3 at 65+,
    1 at 50+), times the contraindication multiplier (Low 1, Medium 1.5, High 2)."""
    a = col(age)
    age_pts = F.when(a >= 65, 3).when(a >= 50, 1).otherwise(0)
    base = (F.lit(2) * F.coalesce(F.size(col(comorbidities)), F.lit(0)) +
            F.coalesce(F.size(col(symptoms)), F.lit(0)) + age_pts).cast("double")
    if contraindication is None:
        return base
    return base * F.coalesce(map_values(contraindication, C.FORM_CONTRA_MULTIPLIER), F.lit(1.0))


def form_risk_level(score: ColumnOrName) -> Column:
    return band(score, C.FORM_RISK_LEVELS, "Low Risk")


def form_alert(score: ColumnOrName, age: ColumnOrName, comorbidities: ColumnOrName) -> Column:
    return (col(score) >= C.FORM_ALERT_SCORE) | \
        ((col(age) >= 65) & (F.coalesce(F.size(col(comorbidities)), F.lit(0)) >= 2))


def record_risk_score(age: ColumnOrName, comorbidities: ColumnOrName, symptoms: ColumnOrName) -> Column:
    """Record score: age 3 (65+) / 2 (45+) / 1, + min(comorbidities, 3) + min(symptoms, 2)."""
    a = col(age)
    return (F.when(a >= 65, 3).when(a >= 45, 2).otherwise(1) +
            F.least(F.coalesce(F.size(col(comorbidities)), F.lit(0)), F.lit(3)) +
            F.least(F.coalesce(F.size(col(symptoms)), F.lit(0)), F.lit(2)))


def record_risk_level(score: ColumnOrName) -> Column:
    return band(score, C.RECORD_RISK_LEVELS, "Low Risk")


def record_alert(age: ColumnOrName, comorbidities: ColumnOrName, symptoms: ColumnOrName) -> Column:
    """Elderly and (a high-risk condition or a severe symptom)."""
    hi = F.array(*[F.lit(x) for x in C.RECORD_HIGH_RISK_CONDITIONS])
    sev = F.array(*[F.lit(x) for x in C.RECORD_SEVERE_SYMPTOMS])
    return F.coalesce(col(age) >= 65, F.lit(False)) & (
        F.coalesce(F.arrays_overlap(col(comorbidities), hi), F.lit(False)) |
        F.coalesce(F.arrays_overlap(col(symptoms), sev), F.lit(False)))


# P24 ------------------------------------------------------------------------
def round_cols(df: DataFrame, n: int = 4, half_even: bool = False,
               cols: Sequence[str] | None = None) -> DataFrame:
    names = cols or [f.name for f in df.schema.fields
                     if f.dataType.typeName() in ("double", "float")]
    fn = F.bround if half_even else F.round
    return df.withColumns({c: fn(F.col(c), n) for c in names})


# P25 ------------------------------------------------------------------------
def validate_rows(rules: Sequence[tuple[Column, str]]) -> Column:
    """Array of messages for the rules that fail (a rule is a *failure* predicate)."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in rules]))


# P26 ------------------------------------------------------------------------
def recommend_action(alert: ColumnOrName, meets: ColumnOrName, prediction: ColumnOrName) -> Column:
    return (F.when(col(alert) & col(meets),
                   F.struct(F.lit("high").alias("priority"), F.lit(C.ACTION_TITLES["high"]).alias("title")))
            .when((col(prediction) == 1) & ~col(alert),
                  F.struct(F.lit("medium").alias("priority"), F.lit(C.ACTION_TITLES["medium"]).alias("title")))
            .otherwise(F.struct(F.lit("low").alias("priority"), F.lit(C.ACTION_TITLES["low"]).alias("title"))))
