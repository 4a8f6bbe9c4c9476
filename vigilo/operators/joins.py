"""Joins (J1-J14).

No join here forces a strategy on a side whose size is unknown: Catalyst
plans sort-merge or shuffle-hash, and AQE turns a join into a broadcast only
after measuring the side at run time (``spark.sql.adaptive.autoBroadcastJoinThreshold``).
Explicit ``broadcast`` is used only for tables whose size is fixed by the
caller (rule tables, cut-off lists, keyword lists).  Skewed entity keys are
handled by AQE's skew-join splitting; every join that feeds an aggregate is
preceded by the filter and projection that shrink it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.operators.windows import dedupe


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


# J1 -------------------------------------------------------------------------
def enrich(base: DataFrame, dim: DataFrame, on, renames: Mapping[str, str] | None = None,
           defaults: Mapping[str, object] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Left-join dimension attributes; the dimension is de-duplicated on the key first."""
    keys = _keys(on)
    d = dedupe(dim, keys, order) if order else dim.dropDuplicates(keys)
    if renames:
        d = d.withColumnsRenamed(dict(renames))
    out = base.join(d, keys, "left")
    if defaults:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return out


# J2 -------------------------------------------------------------------------
def keep_referenced(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None,
                    allow: Sequence = ()) -> DataFrame:
    """Rows whose key exists in the dimension; ``allow`` values survive regardless.

    One pass over the fact table either way: a semi join when nothing is
    allowed, else a left join to the distinct dimension keys plus a filter.
    """
    dk = dim.select(F.col(dim_key or key).alias(key))
    if not allow:
        return fact.join(dk, key, "left_semi")
    marked = dk.distinct().withColumn("_ref", F.lit(True))
    return (fact.join(marked, key, "left")
            .filter(F.col("_ref") | F.col(key).isin(*allow))
            .drop("_ref"))


# J3 -------------------------------------------------------------------------
def orphan_keys(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None,
                exclude: Sequence = (-1,)) -> DataFrame:
    """Distinct fact keys missing from the dimension (sentinels excluded).

    ``distinct`` runs before the anti join so a hot key collapses in the
    map-side partial aggregate instead of flooding one join task.
    """
    keys = fact.select(key).filter(F.col(key).isNotNull())
    if exclude:
        keys = keys.filter(~F.col(key).isin(*exclude))
    dk = dim.select(F.col(dim_key or key).alias(key))
    return keys.distinct().join(dk, key, "left_anti")


# J4 -------------------------------------------------------------------------
def lookback(events: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str) -> DataFrame:
    """Events of each entity at or before its index time (inclusive, inner)."""
    return events.join(index, [key], "inner").filter(F.col(ts) <= F.col(index_ts))


# J5 -------------------------------------------------------------------------
def lookback_within(events: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str,
                    days: int) -> DataFrame:
    """Events in ``[index_ts - days, index_ts]`` (both ends inclusive).

    An equi join on the entity key with a range filter; the index side holds
    one row per entity, so a hot entity only grows the probe side, which AQE
    splits.
    """
    lo = F.col(index_ts) - F.expr(f"INTERVAL {int(days)} DAYS")
    return (events.join(index, [key], "inner")
            .filter((F.col(ts) >= lo) & (F.col(ts) <= F.col(index_ts))))


# J6 -------------------------------------------------------------------------
def asof_latest(events: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str,
                value_cols: Sequence[str] = (), prefix: str = "last_") -> DataFrame:
    """For each index row, the latest event at or before its time (null when none).

    ``max(struct(ts, ...))`` is a partial aggregate: no sort, no per-key list.
    """
    cols = [ts] + [c for c in value_cols if c != ts]
    hits = lookback(events.select(key, *cols), index.select(key, index_ts), key, ts, index_ts)
    latest = hits.groupBy(key).agg(F.max(F.struct(*cols)).alias("_m"))
    latest = latest.select(key, *[F.col("_m." + c).alias(prefix + c) for c in cols])
    return index.join(latest, [key], "left")


# J7 -------------------------------------------------------------------------
def left_fill(base: DataFrame, other: DataFrame, on, fill: Mapping[str, object]) -> DataFrame:
    out = base.join(other, _keys(on), "left")
    return out.fillna(dict(fill)) if fill else out


# J8 -------------------------------------------------------------------------
def join_flag(pairs: DataFrame, flagged: DataFrame, keys: Sequence[str], name: str = "flag") -> DataFrame:
    """Mark each (distinct) pair that appears in ``flagged`` with 1, else 0."""
    keys = list(keys)
    marks = flagged.select(*keys).distinct().withColumn(name, F.lit(1))
    return pairs.distinct().join(marks, keys, "left").fillna({name: 0})


# J9 -------------------------------------------------------------------------
def assemble_records(entities: DataFrame, events: DataFrame, key: str, value_col: str,
                     kind_col: str, kinds: Sequence[str]) -> DataFrame:
    """One row per entity with a sorted distinct array per event kind.

    Entities without a dimension row drop out (inner join).  ``collect_set``
    is bounded by the number of *distinct* values per entity and kind.
    """
    aggs = []
    for k in kinds:
        arr = F.array_sort(F.collect_set(F.when(F.col(kind_col) == k, F.col(value_col))))
        aggs.append(arr.alias(k.lower()))
    per = events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), *aggs)
    return entities.join(per, [key], "inner")


# J10 ------------------------------------------------------------------------
def diff_snapshots(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Full outer diff: change class new / deleted / modified / unchanged."""
    o = old.select(key, *[F.col(c).alias("old_" + c) for c in cols]).withColumn("_o", F.lit(True))
    n = new.select(key, *[F.col(c).alias("new_" + c) for c in cols]).withColumn("_n", F.lit(True))
    j = o.join(n, [key], "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col("old_" + c).eqNullSafe(F.col("new_" + c))
    change = (F.when(F.col("_o").isNull(), "new")
              .when(F.col("_n").isNull(), "deleted")
              .when(~same, "modified").otherwise("unchanged"))
    return j.withColumn("change", change).drop("_o", "_n")


# J11 ------------------------------------------------------------------------
def contingency(ref: DataFrame, new: DataFrame, col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Aligned category counts of two datasets (union of categories, zeros filled)."""
    g = list(group_cols)
    a = ref.filter(F.col(col).isNotNull()).groupBy(*g, col).agg(F.count(F.lit(1)).alias("ref_count"))
    b = new.filter(F.col(col).isNotNull()).groupBy(*g, col).agg(F.count(F.lit(1)).alias("new_count"))
    return a.join(b, g + [col], "full_outer").fillna({"ref_count": 0, "new_count": 0})


# J12 ------------------------------------------------------------------------
def compare_to_baseline(current: DataFrame, baseline: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Unpivot both one-row metric tables and compute the relative decline."""
    def longform(df, name):
        return df.unpivot([], list(metrics), "metric", name)
    cur = longform(current, "current_value")
    base = longform(baseline, "baseline_value")
    out = cur.join(base, ["metric"], "inner")
    return out.withColumn(
        "decline", F.when(F.col("baseline_value") != 0,
                          (F.col("baseline_value") - F.col("current_value")) / F.col("baseline_value"))
        .otherwise(F.lit(0.0)))


# J14 ------------------------------------------------------------------------
def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace rows by key and append new keys; unchanged keys are kept as they are.

    Columns missing from ``updates`` keep their current value.
    """
    u = updates.alias("u")
    c = current.alias("c")
    j = c.join(u, F.col("c." + key) == F.col("u." + key), "full_outer")
    out = [F.coalesce(F.col("u." + key), F.col("c." + key)).alias(key)]
    for name in current.columns:
        if name == key:
            continue
        if name in updates.columns:
            out.append(F.when(F.col("u." + key).isNotNull(), F.col("u." + name))
                       .otherwise(F.col("c." + name)).alias(name))
        else:
            out.append(F.col("c." + name).alias(name))
    return j.select(*out)


def assign_ids(existing: DataFrame, new_rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """New ids continue from the existing maximum, in ``order`` order.

    Rows that agree in all of ``order`` are told apart by their other columns;
    running counts over value buckets number them (no single-task window).
    """
    from vigilo.operators.ordered import prefix_sums
    start = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("m"))
    tie = [*order[1:], *[c for c in new_rows.columns if c not in order]]
    numbered = prefix_sums(new_rows.withColumn("_one", F.lit(1)), order[0], ["_one"], tie=tie)
    return (numbered.withColumn(key, (F.col("cum__one").cast("long") + start.scalar()))
            .drop("_one", "cum__one"))
