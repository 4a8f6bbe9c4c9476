"""Window and ranking operators.

Per-entity "first/last row" and de-duplication are written as aggregates of
``min``/``max`` over a struct whose leading fields are the ordering keys.
That is a partial (map-side) aggregate: a key holding a third of all rows is
reduced to one row per partition before the shuffle, where a ranking window
would sort and buffer the whole key in one task.  Global orders go through
:mod:`vigilo.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators.ordered import prefix_sums


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool,
          pred: Column | None = None) -> DataFrame:
    keys = list(keys)
    order = list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    src = df.filter(pred) if pred is not None else df
    # Missing order values come last: a row without a date is never the first event.
    missing = [] if last else [F.col(c).isNull().alias(f"_missing_{i}") for i, c in enumerate(order)]
    lead = [x for pair in zip(missing, order) for x in (pair[0], F.col(pair[1]))] if missing else [F.col(c) for c in order]
    packed = F.struct(*lead, *[F.col(c) for c in rest])
    agg = (F.max if last else F.min)(packed).alias("_row")
    out = src.groupBy(*keys).agg(agg)
    return out.select(*keys, *[F.col("_row." + c).alias(c) for c in order + rest]).select(*df.columns)


# W1 -------------------------------------------------------------------------
def index_event(df: DataFrame, key: str, ts: str, pred: Column | None = None,
                tie: Sequence[str] = ()) -> DataFrame:
    """First row per entity by ``(ts, *tie)`` among rows matching ``pred``."""
    return _pick(df, [key], [ts, *tie], last=False, pred=pred)


# W2 -------------------------------------------------------------------------
def latest_event(df: DataFrame, key: str, ts: str, tie: Sequence[str] = (),
                 pred: Column | None = None) -> DataFrame:
    return _pick(df, [key], [ts, *tie], last=True, pred=pred)


# W3 -------------------------------------------------------------------------
def dedupe(df: DataFrame, subset: Sequence[str] | None = None,
           order: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row per ``subset`` by ``order``; whole-row copies without a subset."""
    if not subset:
        return df.dropDuplicates()
    if not order:
        raise ValueError("dedupe on a subset needs an explicit order (first is otherwise arbitrary)")
    return _pick(df, subset, order, last=False)


# W4 -------------------------------------------------------------------------
def rank_desc(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """Competition rank, highest value first; ties share the best rank.

    rank = 1 + number of rows with a strictly greater value, from a
    distributed running count over the distinct values.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(counts, col, ["_c"], descending=True)
    ranks = cum.select(col, (F.col("cum__c") - F.col("_c") + 1).cast("int").alias(name))
    return df.join(ranks, [col], "left")


# W5 -------------------------------------------------------------------------
def cumulative_share(df: DataFrame, col: str) -> DataFrame:
    """Running total and cumulative share, descending, zero values removed.

    Rows with equal values share one running total (the total up to and
    including their value), so the result does not depend on tie order.
    """
    nz = df.filter(F.col(col) != 0)
    per = nz.groupBy(col).agg(F.sum(col).alias("_s"))
    cum = prefix_sums(per, col, ["_s"], descending=True)
    total = nz.agg(F.sum(col)).scalar()
    return (nz.join(cum.select(col, F.col("cum__s").alias("cumulative")), [col], "left")
            .withColumn("cumulative_share", F.col("cumulative") / total))


# W6 -------------------------------------------------------------------------
def ecdf_pair(long_df: DataFrame, group_col: str, value_col: str, side_col: str) -> DataFrame:
    """Two-sample empirical CDFs per group.

    ``long_df`` holds (group, value, side) with side 0 = reference, 1 = new.
    Returns one row per (group, distinct value) with ``cdf_ref``, ``cdf_new``
    and ``_next`` (next distinct value).
    """
    counts = (long_df.filter(F.col(value_col).isNotNull())
              .groupBy(group_col, value_col)
              .agg(F.sum(F.when(F.col(side_col) == 0, 1).otherwise(0)).alias("n_ref"),
                   F.sum(F.when(F.col(side_col) == 1, 1).otherwise(0)).alias("n_new")))
    sizes = counts.groupBy(group_col).agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_new").alias("tot_new"))
    cum = prefix_sums(counts, value_col, ["n_ref", "n_new"], [group_col], with_next=True)
    # One row per group (feature): broadcast.
    return (cum.join(F.broadcast(sizes), [group_col], "left")
            .withColumn("cdf_ref", F.col("cum_n_ref") / F.col("tot_ref"))
            .withColumn("cdf_new", F.col("cum_n_new") / F.col("tot_new")))


# W7 -------------------------------------------------------------------------
def gaps(df: DataFrame, ts: str, key: str | None = None, name: str = "gap_days",
         bounded: bool = False) -> DataFrame:
    """Whole-day gap to the previous row of the same key.

    Without a key every row shares one window partition, which is only
    acceptable for tables of bounded size (a version history): say so with
    ``bounded=True``.
    """
    from vigilo.functions.scalar import day_diff
    if key is None and not bounded:
        raise ValueError("gaps without a key needs bounded=True (all rows go to one window partition)")
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(ts)
    return df.withColumn(name, day_diff(F.col(ts), F.lag(ts).over(w)))


def _score_counts(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(*group_cols, score)
            .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
                 F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")))


# W8 -------------------------------------------------------------------------
def roc_auc(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC AUC with average ranks for ties (Mann-Whitney form), per group."""
    g = list(group_cols)
    counts = _score_counts(df, label, score, g)
    cum = prefix_sums(counts, score, ["neg"], g)
    part = cum.select(*g, (F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
                      "pos", "neg")
    agg = part.groupBy(*g).agg(F.sum("u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return agg.select(*g, F.when((F.col("p") > 0) & (F.col("n") > 0),
                                 F.col("u") / (F.col("p") * F.col("n"))).alias("roc_auc"))


# W9 -------------------------------------------------------------------------
def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One (fpr, tpr) point per distinct score, descending threshold."""
    counts = _score_counts(df, label, score)
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    cum = prefix_sums(counts, score, ["pos", "neg"], descending=True)
    p = totals.select("p").scalar()
    n = totals.select("n").scalar()
    return cum.select(F.col(score).alias("threshold"),
                      (F.col("cum_neg") / n).alias("fpr"),
                      (F.col("cum_pos") / p).alias("tpr"))


# W10 ------------------------------------------------------------------------
def average_precision(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Step-sum average precision: sum over thresholds of (delta recall) x precision."""
    g = list(group_cols)
    counts = _score_counts(df, label, score, g)
    cum = prefix_sums(counts, score, ["pos", "neg"], g, descending=True)
    step = cum.select(*g, (F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("s"),
                      "pos")
    agg = step.groupBy(*g).agg(F.sum("s").alias("s"), F.sum("pos").alias("p"))
    return agg.select(*g, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"))


def roc_pr(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC AUC and step-sum average precision from one ascending prefix pass.

    The descending running counts that average precision needs are
    ``total - ascending + current`` - exact, because the counts are integers.
    """
    g = list(group_cols)
    counts = _score_counts(df, label, score, g)
    cum = prefix_sums(counts, score, ["pos", "neg"], g)
    tot = counts.groupBy(*g).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if g:
        j = cum.join(F.broadcast(tot), g, "left")   # one row per group
    else:
        j = cum.withColumns({"_p": tot.select("_p").scalar(), "_n": tot.select("_n").scalar()})
    d_pos = F.col("_p") - F.col("cum_pos") + F.col("pos")
    d_neg = F.col("_n") - F.col("cum_neg") + F.col("neg")
    parts = j.select(*g, "_p", "_n",
                     (F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
                     F.when(F.col("pos") > 0, F.col("pos") * d_pos / (d_pos + d_neg)).otherwise(F.lit(0.0)).alias("s"))
    agg = parts.groupBy(*g).agg(F.sum("u").alias("u"), F.sum("s").alias("s"),
                                F.first("_p").alias("p"), F.first("_n").alias("n"))
    return agg.select(*g,
                      F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n")))
                      .alias("roc_auc"),
                      F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("pr_auc"))
