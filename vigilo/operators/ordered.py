"""Running totals over a global order without a single-task window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row to one task.
Operators that need a global order (cumulative share, empirical CDFs, ROC and
precision-recall curves, exact quantiles) use :func:`prefix_sums` instead:

1. every row gets a bucket that is a monotone function of its order value
   alone, so any evaluation of the plan, at any partitioning and after any
   retry, puts it in the same bucket;
2. a window inside each (group, bucket) gives the running totals there;
3. a table of bucket totals, one row per (group, bucket), is turned into
   offsets by a window over the group's buckets;
4. the offsets are joined back on (group, bucket), the key the rows are
   already partitioned by.

Callers usually aggregate to one row per distinct order value first, so ties
are grouped and heavy values never dominate one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Buckets per unit of log(1 + |value|): a relative width of 2**-14 for large
# values, an absolute one for values around 0.
RESOLUTION = 1 << 14
TEXT_BUCKETS = 64
TEXT_SAMPLE = 32       # sampled distinct texts per split point
_LAST = 1 << 62


def _bucket(df: DataFrame, order_col: str, descending: bool) -> Column:
    """Bucket number, ascending in scan order; missing values come last."""
    kind = df.schema[order_col].dataType
    col = F.col(order_col)
    if isinstance(kind, T.StringType):
        # A bottom-k sample by hash of the distinct texts: a bounded list, read once.
        seen = (df.select(col.alias("v")).where(col.isNotNull()).distinct()
                .orderBy(F.xxhash64("v"), "v").limit(TEXT_BUCKETS * TEXT_SAMPLE).collect())
        splits = sorted((r["v"] for r in seen), key=lambda v: v.encode())[TEXT_SAMPLE::TEXT_SAMPLE]
        number = F.size(F.filter(F.array(*[F.lit(v) for v in splits]), lambda x: x <= col)) if splits else F.lit(0)
        number = F.when(col.isNotNull(), number.cast("long"))
    else:
        if isinstance(kind, T.DateType):
            col = col.cast("timestamp")
        x = col.cast("double")
        number = F.when(F.isnan(x), F.lit(1 << 60)).when(
            x.isNotNull(), F.floor(F.signum(x) * F.least(F.log1p(F.abs(x)), F.lit(1e4)) * RESOLUTION))
    return F.coalesce(-number if descending else number, F.lit(_LAST)).cast("long")


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                group_cols: Sequence[str] = (), descending: bool = False,
                with_next: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` within each group.

    Adds ``cum_<c>`` (double) for each sum column and, with ``with_next``,
    ``_next`` holding the following order value in the same group (null on
    the last row).  Order values should be distinct per group (aggregate
    first) or be told apart by the ``tie`` columns (ascending).
    """
    group_cols, sum_cols = list(group_cols), list(sum_cols)
    rows = df.withColumn("_bucket", _bucket(df, order_col, descending))
    order = [F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_last()]
    order += [F.col(t).asc_nulls_last() for t in tie]
    inside = Window.partitionBy(*group_cols, "_bucket").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rows.select("*", *[F.sum(F.col(c).cast("double")).over(running).alias("_in_" + c) for c in sum_cols],
                          *([F.lead(order_col).over(inside).alias("_lead")] if with_next else []))

    aggs = [F.sum(F.col(c).cast("double")).alias("_tot_" + c) for c in sum_cols]
    if with_next:
        aggs.append((F.max if descending else F.min)(order_col).alias("_first"))
    totals = rows.groupBy(*group_cols, "_bucket").agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    w = Window.partitionBy(*group_cols).orderBy("_bucket")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        F.col("_bucket").alias("_o_bucket"), *[F.col(g).alias("_o_" + g) for g in group_cols],
        *[F.coalesce(F.sum("_tot_" + c).over(before), F.lit(0.0)).alias("_off_" + c) for c in sum_cols],
        *([F.lead("_first").over(w).alias("_next_part")] if with_next else []))
    cond = [F.col(g).eqNullSafe(F.col("_o_" + g)) for g in group_cols] + [F.col("_bucket") == F.col("_o_bucket")]
    joined = scanned.join(offs, cond, "left")
    out_cols = [F.col(c) for c in df.columns]
    out_cols += [(F.col("_in_" + c) + F.col("_off_" + c)).alias("cum_" + c) for c in sum_cols]
    if with_next:
        out_cols.append(F.coalesce(F.col("_lead"), F.col("_next_part")).alias("_next"))
    return joined.select(*out_cols)


def exact_quantiles(long_df: DataFrame, group_cols: Sequence[str], value_col: str,
                    qs: Sequence[float], count_col: str | None = None) -> DataFrame:
    """Exact linearly-interpolated quantiles per group (like ``percentile``).

    Scales with distinct values: counts per (group, value), a distributed
    prefix sum of the counts, then the rows covering the target ranks.  The
    rank-target table is ``groups x len(qs) x 2`` rows.
    ``count_col`` says that the rows are distinct values with their counts.
    Returns ``group_cols + [q, value]``.
    """
    group_cols = list(group_cols)
    known = long_df.filter(F.col(value_col).isNotNull())
    counted = known.select(*group_cols, value_col, F.col(count_col).alias("_cnt")) if count_col else \
        known.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    cum = prefix_sums(counted, value_col, ["_cnt"], group_cols)
    sizes = counted.groupBy(*group_cols).agg(F.sum("_cnt").alias("_n"))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    targets = (sizes.select(*group_cols, "_n", F.explode(qarr).alias("q"))
               .withColumn("_h", (F.col("_n") - 1) * F.col("q"))
               .withColumn("_lo", F.floor("_h").cast("double"))
               .withColumn("_hi", F.ceil("_h").cast("double")))
    pos = targets.select(*group_cols, "q", "_h", "_lo",
                         F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_lo").alias("pos")),
                                           F.struct(F.lit(1).alias("side"), F.col("_hi").alias("pos")))).alias("t"))
    pos = pos.select(*[F.col(g).alias("_p_" + g) for g in group_cols], "q", "_h", "_lo", "t.side", "t.pos")
    cond = [F.col(g).eqNullSafe(F.col("_p_" + g)) for g in group_cols] + [
        (F.col("cum__cnt") - F.col("_cnt")) <= F.col("pos"), F.col("pos") < F.col("cum__cnt")]
    # The rank-target table has groups x len(qs) x 2 rows.  No hint: it is broadcast
    # when its measured size allows, else a hot group is split as a skewed join.
    hit = cum.join(pos, cond, "inner").select(
        *group_cols, "q", "_h", "_lo", "side", F.col(value_col).cast("double").alias("_v"))
    res = hit.groupBy(*group_cols, "q").agg(
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"),
        F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("_vhi"))
    return res.select(*group_cols, "q",
                      (F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo")))
                      .alias(value_col))
