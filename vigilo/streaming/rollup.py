"""Metric rollups on a stream (M3) and the idempotent append sink.

``rollup_stream`` is the streaming twin of
:func:`vigilo.operators.monitor.rollup_windows`: event-time windows behind a
watermark.  With append output a window is emitted once, when the watermark
passes its end, so a stream that stops keeps back its last windows; with update
output into a merged table (:mod:`vigilo.streaming.merged`) every window is there
from its first event on and corrected until the watermark passes it.  Sliding
windows in append mode chain two stateful aggregations - slide-sized buckets
first, then windows over the buckets' ``window_time`` - so the state holds one
small row per bucket; Spark allows update mode for one aggregation only, so with
``chained=False`` events are expanded to their windows before the partial sums.
Percentiles on streams are ``percentile_approx`` by default (exact
``percentile`` keeps every value in state); exact is an option for tumbling
windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilo.operators.aggregates import bucket_part, merged_deviation


def rollup_stream(sdf: DataFrame, size: str, slide: str | None = None, watermark: str = "10 minutes",
                  keys: Sequence[str] = ("metric_name",), ts: str = "timestamp", value: str = "value",
                  exact_percentiles: bool = False, chained: bool = True) -> DataFrame:
    keys = list(keys)
    # withWatermark needs TIMESTAMP (not TIMESTAMP_NTZ); the session clock is UTC.
    src = (sdf.withColumn(ts, F.col(ts).cast("timestamp"))
           .withColumn(value, F.expr(f"try_cast(`{value}` AS double)"))
           .filter(F.col(value).isNotNull())
           .withWatermark(ts, watermark))
    v = F.col(value)
    if slide is None or slide == size or not chained:
        pct = (lambda q: F.percentile(v, q)) if exact_percentiles else \
            (lambda q: F.percentile_approx(v, q, 10000).cast("double"))
        out = src.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(
            F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            pct(0.5).alias("p50"), pct(0.95).alias("p95"), pct(0.99).alias("p99"))
        return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          *keys, "count", "sum", "min", "max", "mean", "std", "p50", "p95", "p99")
    buckets = src.groupBy(F.window(ts, slide).alias("b"), *keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), bucket_part(v).alias("part"),
        F.min(v).alias("mn"), F.max(v).alias("mx"))
    wins = buckets.groupBy(F.window(F.window_time("b"), size, slide).alias("w"), *keys).agg(
        F.sum("n").alias("count"), F.sum("s").alias("sum"), F.min("mn").alias("min"),
        F.max("mx").alias("max"), F.collect_list("part").alias("parts"))         # size / slide parts at most
    return wins.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                       F.col("count").cast("long").alias("count"), "sum", "min", "max",
                       (F.col("sum") / F.col("count")).alias("mean"), merged_deviation(F.col("parts")).alias("std"))


def append_batches(path: str, partition_by: Sequence[str] = ()):
    """foreachBatch writer: each micro-batch lands in its own ``batch_id=N``
    folder with overwrite, so a replayed batch after a failure replaces its
    own output instead of duplicating it (idempotent append)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def start_append(sdf: DataFrame, out_path: str, checkpoint: str, trigger: str | None = None,
                 available_now: bool = False) -> StreamingQuery:
    """Append a stream's rows to a table, one folder per micro-batch."""
    w = sdf.writeStream.outputMode("append").option("checkpointLocation", checkpoint) \
        .foreachBatch(append_batches(out_path))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger:
        w = w.trigger(processingTime=trigger)
    return w.start()
