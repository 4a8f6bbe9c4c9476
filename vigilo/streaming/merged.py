"""Tables that a stream keeps up to date by key.

A stream in update mode sends every changed row of its result again.  Each
micro-batch is written to a folder of its own, ``batch_id=N``, with overwrite:
a batch that is replayed after a failure replaces itself and changes nothing.
Readers see, for every key, the row of the highest batch.  Every few batches the
folders are compacted into a snapshot ``base_id=M`` that holds the rows as of
batch M; what a snapshot covers is ignored by readers from then on and deleted
one compaction later, so that readers at work keep their files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from vigilo.session import remove_dir

COMPACT_EVERY = 20


def _folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Complete snapshots and batches of a table, in ascending order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = re.fullmatch(r"(base|batch)_id=(\d+)", status.getPath().getName())
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name and fs.exists(done):
                found[name[1]].append(int(name[2]))
    return sorted(found["base"]), sorted(found["batch"])


def read_merged(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, upto: int | None = None) -> DataFrame:
    """The table's current rows, one per key (``upto``: as of that batch)."""
    path = path.rstrip("/")
    bases, batches = _folders(spark, path)
    if upto is not None:
        bases, batches = [b for b in bases if b <= upto], [b for b in batches if b <= upto]
    base = bases[-1] if bases else -1
    rows = spark.createDataFrame([], schema).withColumn("_version", F.lit(-1))
    if bases:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/base_id={base}").withColumn("_version", F.lit(base)))
    later = [f"{path}/batch_id={b}" for b in batches if b > base]
    if later:
        with_id = StructType([*schema.fields, StructField("batch_id", IntegerType())])
        rows = rows.unionByName(spark.read.schema(with_id).option("basePath", path).parquet(*later)
                                .withColumnRenamed("batch_id", "_version"))
    keys = list(keys)
    rest = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in schema.names])


def compact(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, upto: int) -> None:
    """Write the rows as of batch ``upto`` as a snapshot and drop what the snapshot before it covers."""
    path = path.rstrip("/")
    bases, batches = _folders(spark, path)
    if bases and bases[-1] >= upto:
        return
    read_merged(spark, path, keys, schema, upto).write.mode("overwrite").parquet(f"{path}/base_id={upto}")
    before = bases[-1] if bases else -1
    for b in bases[:-1]:
        remove_dir(spark, f"{path}/base_id={b}")
    for b in batches:
        if b <= before:
            remove_dir(spark, f"{path}/batch_id={b}")


def merge_batches(path: str, keys: Sequence[str], compact_every: int = COMPACT_EVERY):
    """``foreachBatch`` writer of a merged table."""
    path = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys, batch.schema, batch_id)

    return write


def start_merge(sdf: DataFrame, path: str, checkpoint: str, keys: Sequence[str], available_now: bool = False,
                trigger: str | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the result of an aggregating stream as a merged table: every window is there from its first row on."""
    w = sdf.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(merge_batches(path, keys, compact_every))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger:
        w = w.trigger(processingTime=trigger)
    return w.start()
