"""Corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
stage before it kept.  All but the last return the columns of ``documents``:

1. ``toxicity``: documents that score 0.3 or more go;
2. ``quality``: documents that a rule rejects go;
3. ``near_duplicates``: one document of each class stays, the least id;
4. ``repeated_passages``: words covered by a 35-word window that also starts
   elsewhere are taken out of the text (kept words joined by one space,
   ``n_chars`` follows); a document may end up empty and stays;
5. ``packing``: pieces of at most 2048 tokens with their sequence and offset.

The toxicity network and the packing program cannot be written in SQL, so there
is no ``ORACLE_SQL``; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilo.llm import cascade, debruijn, omh, packing, toxicity
from vigilo.session import ensure_checkpoint_dir, scratch_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return cascade.filter_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return omh.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    cut = debruijn.remove_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.packed_digest(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates),
          ("repeated_passages", cut_repeated_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    _ready(spark)
    folder = scratch_dir(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
