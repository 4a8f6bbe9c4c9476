"""Sources and sinks.

Reads take an explicit schema (no inference pass over the data at scale);
timestamps that arrive as ``TIMESTAMP_NTZ`` are cast once to session-zone
``TIMESTAMP`` where the operator needs epoch arithmetic or watermarks.
Writes are plain ``DataFrameWriter`` calls: partitioned by date for
append-only tables so retention and time filters prune whole folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilo.session import delete_dir

SUPPORTED_FORMATS = ("parquet", "csv", "json", "orc")

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# S1 -------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             ts_cols: Sequence[str] = (), ts_format: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    for c in ts_cols:
        parsed = F.try_to_timestamp(F.col(c).cast("string"), F.lit(ts_format)) if ts_format \
            else F.try_to_timestamp(F.col(c).cast("string"))
        df = df.withColumn(c, parsed)
    return df


# S2 -------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None) -> DataFrame:
    fmt = fmt.lower()
    if fmt not in SUPPORTED_FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {SUPPORTED_FORMATS}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


# S3 -------------------------------------------------------------------------
def read_documents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Patient-store documents: ``patients`` or legacy ``doctor_input_patients`` array."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.json(path)
    cols = set(raw.columns)
    arrays = [F.col(c) for c in ("patients", "doctor_input_patients") if c in cols]
    if not arrays:
        raise ValueError("document has neither 'patients' nor 'doctor_input_patients'")
    arr = F.coalesce(*arrays) if len(arrays) > 1 else arrays[0]
    return raw.select(F.explode_outer(arr).alias("p")).select("p.*")


# S4 -------------------------------------------------------------------------
def explode_requests(df: DataFrame, id_col: str = "patient_id",
                     array_col: str = "transactions") -> DataFrame:
    """Nested requests to one row per transaction, keeping the real entity id."""
    keep = [c for c in df.columns if c != array_col]
    return (df.select(*keep, F.explode_outer(array_col).alias("_t"))
            .select(*keep, "_t.*"))


# S5 -------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    fmt = fmt.lower()
    if fmt not in SUPPORTED_FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


# S6 -------------------------------------------------------------------------
def write_documents(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """JSON lines plus a one-row envelope with the total count.

    Rows are written by the executors (``df.write.json``); only the count
    reaches the driver.
    """
    df.write.mode("overwrite").json(path.rstrip("/") + "/records")
    envelope = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", *[F.lit(v).alias(k) for k, v in (meta or {}).items()])
    envelope.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "/metadata")


# S7 -------------------------------------------------------------------------
def append_table(df: DataFrame, path: str, ts_col: str, date_col: str = "dt") -> None:
    """Append-only table partitioned by event date."""
    (df.withColumn(date_col, F.to_date(F.col(ts_col)))
     .write.mode("append").partitionBy(date_col).parquet(path))


# S8 -------------------------------------------------------------------------
def apply_retention(df: DataFrame, ts_col: str, days: int = 30, as_of=None,
                    date_col: str | None = None) -> DataFrame:
    """Rows younger than ``days`` relative to ``as_of`` (an explicit clock).

    With ``date_col`` (the table's date partition column) the same cut is also
    stated on the partition column, so whole expired folders are pruned from
    the scan instead of being read and filtered.
    """
    if as_of is None:
        raise ValueError("as_of is required: the clock is a parameter")
    cutoff = F.lit(as_of).cast(df.schema[ts_col].dataType) - F.expr(f"INTERVAL {int(days)} DAYS")
    out = df
    if date_col:
        out = out.filter(F.col(date_col) >= F.to_date(cutoff))
    return out.filter(F.col(ts_col) >= cutoff)


def delete_expired(spark: SparkSession, path: str, ts_col: str, days: int = 30, as_of=None, date_col: str = "dt") -> DataFrame:
    """Delete rows older than ``days`` from a table that :func:`append_table` wrote; one report row per touched day.

    Folders before the cut's day are dropped whole (their rows are counted from
    the files' footers).  The folder of the cut's day is rewritten without its
    expired rows by dynamic partition overwrite, which counts them in the same
    pass and puts the new files in place when they are complete.  No younger
    folder is read.  Rows without a time stay.  A run that failed half-way is
    finished by running it again.  Report: ``dt, rows_before, rows_removed``.
    """
    if as_of is None:
        raise ValueError("as_of is required: the clock is a parameter")
    path = path.rstrip("/")
    stored = spark.read.parquet(path)
    cutoff = F.lit(as_of).cast(stored.schema[ts_col].dataType) - F.expr(f"INTERVAL {int(days)} DAYS")
    day = spark.range(1).select(F.to_date(cutoff)).first()[0]
    report = [(r[date_col], r["n"], r["n"]) for r in
              stored.filter(F.col(date_col) < F.lit(day)).groupBy(date_col).agg(F.count(F.lit(1)).alias("n")).collect()]
    for gone, _, _ in report:
        delete_dir(spark, f"{path}/{date_col}={gone}")
    seen = Observation()
    last = stored.filter(F.col(date_col) == F.lit(day))
    if not last.isEmpty():
        last.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts_col) < cutoff).alias("old")) \
            .filter(~F.coalesce(F.col(ts_col) < cutoff, F.lit(False))) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)
        rows, old = seen.get["rows"], seen.get["old"]
        if rows == old:                  # nothing left: an overwrite by partitions does not touch an empty one
            delete_dir(spark, f"{path}/{date_col}={day}")
        report.append((day, rows, old))
    spark.catalog.refreshByPath(path)
    return spark.createDataFrame(report, f"{date_col} date, rows_before long, rows_removed long")


def retention_report(df: DataFrame, ts_col: str, days: int = 30, as_of=None) -> DataFrame:
    cutoff = F.lit(as_of).cast(df.schema[ts_col].dataType) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.sum(F.when(F.col(ts_col) < cutoff, 1).otherwise(0)).alias("rows_removed"))


# S9 -------------------------------------------------------------------------
def save_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").parquet(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# S10 ------------------------------------------------------------------------
def save_model(model, path: str, version: str, metrics: dict | None = None) -> None:
    """Versioned Spark ML artefact plus a one-row pointer table (the fixed alias)."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path.rstrip('/')}/{version}")
    row = {"version": version, "path": f"{path.rstrip('/')}/{version}"}
    row.update({k: float(v) for k, v in (metrics or {}).items()})
    spark.createDataFrame([row]).write.mode("overwrite").json(f"{path.rstrip('/')}/latest")


def load_model(path: str, loader, version: str | None = None):
    spark = SparkSession.getActiveSession()
    if version is None:
        version = spark.read.json(f"{path.rstrip('/')}/latest").first()["version"]
    return loader.load(f"{path.rstrip('/')}/{version}")


# S11 ------------------------------------------------------------------------
def load_feature_dictionary(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    d = read_table(spark, path, fmt)
    return check_feature_dictionary(d)


def check_feature_dictionary(d: DataFrame) -> DataFrame:
    missing = [c for c in ("Variable", "Type") if c not in d.columns]
    if missing:
        raise ValueError(f"feature dictionary lacks columns {missing}")
    out = d.filter(F.col("Variable").isNotNull())
    return out.withColumns({c: F.btrim(F.col(c).cast("string")) for c in out.columns})
