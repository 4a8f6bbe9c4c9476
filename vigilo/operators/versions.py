"""Dataset versions: fingerprints, change classes, history, verification (V1-V7).

The fingerprint of a table is computed by the executors from its rows - an
order-insensitive combination of two independent per-row hashes over all columns
(XOR of one, modular sum of the other, from the row's md5) - so it does not depend on file layout, partitioning or
row order, and no data reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Prime below 2**53 for the additive part of the fingerprint.
SUM_MODULUS = 9007199254740881


def field_text(df: DataFrame, c: str) -> F.Column:
    """Canonical text of a value, the same in every engine.

    Floating-point numbers are their whole part and 52 bits of their fraction
    as integers, times are microseconds since 1970.
    """
    x = F.col(c)
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = x.cast("double")
        whole = F.floor(x)
        return (F.when(F.isnan(x), "NaN").when(F.abs(x) >= 9e18, F.when(x > 0, "big").otherwise("-big"))
                .otherwise(F.concat(whole.cast("string"), F.lit("."),
                                    F.floor((x - whole) * F.lit(float(1 << 52))).cast("string"))))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp")).cast("string")
    return x.cast("string")


def with_row_hashes(df: DataFrame, cols: Sequence[str], keep: Sequence[F.Column] = ()) -> DataFrame:
    """``one`` and ``two``, independent 52-bit integers from the md5 of each row's canonical text, besides ``keep``.

    Every field carries its length, so no text can pass for two fields.  Texts,
    digest and integers are projections of their own: each is used more than
    once by the next, so the optimiser leaves them apart and none is computed
    twice.
    """
    texts = df.select(*keep, *[field_text(df, c).alias(f"_t{i}") for i, c in enumerate(cols)])
    kept = texts.columns[:len(keep)]
    fields = [F.when(F.col(t).isNull(), "N").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), F.col(t)))
              for t in texts.columns[len(keep):]]
    digest = texts.select(*kept, F.md5(F.concat(*fields)).alias("_digest"))
    return digest.select(*kept, *[F.conv(F.substring("_digest", at, 13), 16, 10).cast("long").alias(name)
                                  for at, name in ((1, "one"), (14, "two"))])


def _combined(one: str, two: str) -> list[F.Column]:
    """XOR and modular sum of hashes or of such combinations: both merge in any order."""
    total = F.sum(F.col(two).cast("decimal(20,0)")) % F.lit(SUM_MODULUS).cast("decimal(20,0)")
    return [F.coalesce(F.bit_xor(one), F.lit(0)).alias("content_xor"),
            F.coalesce(total, F.lit(0)).cast("long").alias("content_sum")]


def schema_text(df: DataFrame, cols: Sequence[str] | None = None) -> str:
    cols = list(cols or df.columns)
    return ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in cols)


# V1 -------------------------------------------------------------------------
def fingerprint(df: DataFrame, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    return with_row_hashes(df, cols).agg(F.count(F.lit(1)).alias("row_count"), *_combined("one", "two")) \
        .select(F.lit(name).alias("dataset"), "row_count", F.lit(len(cols)).alias("column_count"),
                F.md5(F.lit(schema_text(df, cols))).alias("schema_hash"), "content_xor", "content_sum")


def dataset_manifest(tables: Mapping[str, DataFrame], cols: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    parts = [fingerprint(df, name, (cols or {}).get(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# V1 / V6 as a tree: files, folders, dataset ------------------------------------
FILE_MANIFEST = ("folder string, file string, file_size long, modified timestamp, row_count long, content_xor long, "
                 "content_sum long")


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """``path, folder, file, file_size, modified`` of a table's files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", *_place(), F.col("_metadata.file_size").alias("file_size"),
                        F.col("_metadata.file_modification_time").alias("modified"))


def _place() -> list[F.Column]:
    whole = F.col("_metadata.file_path")
    return [F.regexp_replace(whole, "/[^/]*$", "").alias("folder"), F.regexp_extract(whole, "([^/]*)$", 1).alias("file")]


def file_manifest(spark: SparkSession, path: str, files: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Leaves of the tree: row count and fingerprint of each of some files of the table at ``path``."""
    if not files:
        return spark.createDataFrame([], FILE_MANIFEST)
    schema = spark.read.parquet(path).schema
    df = spark.read.schema(schema).option("basePath", path).parquet(*files)
    keep = [*_place(), F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_modification_time").alias("modified")]
    leaf = ["folder", "file", "file_size", "modified"]
    return with_row_hashes(df, list(cols or df.columns), keep).groupBy(*leaf) \
        .agg(F.count(F.lit(1)).alias("row_count"), *_combined("one", "two"))


def update_manifest(spark: SparkSession, path: str, stored: DataFrame | None = None,
                    cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The file manifest of a table now, and the files that were read for it.

    Files that ``stored`` holds with the same size and time keep their
    fingerprints; only the others are scanned.  Files that are gone drop out.
    The paths of the scanned files pass the driver, as they do in any scan.
    """
    now = list_files(spark, path)
    leaf = ["folder", "file", "file_size", "modified"]
    if stored is None:
        stored = spark.createDataFrame([], FILE_MANIFEST)
    fresh = [r["path"] for r in now.join(stored.select(*leaf), leaf, "left_anti").select("path").collect()]
    known = stored.join(now.select(*leaf), leaf, "left_semi").select("folder", "file", "file_size", "modified", "row_count",
                                                                     "content_xor", "content_sum")
    return known.unionByName(file_manifest(spark, path, fresh, cols)), fresh


def fold_manifest(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inner nodes: fingerprints merged by folder, or (without ``by``) the root, which equals the table's own."""
    return files.groupBy(*by).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
                                  *_combined("content_xor", "content_sum"))


# V2 -------------------------------------------------------------------------
def dataset_metadata(df: DataFrame, label: str) -> DataFrame:
    """Rows, feature count (label excluded), class counts and columns with nulls."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    dist = counts.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws("=", F.col(label).cast("string"), F.col("n").cast("string")))), ",").alias("d"))
    nulls = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in df.columns])
    with_nulls = nulls.select(F.array_join(F.array_compact(F.array(
        *[F.when(F.col(c) > 0, F.lit(c)) for c in df.columns])), ",").alias("cols"))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len([c for c in df.columns if c != label])).alias("feature_count"),
        dist.scalar().alias("class_distribution"), with_nulls.scalar().alias("columns_with_nulls"))


# V3 -------------------------------------------------------------------------
def classify_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per dataset: unchanged / new (minor) / deleted (major) / schema (major) /
    rows (minor) / content (patch).  Schema and row counts are compared only
    when the content differs."""
    o = old.select("dataset", *[F.col(c).alias("old_" + c) for c in old.columns if c != "dataset"])
    n = new.select("dataset", *[F.col(c).alias("new_" + c) for c in new.columns if c != "dataset"])
    j = o.join(n, ["dataset"], "full_outer")
    same = (F.col("old_content_xor") == F.col("new_content_xor")) & \
        (F.col("old_content_sum") == F.col("new_content_sum")) & (F.col("old_row_count") == F.col("new_row_count"))
    change = (F.when(F.col("old_row_count").isNull(), "new")
              .when(F.col("new_row_count").isNull(), "deleted")
              .when(same, "unchanged")
              .when(F.col("old_schema_hash") != F.col("new_schema_hash"), "schema")
              .when(F.col("old_row_count") != F.col("new_row_count"), "rows")
              .otherwise("content"))
    level = (F.when(change.isin("deleted", "schema"), "major")
             .when(change.isin("new", "rows"), "minor")
             .when(change == "content", "patch").otherwise("none"))
    return j.select("dataset", change.alias("change"), level.alias("level"),
                    "old_row_count", "new_row_count")


LEVELS = ["none", "patch", "minor", "major"]


def overall_level(changes: DataFrame) -> DataFrame:
    pos = F.max(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))).cast("int")
    return changes.agg(F.element_at(F.array(*[F.lit(x) for x in LEVELS]), pos).alias("level"))


def next_version(prev: F.Column, level: F.Column) -> F.Column:
    """Semantic-version step: major resets minor and patch, minor resets patch."""
    parts = F.split(prev, r"\.")
    ma, mi, pa = (parts[i].cast("int") for i in range(3))
    return (F.when(prev.isNull(), F.lit("1.0.0"))
            .when(level == "major", F.concat_ws(".", (ma + 1).cast("string"), F.lit("0"), F.lit("0")))
            .when(level == "minor", F.concat_ws(".", ma.cast("string"), (mi + 1).cast("string"), F.lit("0")))
            .when(level == "patch", F.concat_ws(".", ma.cast("string"), mi.cast("string"), (pa + 1).cast("string")))
            .otherwise(prev))


# V4 -------------------------------------------------------------------------
def append_history(history: DataFrame | None, changes: DataFrame, created_at, spark: SparkSession) -> DataFrame:
    """New history row: version stepped from the latest one (first version is
    forced major), with a summary text of the changed datasets."""
    summary = changes.filter(F.col("change") != "unchanged").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "dataset", "change"))), "; ").alias("s"))
    lvl = overall_level(changes)
    if history is None:
        prev = F.lit(None).cast("string")
        level = F.lit("major")
    else:
        prev = history.agg(F.max_by("version", "created_at")).scalar()
        level = lvl.scalar()
    row = spark.range(1).select(next_version(prev, level).alias("version"),
                                F.lit(created_at).cast("timestamp").alias("created_at"),
                                level.alias("change_type"), F.coalesce(summary.scalar(), F.lit("")).alias("summary"))
    return row if history is None else history.unionByName(row)


# V5 -------------------------------------------------------------------------
def history_stats(history: DataFrame) -> DataFrame:
    """Versions per change type and the mean whole-day gap between versions."""
    from vigilo.operators.windows import gaps as gap_days
    # A version history has one row per release: a small, bounded table.
    gaps = gap_days(history, "created_at", bounded=True)
    by_type = history.groupBy("change_type").agg(F.count(F.lit(1)).alias("versions"))
    return by_type.withColumn("avg_gap_days", gaps.agg(F.avg("gap_days")).scalar())


# V6 -------------------------------------------------------------------------
def verify_manifest(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Status per stored dataset: ok, mismatch, or missing (absent now)."""
    c = current.select("dataset", F.col("content_xor").alias("cx"), F.col("content_sum").alias("cs"),
                       F.col("row_count").alias("cr"))
    j = stored.join(c, ["dataset"], "left")
    status = (F.when(F.col("cx").isNull(), "missing")
              .when((F.col("cx") == F.col("content_xor")) & (F.col("cs") == F.col("content_sum")) &
                    (F.col("cr") == F.col("row_count")), "ok").otherwise("mismatch"))
    return j.select("dataset", status.alias("status"))


# V7 -------------------------------------------------------------------------
def check_compatibility(profile: DataFrame, model_features: int | None, model_categorical: Sequence[str]) -> DataFrame:
    """Whether data fits a model, as one row: its profile (``feature``, ``kind``)
    against the model's feature count and categorical columns.  A count or a
    categorical set that either side does not state is not compared."""
    expected = ",".join(sorted(set(model_categorical)))
    seen = profile.agg(
        F.count(F.lit(1)).alias("data_features"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "categorical", F.col("feature")))), ",")
        .alias("data_categorical"))
    wanted = F.lit(model_features).cast("long")
    count_differs = F.coalesce((wanted != 0) & (F.col("data_features") != 0) & (F.col("data_features") != wanted), F.lit(False))
    sets_differ = (F.lit(expected) != "") & (F.col("data_categorical") != "") & (F.col("data_categorical") != F.lit(expected))
    issues = F.concat_ws("; ", F.when(count_differs, "feature count mismatch"),
                         F.when(sets_differ, "categorical column mismatch"))
    return seen.select("data_features", wanted.alias("model_features"), "data_categorical",
                       F.lit(expected).alias("model_categorical"), (issues == "").alias("compatible"), issues.alias("issues"))
