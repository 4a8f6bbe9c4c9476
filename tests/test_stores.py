"""Merged stream tables, retention on disk, manifests by file, ordered alert scans."""

import glob
import os
import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilo.operators import alerts as AL
from vigilo.operators import monitor as MO
from vigilo.operators import versions as V
from vigilo.sources import tables as TB
from vigilo.streaming.merged import _folders, compact, merge_batches, read_merged, start_merge
from vigilo.streaming.rollup import rollup_stream

KEYS = ["window_start", "window_end", "metric_name"]
START = datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- M3
@pytest.fixture
def source(spark, tmp_path):
    """Six files of events, each a little out of order against the one before."""
    rng = random.Random(1)
    rows = [(START + timedelta(minutes=k // 3 + rng.randrange(-20, 20)), f"m{k % 3}", float(rng.randrange(100))) for k in range(900)]
    rows += [(START, "m0", None)]
    path = str(tmp_path / "events")
    for k in range(6):
        spark.createDataFrame(rows[k * 150:(k + 1) * 150] + rows[900:], "timestamp timestamp, metric_name string, value double") \
            .coalesce(1).write.parquet(f"{path}/part={k}")
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    return df, stream


@pytest.mark.parametrize("slide", [None, "15 minutes"])
def test_merged_rollup_holds_every_window(spark, tmp_path, source, slide):
    df, stream = source
    agg = rollup_stream(stream, "1 hour", slide, watermark="1 hour", chained=False)
    path = str(tmp_path / "table")
    start_merge(agg, path, str(tmp_path / "check"), KEYS, available_now=True, compact_every=2).awaitTermination()
    bases, batches = _folders(spark, path)
    assert bases and len(batches) < 6                      # older batches are covered by snapshots
    got = read_merged(spark, path, KEYS, agg.schema).drop("p50", "p95", "p99")
    want = MO.rollup_windows(df, "1 hour", slide).drop("p50", "p95", "p99")
    assert rows_of(got) == rows_of(want)
    assert rows_of(got.filter(F.col("window_end") == want.agg(F.max("window_end")).first()[0]))      # the last windows too


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "k string, v long, w string"
    one = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), (None, 1, "n")], schema)
    two = spark.createDataFrame([("a", 2, None), ("c", 2, "z")], schema)
    write = merge_batches(path, ["k"], compact_every=100)
    write(one, 0)
    write(two, 1)
    want = [("a", 2, None), ("b", 1, None), ("c", 2, "z"), (None, 1, "n")]
    assert rows_of(read_merged(spark, path, ["k"], one.schema)) == sorted(want, key=repr)
    write(two, 1)
    assert rows_of(read_merged(spark, path, ["k"], one.schema)) == sorted(want, key=repr)
    compact(spark, path, ["k"], one.schema, 1)
    write(two, 1)
    write(spark.createDataFrame([("b", 3, "late")], schema), 2)
    want[1] = ("b", 3, "late")
    assert rows_of(read_merged(spark, path, ["k"], one.schema)) == sorted(want, key=repr)
    assert len(rows_of(read_merged(spark, path, ["k"], one.schema, upto=0))) == 3


def test_an_unfinished_folder_is_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    write = merge_batches(path, ["k"])
    write(df, 0)
    write(df.withColumn("v", F.lit(9).cast("long")), 1)
    os.remove(f"{path}/batch_id=1/_SUCCESS")
    assert rows_of(read_merged(spark, path, ["k"], df.schema)) == [("a", 1)]
    assert read_merged(spark, str(tmp_path / "none"), ["k"], df.schema).count() == 0


# ---------------------------------------------------------------- S8
def test_expired_rows_are_deleted_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(START + timedelta(hours=7 * k), float(k)) for k in range(100)] + [(None, -1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    TB.append_table(df, path, "ts")
    files = {os.path.basename(d): sorted(glob.glob(d + "/*.parquet")) for d in glob.glob(path + "/dt=*")}
    as_of, days = "2024-01-20 10:00:00", 5
    cut = datetime(2024, 1, 15, 10)
    report = {r.dt: (r.rows_before, r.rows_removed) for r in TB.delete_expired(spark, path, "ts", days, as_of).collect()}
    left = rows_of(spark.read.parquet(path).select("ts", "value"))
    assert left == sorted([r for r in rows if r[0] is None or r[0] >= cut], key=repr)
    assert sum(n for _, n in report.values()) == sum(r[0] is not None and r[0] < cut for r in rows)
    assert report[cut.date()][0] > report[cut.date()][1] > 0
    after = {os.path.basename(d): sorted(glob.glob(d + "/*.parquet")) for d in glob.glob(path + "/dt=*")}
    assert min(after) == "dt=2024-01-15"                                       # older folders are gone
    assert all(after[d] == files[d] for d in after if d > "dt=2024-01-15")      # younger ones untouched
    again = TB.delete_expired(spark, path, "ts", days, as_of)
    assert sum(r.rows_removed for r in again.collect()) == 0
    assert rows_of(spark.read.parquet(path).select("ts", "value")) == left


def test_a_cut_day_without_survivors_goes(spark, tmp_path):
    path = str(tmp_path / "store")
    TB.append_table(spark.createDataFrame([(START, 1.0), (START + timedelta(days=3), 2.0)], "ts timestamp, value double"), path, "ts")
    report = TB.delete_expired(spark, path, "ts", 1, "2024-01-02 12:00:00").collect()
    assert [(r.rows_before, r.rows_removed) for r in report] == [(1, 1)]
    assert [os.path.basename(d) for d in glob.glob(path + "/dt=*")] == ["dt=2024-01-04"]
    with pytest.raises(ValueError):
        TB.delete_expired(spark, path, "ts", 1)


# ---------------------------------------------------------------- V1, V6
def test_only_changed_files_are_read_again(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(200).select("id", (F.col("id") % 4).alias("k"), (F.col("id") / 7).alias("x"), F.concat(F.lit("t "), "id").alias("t"))
    df.repartition(3).write.partitionBy("k").parquet(path)
    cols = ["id", "k", "x", "t"]
    first, read = V.update_manifest(spark, path, cols=cols)
    first = first.checkpoint()
    assert len(read) == len(glob.glob(path + "/*/*.parquet")) and first.count() == len(read)
    root = V.fold_manifest(first).first()
    whole = V.fingerprint(spark.read.parquet(path), "t", cols).first()
    assert (root.row_count, root.content_xor, root.content_sum) == (whole.row_count, whole.content_xor, whole.content_sum)

    same, read = V.update_manifest(spark, path, first, cols)
    assert read == [] and rows_of(V.fold_manifest(same, ["folder"])) == rows_of(V.fold_manifest(first, ["folder"]))

    spark.createDataFrame([(1000, 2, 0.5, "new")], "id long, k long, x double, t string").coalesce(1) \
        .write.mode("append").partitionBy("k").parquet(path)
    os.remove(sorted(glob.glob(path + "/k=3/*.parquet"))[0])
    spark.catalog.refreshByPath(path)
    second, read = V.update_manifest(spark, path, first, cols)
    assert len(read) == 1 and "/k=2/" in read[0]
    root = V.fold_manifest(second).first()
    whole = V.fingerprint(spark.read.parquet(path), "t", cols).first()
    assert (root.row_count, root.content_xor, root.content_sum) == (whole.row_count, whole.content_xor, whole.content_sum)
    changed = {r.folder[-3:] for r in V.fold_manifest(second, ["folder"]).exceptAll(V.fold_manifest(first, ["folder"])).collect()}
    assert changed == {"k=2", "k=3"}


# ---------------------------------------------------------------- M12, M13
def plain_policy(rows, most, window):
    out, recent, last = [], deque(), {}
    for t, kind, metric, minutes in rows:
        while recent and recent[0] <= t - timedelta(minutes=window):
            recent.popleft()
        if (kind, metric) in last and last[kind, metric] > t - timedelta(minutes=minutes):
            out.append("cooldown")
        elif len(recent) >= most:
            out.append("rate_limit")
        else:
            out.append(None)
            last[kind, metric] = t
            recent.append(t)
    return out


@pytest.mark.parametrize("tenants", [["tenant"], []])
def test_ordered_scan_carries_state_over_batches(spark, tenants):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]) if tenants else "a", START + timedelta(minutes=rng.randrange(20000 if k % 2 else 3000)),
             rng.choice(["x", "y"]), rng.choice(["m", None]), rng.choice([5, 30]), k) for k in range(700)]
    df = spark.createDataFrame(rows, "tenant string, ts timestamp_ntz, alert_type string, metric string, cooldown_minutes int, k long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r.k: r for r in AL.apply_alert_policy(df.repartition(5), max_alerts=3, tenant_cols=tenants, order=["k"]).collect()}
        limit = {r.k: r.emitted for r in AL.apply_rate_limit(df, 3, tenant_cols=tenants, order=["k"]).collect()}
        cooled = AL.apply_cooldown(df, order=["k"], longest_cooldown=30)
        both = AL.apply_rate_limit(cooled, 3, tenant_cols=tenants, order=["k"], only_where="emitted").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(limit) == len(both) == len(rows) and "_cand" not in both[0].asDict()
    cooled = {r.k: r.emitted for r in cooled.collect()}
    assert all(cooled[r.k] for r in both if r.emitted)
    for tenant in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == tenant), key=lambda r: (r[1], r[5]))
        want = plain_policy([(r[1], r[2], r[3], r[4]) for r in own], 3, 60)
        assert [got[r[5]].suppressed_by for r in own] == want
        assert [got[r[5]].emitted for r in own] == [w is None for w in want]
        alone = plain_policy([(r[1], r[5], None, 0) for r in own], 3, 60)
        assert [limit[r[5]] for r in own] == [w is None for w in alone]


# ---------------------------------------------------------------- Q9, training rows
def test_cleaning_is_counted_by_the_writing_pass(spark, tmp_path):
    from vigilo.plans.cleaning import clean_transactions, write_cleaned
    rows = [("2024-01-02 00:00:00", 1, 5, "a", "x"), ("nonsense", 1, None, "a", "x"), ("2031-01-01 00:00:00", 2, -1, None, "nan"),
            ("2024-01-02 00:00:00", 1, 5, "a", "x"), (None, -3, 4, "a", "x"), ("2024-01-03 00:00:00", 3, -7, "a", "x")]
    df = spark.createDataFrame(rows, "txn_dt string, patient_id long, physician_id long, txn_type string, txn_desc string")
    path = str(tmp_path / "clean")
    got = write_cleaned(df.repartition(3), "2025-01-01 00:00:00", path).first().asDict()
    assert got == {"initial_rows": 6, "invalid_dates": 1, "future_dates": 1, "filled_physician_ids": 1, "invalid_patient_ids": 1,
                   "invalid_physician_ids": 1, "final_rows": 3}
    assert rows_of(spark.read.parquet(path)) == rows_of(clean_transactions(df, "2025-01-01 00:00:00", sort=False))
    empty = write_cleaned(df.limit(0), "2025-01-01 00:00:00", str(tmp_path / "none")).first()
    assert set(empty.asDict().values()) == {0}


def test_training_rows_lie_alike_however_the_input_was_cut(spark):
    from vigilo.operators.ml import spread
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("x"))
    place = [[(r.p, r.id) for r in spread(d, 4).select(F.spark_partition_id().alias("p"), "id").collect()]
             for d in (df, df.repartition(9), df.orderBy(F.desc("id")))]
    assert place[0] == place[1] == place[2] and len({p for p, _ in place[0]}) == 4
