"""Stream = batch for the streaming rollup (M3) and the stateful alert policy."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilo.operators import alerts as AL
from vigilo.operators import monitor as MO
from vigilo.plans.catalog.monitoring import _candidates, metric_rows
from vigilo.streaming.alerts import alert_stream
from vigilo.streaming.rollup import rollup_stream

SF = "/root/testdata/sf0.001"


def _chunks(spark, df, ts, path, n=3):
    """Write ``df`` as ``n`` time-ordered Parquet files (one per trigger)."""
    bounds = df.select(F.min(ts).cast("long").alias("a"), F.max(ts).cast("long").alias("b")).first()
    step = (bounds["b"] - bounds["a"]) / n + 1
    part = ((F.col(ts).cast("long") - bounds["a"]) / step).cast("int")
    for i in range(n):
        df.filter(part == i).coalesce(1).write.mode("overwrite").parquet(f"{path}/part={i:03d}")
    return df.schema


def _run(sdf, name):
    q = sdf.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return sdf.sparkSession.table(name)


@pytest.mark.parametrize("slide", [None, "15 minutes"])
def test_rollup_stream_equals_batch(spark, tmp_path, slide):
    rows = metric_rows(spark, SF).select("timestamp", "metric_name", "value")
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    schema = _chunks(spark, rows, "timestamp", str(tmp_path / "src"))
    sdf = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(str(tmp_path / "src")))
    name = "rollup_" + ("tumble" if slide is None else "slide")
    got = _run(rollup_stream(sdf, "1 hour", slide, watermark="0 seconds"), name)
    got = got.drop("p50", "p95", "p99").toPandas()
    want = MO.rollup_windows(rows, "1 hour", slide).drop("p50", "p95", "p99").toPandas()
    assert len(got) > 0
    # Append mode emits a window once the watermark passes its end: every
    # emitted window must equal the batch window exactly.
    m = got.merge(want, on=["window_start", "window_end", "metric_name"], suffixes=("", "_b"))
    assert len(m) == len(got)
    for c in ("count", "sum", "min", "max", "mean", "std"):
        assert (m[c] - m[c + "_b"]).abs().max() < 1e-6, c
    # Everything except windows still open at the end of the input was emitted.
    last_end = want["window_end"].max()
    open_windows = want[want["window_end"] >= last_end - pd.Timedelta(hours=1)]
    assert len(got) >= len(want) - len(open_windows)


RULES = [("slow", "a", 0.0, "low", ["log"], 30), ("fast", "b", 0.0, "high", ["log"], 10)]
DECIDED = "tenant string, alert_type string, metric string, detail long, ts timestamp, cooldown_minutes int"


def _decisions(spark, path, rows, files, name, **options):
    """Decisions of the stream over ``rows`` cut into ``files`` micro-batches; the state rows left at the end."""
    for k in range(files):
        part = rows[k * len(rows) // files:(k + 1) * len(rows) // files]
        spark.createDataFrame(part, DECIDED).coalesce(1).write.parquet(f"{path}/part={k:03d}")
    sdf = spark.readStream.schema(DECIDED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    out = alert_stream(sdf, AL.rules_table(spark, RULES), order=["detail"], tenant_cols=["tenant"], max_alerts=3,
                       candidates=True, **options)
    q = out.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    return {r.detail: (r.emitted, r.suppressed_by) for r in spark.table(name).collect()}, left


def _signals(n=240):
    rng = random.Random(3)
    t, rows = datetime(2024, 1, 1), []
    for k in range(n):
        t += timedelta(minutes=rng.choice([0, 1, 4, 11]))
        rows.append((rng.choice(["x", "y"]), rng.choice(["a", "b"]), rng.choice(["m", None]), k, t, rng.choice([10, 30])))
    return rows


def test_one_batch_and_ten_decide_alike(spark, tmp_path):
    rows = _signals()
    one, _ = _decisions(spark, str(tmp_path / "one"), rows, 1, "alerts_one")
    ten, _ = _decisions(spark, str(tmp_path / "ten"), rows, 10, "alerts_ten")
    batch = AL.apply_alert_policy(spark.createDataFrame(rows, DECIDED), max_alerts=3, tenant_cols=["tenant"], order=["detail"])
    want = {r.detail: (r.emitted, r.suppressed_by) for r in batch.collect()}
    assert one == ten == want and {s for _, s in want.values()} == {None, "cooldown", "rate_limit"}


def test_state_goes_after_the_longest_cooldown(spark, tmp_path):
    rows = _signals(60)
    end = rows[-1][4]
    rows += [("z", "a", None, 1000 + k, end + timedelta(hours=3 + 3 * k), 10) for k in range(3)]
    got, left = _decisions(spark, str(tmp_path / "late"), rows, 21, "alerts_expiry", watermark="0 seconds")
    assert len(got) == len(rows) and all(got[1000 + k] == (True, None) for k in range(3))
    assert left <= 6            # what tenant z's last signal holds; nothing of x and y


def test_a_late_signal_is_decided_as_of_now(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("x", "a", None, 1, t + timedelta(minutes=50), 30), ("x", "b", None, 2, t + timedelta(minutes=10), 10),
            ("x", "a", None, 3, t + timedelta(minutes=5), 30)]
    got, _ = _decisions(spark, str(tmp_path / "order"), rows, 3, "alerts_late")
    assert got == {1: (True, None), 2: (True, None), 3: (False, "cooldown")}


def test_tables_are_not_streams(spark):
    with pytest.raises(ValueError):
        alert_stream(spark.createDataFrame(_signals(1), DECIDED), AL.rules_table(spark), candidates=True)


def test_alert_stream_equals_batch(spark, tmp_path):
    cand = _candidates(spark, SF).select("alert_type", "metric", "detail", "ts", "value", "severity",
                                         "cooldown_minutes")
    cand = cand.withColumn("ts", F.col("ts").cast("timestamp"))
    schema = _chunks(spark, cand, "ts", str(tmp_path / "alerts"), n=4)
    sdf = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(str(tmp_path / "alerts")))
    rules = AL.rules_table(spark)
    out = alert_stream(sdf, rules, ts="ts", order=["alert_type", "detail"], max_alerts=4, candidates=True)
    got = _run(out, "alert_stream").toPandas()
    want = AL.apply_alert_policy(cand, ["alert_type", "metric"], 4, 60, ts="ts",
                                 order=["alert_type", "detail"]).toPandas()
    key = ["alert_type", "detail", "ts"]
    m = got.merge(want, on=key, suffixes=("", "_b"))
    assert len(m) == len(want) == len(got)
    assert (m["emitted"] == m["emitted_b"]).all()
    assert m["emitted"].sum() > 0 and (~m["emitted"]).sum() > 0
