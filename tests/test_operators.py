"""Operator unit tests on small hand tables (nulls, ties, boundaries), brute-force
checks of the distributed order-based operators, and partition-count invariance."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilo.functions import scalar as S
from vigilo.operators import aggregates as A
from vigilo.operators import alerts as AL
from vigilo.operators import drift as DR
from vigilo.operators import joins as J
from vigilo.operators import versions as V
from vigilo.operators import windows as W
from vigilo.operators.ordered import exact_quantiles, prefix_sums


def one(df, col):
    return [r[col] for r in df.collect()]


# ---- scalar functions -------------------------------------------------------------
def test_text_cleaning(spark):
    df = spark.createDataFrame([(" o'neil-smith md/phd\t",), ("\tnan ",), (None,), ("MALE",), ("male",)], "s string")
    out = df.select(S.standardize_case("s", "title").alias("t"), S.normalize_blank("s").alias("b"),
                    S.map_values(S.normalize_blank("s"), {"male": "M"}, "Unknown").alias("g")).collect()
    assert out[0]["t"] == "O'Neil-Smith Md/Phd"
    assert out[1]["b"] == "Unknown" and out[2]["b"] == "Unknown"
    assert out[3]["g"] == "Unknown" and out[4]["g"] == "M"   # the map is case-sensitive


def test_day_diff_and_window_flag(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 1), datetime(2024, 1, 1, 23)),
                                (datetime(2024, 1, 6, 0), datetime(2024, 1, 1, 0)),
                                (datetime(2024, 1, 6, 0), None)], "a timestamp, b timestamp")
    d = df.select(S.day_diff("a", "b").alias("d"), S.within_days(S.day_diff("a", "b"), 5).alias("w")).collect()
    assert [r["d"] for r in d] == [0, 5, None]       # 24-hour floor, not calendar days
    assert [r["w"] for r in d] == [1, 1, 1]          # missing difference counts as inside


def test_band_and_levels(spark):
    df = spark.createDataFrame([(200,), (199,), (20,), (19,), (None,)], "n int")
    got = one(df.select(S.band("n", [(200, "High"), (20, "Medium")], "Low", null_label="Low").alias("b")), "b")
    assert got == ["High", "Medium", "Medium", "Low", "Low"]
    lv = spark.createDataFrame([("HIGH_CONTRAINDICATION",), ("OTHER",), (None,)], "d string")
    assert one(lv.select(S.level_of("d", {"HIGH_CONTRAINDICATION": 3}).alias("l")), "l") == [3, 0, 0]


def test_keyword_groups_and_first_contains(spark):
    df = spark.createDataFrame([("chronic copd",), ("Heart_Disease and obesity",), ("none",)], "t string")
    g = one(df.select(S.match_keyword_groups("t", {"lung": ["COPD"], "cvd": ["HEART_DISEASE"],
                                                   "obese": ["OBESITY"]}).alias("g")), "g")
    assert g == [["lung"], ["cvd", "obese"], []]
    c = one(df.select(S.map_exact_or_contains("t", ["obesity", "copd"]).alias("c")), "c")
    assert c == ["copd", None, None] or c[0] == "copd"


# ---- joins ---------------------------------------------------------------------------
def test_lookback_boundaries(spark):
    idx = spark.createDataFrame([(1, datetime(2024, 1, 10))], "k int, index_ts timestamp")
    ev = spark.createDataFrame([(1, datetime(2024, 1, 5)), (1, datetime(2024, 1, 4, 23, 59, 59)),
                                (1, datetime(2024, 1, 10)), (1, datetime(2024, 1, 10, 0, 0, 1))],
                               "k int, ts timestamp")
    got = sorted(one(J.lookback_within(ev, idx, "k", "ts", "index_ts", 5), "ts"))
    assert got == [datetime(2024, 1, 5), datetime(2024, 1, 10)]   # both ends inclusive


def test_referential_filter_keeps_sentinel(spark):
    fact = spark.createDataFrame([(1,), (-1,), (7,), (None,)], "p int")
    dim = spark.createDataFrame([(1,)], "p int")
    assert sorted(one(J.keep_referenced(fact, dim, "p", allow=[-1]), "p")) == [-1, 1]
    assert one(J.orphan_keys(fact, dim, "p"), "p") == [7]


def test_index_event_tie_break(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), 5, "b"), (1, datetime(2024, 1, 1), 3, "a"),
                                (2, datetime(2024, 1, 2), 1, "c")], "k int, ts timestamp, id int, v string")
    first = {r["k"]: r["v"] for r in W.index_event(df, "k", "ts", tie=["id"]).collect()}
    assert first == {1: "a", 2: "c"}
    with pytest.raises(ValueError):
        W.dedupe(df, ["k"])    # a subset needs an explicit order


# ---- order-based operators vs brute force ------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 8])
def test_prefix_sums_any_partitioning(spark, parts):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "v": rng.permutation(400).astype(float),
                        "w": rng.integers(0, 9, 400).astype(float)})
    out = prefix_sums(spark.createDataFrame(pdf).repartition(parts), "v", ["w"], ["g"]).toPandas()
    exp = pdf.sort_values(["g", "v"]).assign(cum=lambda d: d.groupby("g").w.cumsum())
    m = out.merge(exp, on=["g", "v"])
    assert len(m) == 400 and np.allclose(m.cum_w, m.cum)


def test_exact_quantiles_match_numpy(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([("x", v) for v in vals], "g string, v double")
    got = {r["q"]: r["v"] for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9]).collect()}
    arr = np.array([v for v in vals if v is not None])
    for q in (0.25, 0.5, 0.9):
        assert abs(got[q] - np.quantile(arr, q)) < 1e-12


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def _brute_ap(y, s):
    order = np.argsort(-s, kind="mergesort")
    total, ap, prev_recall = y.sum(), 0.0, 0.0
    for t in np.unique(s)[::-1]:
        sel = s >= t
        tp = (y[sel] == 1).sum()
        recall, precision = tp / total, tp / sel.sum()
        ap += (recall - prev_recall) * precision
        prev_recall = recall
    del order
    return ap


def test_roc_and_average_precision_with_ties(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(300), 1)                 # many ties
    y = (rng.random(300) < 0.3 + 0.4 * s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert abs(W.roc_auc(df, "y", "s").first()[0] - _brute_auc(y, s)) < 1e-12
    assert abs(W.average_precision(df, "y", "s").first()[0] - _brute_ap(y, s)) < 1e-12


def test_rank_and_cumulative_share(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 5.0), ("d", 0.0), ("e", 1.0)], "k string, v double")
    ranks = {r["k"]: r["rank"] for r in W.rank_desc(df, "v").collect()}
    assert ranks == {"b": 1, "a": 2, "c": 2, "e": 4, "d": 5}
    share = {r["k"]: r["cumulative_share"] for r in W.cumulative_share(df, "v").collect()}
    assert "d" not in share and share["b"] == pytest.approx(7 / 18) and share["a"] == pytest.approx(17 / 18)


def test_ks_and_wasserstein_vs_numpy(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(0, 1, 200).round(2), rng.normal(0.3, 1.2, 150).round(2)
    ref = spark.createDataFrame(pd.DataFrame({"x": a}))
    new = spark.createDataFrame(pd.DataFrame({"x": b}))
    r = DR.ks_drift(ref, new, ["x"]).first()
    grid = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert r["ks_statistic"] == pytest.approx(np.abs(fa - fb).max())
    w1 = np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))
    assert r["wasserstein_normalized"] == pytest.approx(w1 / (grid.max() - grid.min()))
    assert 0.0 <= r["p_value"] <= 1.0


def test_chi2_yates_and_p_value(spark):
    ref = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "c string")
    new = spark.createDataFrame([("a",)] * 10 + [("b",)] * 30, "c string")
    r = DR.chi2_drift(ref, new, ["c"]).first()
    obs = np.array([[30, 10], [10, 30]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    yates = (np.maximum(np.abs(obs - exp) - 0.5, 0) ** 2 / exp).sum()
    assert r["chi2"] == pytest.approx(yates) and r["dof"] == 1 and r["drift_detected"]
    assert DR.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert DR.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)


# ---- aggregates ------------------------------------------------------------------------
def test_sample_moments_and_mode(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 9.0]
    st = A.feature_stats(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"]).first()
    s = pd.Series(vals)
    assert st["skewness"] == pytest.approx(s.skew()) and st["kurtosis"] == pytest.approx(s.kurt())
    m = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert A.mode_of(m, "c").first()["mode"] == "a"        # ties: smallest


def test_classification_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = A.classification_metrics(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


# ---- alerts (FIXTURES section 6) ----------------------------------------------------------
T0 = datetime(2024, 1, 1, 0, 0)


def _alerts(spark, rows):
    return spark.createDataFrame(rows, "alert_type string, metric string, ts timestamp, cooldown_minutes int, id int")


def test_cooldown_against_sent_alerts(spark):
    rows = [("data_drift", None, T0, 60, 1),
            ("data_drift", None, T0 + timedelta(minutes=30), 60, 2),   # inside: suppressed
            ("data_drift", None, T0 + timedelta(minutes=60), 60, 3),   # exactly at the end: sent
            ("data_drift", None, T0 + timedelta(minutes=90), 60, 4),   # predecessor (3) was sent: suppressed
            ("data_drift", None, T0 + timedelta(minutes=125), 60, 5),  # 65 min after 3: sent
            ("model_error", "x", T0 + timedelta(minutes=30), 60, 6)]   # other key: sent
    sent = {r["id"]: r["emitted"] for r in AL.apply_cooldown(_alerts(spark, rows), order=["id"]).collect()}
    assert sent == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_rate_limit_eleven_in_one_hour(spark):
    rows = [("t%d" % (i % 3), None, T0 + timedelta(minutes=5 * i), 0, i) for i in range(11)]
    sent = {r["id"]: r["emitted"] for r in AL.apply_rate_limit(_alerts(spark, rows), 10, 60, order=["id"]).collect()}
    assert sum(sent.values()) == 10 and sent[10] is False


def test_policy_matches_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(["a", "b"])), None, T0 + timedelta(minutes=int(m)), int(rng.choice([10, 30])), i)
            for i, m in enumerate(sorted(rng.integers(0, 600, 120)))]
    got = {r["id"]: r["emitted"] for r in
           AL.apply_alert_policy(_alerts(spark, rows), max_alerts=4, order=["id"]).collect()}
    last, recent, exp = {}, [], {}
    for t, m, ts, cd, i in sorted(rows, key=lambda r: (r[2], r[4])):
        if t in last and last[t] > ts - timedelta(minutes=cd):
            exp[i] = False
            continue
        recent = [x for x in recent if x > ts - timedelta(hours=1)]
        exp[i] = len(recent) < 4
        if exp[i]:
            last[t] = ts
            recent.append(ts)
    assert got == exp


def test_rules_severity_is_ordinal_and_rules_table_ops(spark):
    rules = AL.rules_table(spark)
    sig = spark.createDataFrame([("s1", "data_drift", 0.35), ("s2", "data_drift", 0.1)],
                                "signal_id string, alert_type string, value double")
    out = {r["signal_id"]: r for r in AL.evaluate_rules(sig, rules).collect()}
    assert out["s1"]["severity"] == "critical" and out["s1"]["cooldown_minutes"] == 120 and "s2" not in out
    inline = {r["signal_id"]: r for r in AL.evaluate_rules_inline(sig, rules).collect()}
    assert inline["s1"]["severity"] == "critical" and list(inline["s1"]["channels"]) == ["console", "email", "log"]
    new = spark.createDataFrame([("Model Error Rate", "model_error", 0.5, "high", ["log"], 5, True)], AL.RULE_SCHEMA)
    merged = AL.upsert_rules(rules, new)
    assert merged.count() == 5 and merged.filter("name = 'Model Error Rate'").first()["threshold"] == 0.5
    assert AL.remove_rule(merged, "Model Error Rate").count() == 4


def test_alert_state(spark):
    alerts = spark.createDataFrame([("a",), ("b",), ("c",)], "alert_id string")
    acts = spark.createDataFrame([("a", T0, "acknowledge"), ("a", T0 + timedelta(1), "resolve"),
                                  ("b", T0, "acknowledge")], "alert_id string, ts timestamp, action string")
    st = {r["alert_id"]: r["status"] for r in AL.alert_state(alerts, acts).collect()}
    assert st == {"a": "resolved", "b": "acknowledged", "c": "active"}


# ---- versions ----------------------------------------------------------------------------
def test_fingerprint_is_order_and_partition_insensitive(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(500)], "k int, v string")
    a = V.fingerprint(df, "t").first()
    b = V.fingerprint(df.repartition(7).orderBy(F.desc("k")), "t").first()
    assert (a["content_xor"], a["content_sum"], a["row_count"]) == (b["content_xor"], b["content_sum"], b["row_count"])
    c = V.fingerprint(df.withColumn("v", F.when(F.col("k") == 3, "zz").otherwise(F.col("v"))), "t").first()
    assert c["content_xor"] != a["content_xor"]


def test_fingerprint_sees_every_column_and_field(spark):
    def mark(rows):
        r = V.fingerprint(spark.createDataFrame(rows, "a string, b string, x double"), "t").first()
        return r["content_xor"], r["content_sum"]
    base = [("a|b", "c", 1.5), ("k", None, 2.25)]
    assert mark(base) != mark([("a", "b|c", 1.5), ("k", None, 2.25)])
    assert mark(base) != mark([("a|b", "c", 1.5), ("k", "N", 2.25)])
    assert mark(base) != mark([("a|b", "c", 1.5), ("k", None, 2.2500000000000004)])
    old = V.fingerprint(spark.createDataFrame(base, "a string, b string, x double"), "t")
    new = V.fingerprint(spark.createDataFrame([("a|b", "c", 1.51), base[1]], "a string, b string, x double"), "t")
    assert V.classify_change(old, new).first()["change"] == "content"


def test_compatibility_rules(spark):
    profile = spark.createDataFrame([("a", "numeric"), ("c", "categorical")], "feature string, kind string")
    same = V.check_compatibility(profile, 2, ["c"]).first()
    assert same["compatible"] and same["issues"] == ""
    off = V.check_compatibility(profile, 3, ["c", "d"]).first()
    assert not off["compatible"] and off["issues"] == "feature count mismatch; categorical column mismatch"
    assert V.check_compatibility(profile, None, []).first()["compatible"]


def test_version_step(spark):
    row = spark.range(1).select(V.next_version(F.lit("1.4.2"), F.lit("minor")).alias("v"),
                                V.next_version(F.lit("1.4.2"), F.lit("major")).alias("w")).first()
    assert (row["v"], row["w"]) == ("1.5.0", "2.0.0")


# ---- partition-count invariance of whole queries ---------------------------------------------
@pytest.mark.parametrize("name", ["index_lookback", "model_ready_features", "roc_auc", "ks_drift"])
def test_same_result_at_1_and_8_partitions(spark, name):
    from tests.oracle import rows
    from vigilo.plans.catalog import REGISTRY
    sf = "/root/testdata/sf0.001"
    res = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(rows(REGISTRY[name].fn(spark, sf).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1]


def test_roc_pr_single_pass_matches_separate(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.choice(["m1", "m2"], 400), "s": np.round(rng.random(400), 2)})
    pdf["y"] = (rng.random(400) < 0.2 + 0.6 * pdf.s).astype(int)
    df = spark.createDataFrame(pdf)
    both = {r["g"]: r for r in W.roc_pr(df, "y", "s", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert both[g]["roc_auc"] == pytest.approx(_brute_auc(part.y.values, part.s.values))
        assert both[g]["pr_auc"] == pytest.approx(_brute_ap(part.y.values, part.s.values))


# ---- patient store documents (S3, P27, P23 form score) ------------------------------------------
def test_documents_both_layouts_to_events_and_form_risk(spark, tmp_path):
    import json
    from vigilo.plans import features as FE
    from vigilo.sources.tables import read_documents
    p1 = {"id": 1, "age": 70, "comorbidities": ["DIABETES", "COPD"], "symptoms": ["FEVER"],
          "diagnosisDate": "2025-10-21", "contraindicationLevel": "Medium"}
    p2 = {"id": 2, "age": 30, "comorbidities": [], "symptoms": ["COUGH", "FEVER"],
          "diagnosisDate": "2025-10-20", "contraindicationLevel": "Low"}
    (tmp_path / "new.json").write_text(json.dumps({"metadata": {"total_patients": 1}, "patients": [p1]}))
    (tmp_path / "legacy.json").write_text(json.dumps({"metadata": {"total_patients": 1},
                                                       "doctor_input_patients": [p2]}))
    docs = read_documents(spark, str(tmp_path / "new.json")).unionByName(
        read_documents(spark, str(tmp_path / "legacy.json")), allowMissingColumns=True)
    ev = FE.documents_to_events(docs).toPandas()
    assert sorted(ev[ev.patient_id == 1].txn_desc) == ["COPD", "DIABETES", "FEVER"]
    # No condition row in document 2: a DISEASE_X row is added.
    assert sorted(ev[ev.patient_id == 2].txn_desc) == ["COUGH", "DISEASE_X", "FEVER"]
    risk = {r["id"]: r for r in FE.form_risk(docs).collect()}
    assert risk[1]["risk_score"] == (2 * 2 + 1 + 3) * 1.5 and risk[1]["risk_level"] == "High Risk"
    assert risk[1]["has_alert"] is True
    assert risk[2]["risk_score"] == 2.0 and risk[2]["risk_level"] == "Low Risk" and risk[2]["has_alert"] is False


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_running_totals_do_not_need_a_reused_exchange(spark, reuse):
    import numpy as np
    import pandas as pd
    from vigilo.operators.ordered import prefix_sums
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 500), rng.pareto(1, 500) * 1e6, -rng.pareto(1, 200), [0.0, 1e300, -1e300]])
    pdf = pd.DataFrame({"v": np.unique(values)})
    pdf["w"] = 1
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        for descending in (False, True):
            out = prefix_sums(spark.createDataFrame(pdf).repartition(7), "v", ["w"], descending=descending, with_next=True)
            assert "MapInPandas" not in out._jdf.queryExecution().toString()
            got = out.toPandas().sort_values("v", ascending=not descending)
            assert got.cum_w.tolist() == list(range(1, len(pdf) + 1))
            assert got._next.tolist()[:-1] == got.v.tolist()[1:]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_running_totals_over_texts_and_dates(spark):
    from datetime import date, timedelta
    from vigilo.operators.ordered import prefix_sums
    rows = [(f"k{i:05d}é" if i % 3 else f"z{i}", date(2020, 1, 1) + timedelta(days=i), 1) for i in range(3000)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "t string, d date, w int")
    for col in ("t", "d"):
        got = prefix_sums(df, col, ["w"]).toPandas()
        got = got.assign(k=got[col].map(lambda x: (x is None, str(x).encode()))).sort_values("k")
        assert got.cum_w.tolist() == list(range(1, 3002))


def test_a_row_without_a_date_is_never_the_first_event(spark):
    from vigilo.operators.windows import dedupe, index_event
    df = spark.createDataFrame([(1, None, "x"), (1, "2024-01-01", "y"), (2, None, "z")], "k int, ts string, v string")
    assert {(r.k, r.v) for r in index_event(df, "k", "ts").collect()} == {(1, "y"), (2, "z")}
    assert {(r.k, r.v) for r in dedupe(df, ["k"], ["ts"]).collect()} == {(1, "y"), (2, "z")}


def test_new_ids_follow_the_whole_order(spark):
    from vigilo.operators.joins import assign_ids
    old = spark.createDataFrame([(11,)], "id long")
    new = spark.createDataFrame([(1, 3, "a"), (1, 1, "b"), (1, 2, "c"), (0, 9, "d"), (1, 2, "c")], "a int, b int, c string")
    got = sorted((r.id, r.a, r.b) for r in assign_ids(old, new, "id", ["a", "b"]).collect())
    assert got == [(12, 0, 9), (13, 1, 1), (14, 1, 2), (15, 1, 2), (16, 1, 3)]


def test_many_categories_still_drift(spark):
    from vigilo.operators.drift import detect_drift
    ref = spark.range(6000).selectExpr("concat('c', id % 150) AS k", "id AS x")
    new = spark.range(6000).selectExpr("concat('c', id % 75) AS k", "id AS x")
    out = detect_drift(ref, new, [], ["k"]).collect()
    assert len(out) == 1 and out[0].drift_detected and out[0].p_value < 1e-6
    few = detect_drift(ref, new.limit(5), [], ["k"]).collect()
    assert [r.test_method for r in few] == ["too_few_rows"]


def test_streams_read_a_folder_of_files(spark, tmp_path):
    import pyarrow.parquet as pq
    from vigilo.plans.catalog import REGISTRY
    t = pq.read_table("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "events.parquet").mkdir()
    step = len(t) // 3 + 1
    for i in range(3):
        pq.write_table(t.slice(i * step, step), tmp_path / "events.parquet" / f"part-{i}.parquet")
    for name in ("metric_rollup_stream", "alert_stream"):
        one = sorted(map(str, REGISTRY[name].fn(spark, "/root/testdata/sf0.001").collect()))
        many = sorted(map(str, REGISTRY[name].fn(spark, str(tmp_path)).collect()))
        assert one == many and one


def test_sessions_do_not_change_the_alert_folds(spark):
    import random
    from datetime import datetime, timedelta
    from vigilo.operators import alerts as AL
    rng = random.Random(1)
    t, rows = datetime(2024, 1, 1), []
    for i in range(300):
        t += timedelta(minutes=rng.choice([1, 5, 20, 59, 60, 61, 119, 120, 121, 400]))
        rows.append((f"u{rng.randrange(2)}", rng.choice(["a", "b"]), rng.choice([None, "m"]), i, t, rng.choice([15, 60])))
    df = spark.createDataFrame(rows, "u string, alert_type string, metric string, id int, ts timestamp, cooldown_minutes int")
    minute = 60_000_000

    def whole(keys, start, args, at=0):
        """Decisions by one decider per key, without sessions."""
        out, deciders = {}, {}
        for r in sorted(df.collect(), key=lambda r: (r["ts"], r["id"])):
            decide = deciders.setdefault(tuple(r[k] for k in keys), None) or start()
            deciders[tuple(r[k] for k in keys)] = decide
            out[r["id"]] = decide(int((r["ts"] - datetime(2024, 1, 1)).total_seconds()) * 1_000_000, *(a(r) for a in args))[at]
        return out
    cooldown = lambda r: r["cooldown_minutes"]
    got = {r["id"]: r["emitted"] for r in AL.apply_cooldown(df, ["alert_type", "metric"], "ts", ["id"]).collect()}
    assert got == whole(["alert_type", "metric"], AL._Cooldown, [cooldown])
    for keys in ([], ["u"]):
        got = {r["id"]: r["emitted"] for r in AL.apply_rate_limit(df, 2, 60, keys, "ts", ["id"]).collect()}
        assert got == whole(keys, lambda: AL._RateLimit(2, 60 * minute), [lambda r: True])
        got = {r["id"]: r["suppressed_by"] for r in AL.apply_alert_policy(df, max_alerts=2, tenant_cols=keys, order=["id"]).collect()}
        assert got == whole(keys, lambda: AL._Policy(2, 60 * minute), [cooldown, lambda r: r["alert_type"], lambda r: r["metric"]], 1)
    assert AL.with_sessions(df, ["u"], "ts", 60).select("u", "_session").distinct().count() > 10
