"""Scale properties of the physical plans, checked on the registered queries."""

import re
import uuid

import pytest

from vigilo.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
# Queries that write files, fit models or run streams are audited elsewhere.
SKIP = {"model_training", "hyperparameter_search", "grid_search", "cross_validation", "feature_importance",
        "importance_summary", "metric_rollup_stream", "alert_stream", "csv_roundtrip",
        "conversation_documents", "version_history", "metric_store", "model_input_table",
        "reference_profile", "pca_drift"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n not in SKIP))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(REGISTRY[name].fn(spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_pushes_filters_and_prunes_columns(spark):
    df = REGISTRY["index_lookback"].fn(spark, SF)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(event_type,purchase)" in text and "EqualTo(event_type,error)" in text
    assert "value" not in re.findall(r"ReadSchema: (struct<[^>]*>)", text)[0]


def test_retention_prunes_date_partitions(spark):
    from vigilo.operators import monitor as MO
    from vigilo.plans.catalog.monitoring import AS_OF, predictions
    from vigilo.session import scratch_dir
    from vigilo.sources import tables as TB
    path = scratch_dir(spark, "test-store-" + uuid.uuid4().hex[:8])
    TB.append_table(MO.prediction_metrics(predictions(spark, SF)), path, "timestamp", "dt")
    kept = TB.apply_retention(spark.read.parquet(path), "timestamp", 14, AS_OF, "dt")
    text = kept._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*dt", text)
