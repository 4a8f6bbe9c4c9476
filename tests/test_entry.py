"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as E


def test_entry_runs_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["user_id", "index_ts", "n_errors_5d"]
    assert df.count() > 0


def test_queries_and_oracles_line_up():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100 and len(sqls) >= 90


def test_training_data_queries_come_with_their_package():
    import importlib.util
    present = importlib.util.find_spec("corpus_pipeline") is not None
    assert ("pipeline" in E.queries()) == present
    assert any(n.startswith("op7_") for n in E.queries()) == present
