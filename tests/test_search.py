"""Folds, grids and halving against fits by hand; calibrated margins."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, functions as F

from vigilo.operators import ml as ML
from vigilo.operators.evaluation import evaluate


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) > 0.8).astype(float)
    return spark.createDataFrame(pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))


def test_folds_equal_refitting_by_hand(spark, rows):
    res = ML.cross_validate("logistic_regression", rows, ["a", "b", "c"], "y", "id", k=3)
    folded = ML.spread(ML.fold_column(rows, "y", "id", 3))
    by_hand = []
    for f in range(3):
        model = ML.train("logistic_regression", folded.filter(F.col("fold") != f), ["a", "b", "c"], "y")
        by_hand.append(ML.evaluate_model(model, folded.filter(F.col("fold") == f), "y").first()["pr_auc"])
    assert np.allclose(res["folds"], by_hand, atol=1e-9)
    assert math.isclose(res["mean"], np.mean(by_hand), abs_tol=1e-9)
    assert math.isclose(res["std"], np.std(by_hand), abs_tol=1e-9)


def test_grid_is_complete_and_ordered(spark, rows):
    grid = ML.parameter_grid({"regParam": [0.01, 100.0], "maxIter": [5, 50]})
    assert grid == [{"maxIter": 5, "regParam": 0.01}, {"maxIter": 5, "regParam": 100.0},
                    {"maxIter": 50, "regParam": 0.01}, {"maxIter": 50, "regParam": 100.0}]
    res = ML.grid_search("logistic_regression", rows, ["a", "b", "c"], "y", "id", grid, k=2)
    means = [r["mean"] for r in res]
    assert len(res) == 4 and means == sorted(means, reverse=True)
    one = ML.cross_validate("logistic_regression", rows, ["a", "b", "c"], "y", "id", k=2, params=res[0]["params"])
    assert math.isclose(one["mean"], means[0], abs_tol=1e-9)


def test_halving_keeps_the_best(spark, rows):
    space = {"stepSize": (0.01, 0.3, "log"), "maxDepth": (2, 3, "int")}
    res = ML.successive_halving("gradient_boosting", rows, ["a", "b", "c"], "y", "id", space, n=4, budgets=(1, 2), k=2)
    first, last = ([r for r in res if r["round"] == i] for i in (0, 1))
    assert len(first) == 4 and len(last) == 2 and res[:2] == last
    assert {r["draw"] for r in last} == {r["draw"] for r in first[:2]}
    assert {r["params"]["maxIter"] for r in last} == {2}


def test_draws_are_repeatable_and_inside_the_ranges():
    a = ML.draw(ML.SEARCH_SPACE, 50)
    assert a == ML.draw(ML.SEARCH_SPACE, 50) and a[:10] == ML.draw(ML.SEARCH_SPACE, 10)
    for p in a:
        for name, (lo, hi, scale) in ML.SEARCH_SPACE.items():
            assert lo <= p[name] <= hi and isinstance(p[name], int) == (scale == "int")


def test_margins_become_probabilities(spark, rows):
    train, test = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    model = ML.train("svm", train, ["a", "b", "c"], "y")
    got = ML.score(model, test).select("y", "score", "prediction", "rawPrediction").toPandas()
    margin = got.rawPrediction.map(lambda v: v[1])
    assert got.score.between(0, 1).all()
    assert (got.score.rank() == margin.rank()).all()
    assert ((margin > 0).astype(int) == got.prediction).all()
    brier, base = ((got.score - got.y) ** 2).mean(), ((got.y.mean() - got.y) ** 2).mean()
    raw = ((1 / (1 + np.exp(-margin)) - got.y) ** 2).mean()
    assert brier < base and brier < raw


def test_one_class_and_few_rows(spark):
    one = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "id long, a double, y double")
    assert math.isnan(ML.cross_validate("logistic_regression", one, ["a"], "y", "id", k=5)["mean"])
    few = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(3)], "id long, a double, y double")
    scored = ML.score(ML.train("svm", few, ["a"], "y"), few).toPandas()
    assert scored.score.between(0, 1).all() and len(scored) == 3
    both = evaluate(scored_frame(spark), "y", "p", "s", ["m"]).collect()
    assert len(both) == 2


def test_models_score_in_a_session_that_has_observed(spark, rows):
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get == {"n": 400}
    assert 0 < ML.cross_validate("logistic_regression", rows, ["a", "b", "c"], "y", "id", k=2)["mean"] <= 1
    for kind in ("logistic_regression", "random_forest", "svm"):
        scored = ML.score(ML.train(kind, rows, ["a", "b", "c"], "y"), rows).select("score").checkpoint()
        assert scored.where("score between 0 and 1").count() == 400


def scored_frame(spark):
    return spark.createDataFrame([("u", 1.0, 1, 0.9), ("u", 0.0, 0, 0.2), ("v", 0.0, 1, 0.7)],
                                 "m string, y double, p int, s double")
