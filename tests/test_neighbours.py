"""Nearest neighbours against brute force; oversampled rows on the segments of their parents."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilo.operators import neighbours as NB


def brute(ids, x, k):
    out = set()
    for i in range(len(ids)):
        d = ((x[i] - x) ** 2).sum(1)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(int(ids[i]), r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)}
    return out


def frame(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "v": [list(map(float, r)) for r in x]}),
                                 "id long, v array<double>")


def got(df):
    return {tuple(r) for r in df.collect()}


CASES = {
    "spread": lambda rng: rng.normal(size=(300, 4)),
    "grid_ties": lambda rng: rng.integers(0, 4, (300, 3)).astype(float),
    "clusters": lambda rng: rng.normal(size=(300, 3)) + 1000.0 * rng.integers(0, 3, (300, 1)),
    "hot_copies": lambda rng: np.where(rng.random((300, 1)) < 0.5, 7.0, rng.normal(size=(300, 2)).round(2)),
    "one_vector": lambda rng: np.zeros((40, 2)),
    "far_from_zero": lambda rng: 1e6 + rng.integers(0, 50, (200, 2)).astype(float),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_neighbours_match_brute_force(spark, name):
    rng = np.random.default_rng(5)
    x = CASES[name](rng)
    ids = rng.permutation(10 * len(x))[:len(x)]
    out = NB.nearest_neighbours(frame(spark, ids, x), "id", "v", k=3, block=16)
    assert out.columns == ["id", "rank", "neighbour", "distance2"]
    found, want = got(out), brute(ids, x, 3)
    assert {r[:3] for r in found} == {r[:3] for r in want}
    want = {r[:3]: r[3] for r in want}
    assert all(abs(r[3] - want[r[:3]]) <= 1e-12 * (1 + r[3]) for r in found)


def test_bounds_exclude_blocks(spark):
    """In separated clusters a point is sent to its own cluster's cells only."""
    rng = np.random.default_rng(1)
    pivots = np.array([[0.0, 0.0], [1000.0, 0.0]])
    x = rng.normal(size=(50, 2))
    squares, slack = NB._squares(x, x)
    block = pd.DataFrame({"cell": [0], "keys": [np.arange(50).tobytes()], "vectors": [x.tobytes()],
                          "bounds": [(NB._kth(squares, 2) + slack).tobytes()]})
    sent = list(NB._send(pivots, np.array([0.0, 0.0]), np.array([5.0, 5.0]))(iter([block])))
    assert [int(s.cell[0]) for s in sent] == [0]


def test_neighbours_awkward_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [-0.0, 0.0]), (2, [-0.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 0.0]),
            (4, None), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert got(NB.nearest_neighbours(df, "id", "v", k=5)) == {
        (1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)}
    assert got(NB.nearest_neighbours(df.where("id = 3"), "id", "v")) == set()
    assert got(NB.nearest_neighbours(df.where("id > 90"), "id", "v")) == set()
    with pytest.raises(ValueError):
        NB.nearest_neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"),
                              "id", "v")


def test_oversample_on_segments(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(220), "a": rng.normal(size=220), "b": rng.integers(0, 5, 220).astype(float),
                        "y": np.r_[np.zeros(200), np.ones(20)].astype(int)})
    df = spark.createDataFrame(pdf)
    out = NB.oversample(df, "y", "id", ["a", "b"]).toPandas()
    assert len(out) == int(200 * NB.TARGET_RATIO) - 20 and set(out.y) == {1}
    near = {(r.id, r.neighbour) for r in NB.minority_neighbours(df, "y", "id", ["a", "b"]).collect()}
    rows = pdf.set_index("id")
    for r in out.itertuples():
        assert (r.id, r.neighbour) in near and 0 <= r.weight < 1
        for c in "ab":
            x, y = rows.loc[r.id, c], rows.loc[r.neighbour, c]
            assert getattr(r, c) == x + r.weight * (y - x)
    again = NB.oversample(df.repartition(7), "y", "id", ["a", "b"]).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, out.values.tolist()))
    both = NB.with_oversampling(df, "y", "id", ["a", "b"])
    assert {r["y"]: r["count"] for r in both.groupBy("y").count().collect()} == {0: 200, 1: 60}
    assert both.where(F.col("id").isNull()).count() == 40


def test_oversample_defined_cases(spark):
    def made(*counts):
        rows = [(i, float(i), y) for y, n in enumerate(counts) for i in range(y * 1000, y * 1000 + n)]
        return NB.oversample(spark.createDataFrame(rows, "id long, a double, y int"), "y", "id", ["a"])
    assert made(20, 10).count() == 0           # an imbalance of 2 is not severe
    assert made(20, 8).count() == 0            # the class has its share already
    assert made(20).count() == 0               # a single class
    assert made(100, 2).count() == 28          # one neighbour each
    with pytest.raises(ValueError):
        made(20, 1)
