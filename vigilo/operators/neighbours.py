"""Exact nearest neighbours (J13) and minority oversampling by interpolation.

The neighbour join never compares all pairs.  Rows with equal vectors become
one point; points are dealt to the nearest of about sqrt(n) pivots, and each
pivot's cell is cut into blocks by distance to the pivot.  A point's
(k + 1)-th nearest pivot, then its own block, bound how far its neighbours can
lie; the triangle inequality says which cells, and which blocks of a cell, a
bound cannot exclude, and only those are compared.  Blocks hold at most
``BLOCK`` points, so no task holds a class or a cell.  In data without
structure (many dimensions, all distances alike) the bounds exclude little and
the work approaches all pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators.ml import split_rank
from vigilo.operators.ordered import prefix_sums
from vigilo.session import ship_package

MOST_PIVOTS = 4096     # vectors that the driver holds and every task receives
BLOCK = 1024           # points of one block
PAIRS = 1 << 20        # exact distances computed at a time
# Share of the squared norms that rounding may add to a squared distance found
# by products; bounds are widened by it, distances that are returned are not.
ROUNDING = 1e-12


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows of ``x`` and ``y`` by products, and their largest rounding."""
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    slack = ROUNDING * float(nx.max(initial=0) + ny.max(initial=0))
    return np.maximum(nx[:, None] + ny[None, :] - 2 * (x @ y.T), 0), slack


def _kth(squares: np.ndarray, k: int) -> np.ndarray:
    """The (k + 1)-th smallest value of each row, infinite where a row has fewer."""
    if squares.shape[1] <= k:
        return np.full(len(squares), np.inf)
    return np.partition(squares, k, axis=1)[:, k]


def _assign(pivots: np.ndarray, k: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf.v.to_numpy()).astype(float)
            squares, slack = _squares(x, pivots)
            # A point that stands for k + 1 rows needs no other point.
            alone = pdf.ids.map(len).to_numpy() > k
            yield pd.DataFrame({"pid": pdf.pid, "key": pdf.key, "ids": pdf.ids, "v": [r.tobytes() for r in x],
                                "cell": squares.argmin(1).astype(np.int32), "dist": np.sqrt(squares.min(1)),
                                "bound": np.where(alone, 0.0, _kth(squares, k) + slack)})
    return run


def _block_row(k: int, dim: int) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x = np.frombuffer(b"".join(pdf.v), float).reshape(len(pdf), dim)
        squares, slack = _squares(x, x)
        bound = np.minimum(pdf.bound.to_numpy(), _kth(squares, k) + slack)
        ids = [np.asarray(i, np.int64) for i in pdf.ids]
        pad = math.sqrt(slack)
        return pd.DataFrame({
            "cell": [int(key[0])], "block": [int(key[1])], "lo": [float(pdf.dist.min()) - pad],
            "hi": [float(pdf.dist.max()) + pad], "keys": [pdf.key.to_numpy(np.int64).tobytes()],
            "vectors": [x.tobytes()], "ids": [np.concatenate(ids).tobytes()],
            "sizes": [np.array([len(i) for i in ids], np.int32).tobytes()], "bounds": [bound.tobytes()]})
    return run


def _send(pivots: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Callable:
    """A block's points, once for every cell that the bound of one of them cannot exclude."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.vectors, float).reshape(-1, pivots.shape[1])
                keys, bound = np.frombuffer(r.keys, np.int64), np.frombuffer(r.bounds, float)
                squares, slack = _squares(x, pivots)
                pad = 2 * math.sqrt(slack)
                far, tau = np.sqrt(squares), np.sqrt(bound)[:, None] + pad
                low, high = far - tau, far + tau
                reach = (low <= hi) & (high >= lo)
                # Beyond the plane half way to another pivot by more than the bound.
                gaps = np.sqrt(_squares(pivots[r.cell:r.cell + 1], pivots)[0][0])
                away = squares - squares[:, r.cell:r.cell + 1] - 2 * slack
                reach &= (away <= 2 * gaps * tau) | (gaps <= pad)
                for c in np.flatnonzero(reach.any(0)):
                    at = reach[:, c]
                    yield pd.DataFrame({
                        "cell": [int(c)], "low": [float(low[at, c].min())], "high": [float(high[at, c].max())],
                        "q_keys": [keys[at].tobytes()], "q_vectors": [x[at].tobytes()],
                        "q_bounds": [bound[at].tobytes()]})
    return run


def _compare(k: int, dim: int) -> Callable:
    """The k + 1 nearest rows of each sent point in one block, with exact squared distances."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                keys = np.frombuffer(r.q_keys, np.int64)
                x = np.frombuffer(r.q_vectors, float).reshape(-1, dim)
                y = np.frombuffer(r.vectors, float).reshape(-1, dim)
                sizes = np.frombuffer(r.sizes, np.int32).astype(np.int64)
                ids, first = np.frombuffer(r.ids, np.int64), np.cumsum(sizes) - sizes
                squares, slack = _squares(x, y)
                limit = np.minimum(np.frombuffer(r.q_bounds, float), _kth(squares, k)) + 2 * slack
                q, p = np.nonzero(squares <= limit[:, None])
                step = max(1, PAIRS // max(dim, 1))
                exact = np.concatenate([np.zeros(0)] + [
                    ((x[q[i:i + step]] - y[p[i:i + step]]) ** 2).sum(1) for i in range(0, len(q), step)])
                # One candidate per row that the point stands for.
                n = sizes[p]
                place = np.repeat(first[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                q, exact, near = np.repeat(q, n), np.repeat(exact, n), ids[place]
                order = np.lexsort((near, exact, q))
                q, exact, near = q[order], exact[order], near[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                keep = rank <= k
                if keep.any():
                    yield pd.DataFrame({"key": keys[q[keep]], "neighbour": near[keep], "distance2": exact[keep]})
    return run


def nearest_neighbours(rows: DataFrame, id_col: str, vector_col: str, k: int = 2,
                       most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """``id_col, rank, neighbour, distance2`` - the k nearest other rows of every row.

    Squared Euclidean distance, ties to the smaller id.  ``id_col`` is a whole
    number; an id that occurs with several vectors keeps the least of them.
    Rows without an id, without components or with a null or non-finite one
    take no part; vectors of different lengths raise ``ValueError``.  A row
    with fewer than k others gets them all, a single row none.  Components are
    below 1e150 in size, so that squares are finite.

    The driver holds at most ``most_pivots`` vectors and their cells' radii.
    """
    spark = rows.sparkSession
    ship_package(spark)
    schema = f"{id_col} long, rank int, neighbour long, distance2 double"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & (F.size("v") > 0) & finite)
            .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))     # one zero
            .groupBy("id").agg(F.min("v").alias("v"))
            .withColumn("pid", F.md5(F.array_join(F.col("v").cast("array<string>"), ",")))
            .checkpoint())
    lengths = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if lengths[0] is None:
        return spark.createDataFrame([], schema)
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} components")
    dim = lengths[0]

    # One point per distinct vector with its k + 1 smallest ids; the rank limit
    # works before the shuffle, so a vector of a third of all rows moves k + 1
    # rows per task.
    least = F.row_number().over(Window.partitionBy("pid").orderBy("id"))
    points = (kept.withColumn("_n", least).where(F.col("_n") <= k + 1)
              .groupBy("pid").agg(F.min("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
              .withColumn("key", F.col("ids")[0]).checkpoint())
    m = min(most_pivots, math.isqrt(points.count() - 1) + 1)
    # A bottom-m sample by hash: repeatable and bounded.
    pivots = np.array([r["v"] for r in points.select("v", "key").orderBy(F.xxhash64("pid"), "key").limit(m).collect()],
                      float).reshape(-1, dim)
    placed = points.mapInPandas(
        _assign(pivots, k), "pid string, key long, ids array<long>, v binary, cell int, dist double, bound double"
    ).withColumn("_one", F.lit(1)).checkpoint()
    ranked = prefix_sums(placed, "dist", ["_one"], ["cell"], tie=["key"])
    blocks = (ranked.withColumn("block", F.floor((F.col("cum__one") - 1) / block).cast("int"))
              .groupBy("cell", "block").applyInPandas(
                  _block_row(k, dim), "cell int, block int, lo double, hi double, keys binary, vectors binary, "
                                      "ids binary, sizes binary, bounds binary").checkpoint())
    lo, hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for c, a, b in blocks.groupBy("cell").agg(F.min("lo"), F.max("hi")).collect():   # one row per pivot
        lo[c], hi[c] = a, b

    sent = blocks.select("cell", "keys", "vectors", "bounds").mapInPandas(
        _send(pivots, lo, hi), "cell int, low double, high double, q_keys binary, q_vectors binary, q_bounds binary")
    # The narrow layout names the blocks first, so that the blocks of one cell
    # meet their points in many tasks.
    visits = (sent.join(blocks.select("cell", "block", "lo", "hi"), ["cell"])
              .where((F.col("low") <= F.col("hi")) & (F.col("high") >= F.col("lo")))
              .select("cell", "block", "q_keys", "q_vectors", "q_bounds"))
    found = (visits.join(blocks.select("cell", "block", "vectors", "ids", "sizes"), ["cell", "block"])
             .mapInPandas(_compare(k, dim), "key long, neighbour long, distance2 double"))
    nearest = Window.partitionBy("key").orderBy("distance2", "neighbour")
    best = (found.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1)
            .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("distance2", "neighbour"))).alias("near")))
    answers = placed.select("pid", "key").join(best, "key").select("pid", "near")
    own = kept.select("id", "pid").join(answers, "pid").select(
        "id", F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("id")), 1, k).alias("near"))
    return (own.select("id", F.posexplode("near").alias("pos", "n"))
            .select(F.col("id").alias(id_col), (F.col("pos") + 1).alias("rank"),
                    F.col("n.neighbour").alias("neighbour"), F.col("n.distance2").alias("distance2")))


# L6 -------------------------------------------------------------------------
# --- fixed values: oversampling preset --------------------------------------
TARGET_RATIO = 0.3        # minority rows wanted per majority row
NEIGHBOURS = 2
LEAST_IMBALANCE = 2       # at this ratio or below nothing is added
# --- end fixed values -------------------------------------------------------


def rare_class(df: DataFrame, label: str, ratio: float = TARGET_RATIO) -> tuple[object, int, int] | None:
    """(label, rows, rows to add) of the smallest class; None where nothing is to be added.

    Nothing is added with fewer than two classes, at an imbalance of
    ``LEAST_IMBALANCE`` or less, or where the class has its share already.
    """
    counts = sorted((r["n"], r[label]) for r in df.where(F.col(label).isNotNull()).groupBy(label)
                    .agg(F.count(F.lit(1)).alias("n")).collect())           # one row per class
    if len(counts) < 2 or counts[-1][0] <= LEAST_IMBALANCE * counts[0][0]:
        return None
    rows, rare = counts[0]
    wanted = max(rows, int(counts[-1][0] * ratio))
    return (rare, rows, wanted - rows) if wanted > rows else None


def minority_neighbours(df: DataFrame, label: str, id_col: str, features: Sequence[str],
                        k: int = NEIGHBOURS, ratio: float = TARGET_RATIO) -> DataFrame:
    """J13 inside the class that oversampling would enlarge; no rows where it would enlarge none."""
    found = rare_class(df, label, ratio)
    rare = df.where(F.col(label) == F.lit(found[0])) if found else df.limit(0)
    return nearest_neighbours(rare.select(id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("v")),
                              id_col, "v", k)


def oversample(df: DataFrame, label: str, id_col: str, features: Sequence[str], k: int = NEIGHBOURS,
               ratio: float = TARGET_RATIO, seed: int = 42) -> DataFrame:
    """The rows to add, ``id_col, copy, neighbour, weight, <features>, label``.

    A new row lies between a row of the rare class and one of its k nearest
    there: ``x + weight * (y - x)`` in every feature.  The class's rows take
    turns in the order of md5(id:seed), so their number is exact; neighbour and
    weight come from md5(id:copy:seed), so any engine and any retry draws the
    same rows.  A class of a single row has no neighbour and raises
    ``ValueError``.  Features must not be null; ids are unique whole numbers.
    """
    spark = df.sparkSession
    names = list(features)
    found = rare_class(df, label, ratio)
    kind = df.schema[label].dataType.simpleString()
    if not found:
        cols = ", ".join(f"`{c}` double" for c in names)
        return spark.createDataFrame([], f"`{id_col}` long, copy int, neighbour long, weight double, {cols}, "
                                         f"`{label}` {kind}")
    rare, rows, more = found
    if rows < 2:
        raise ValueError("the rare class has a single row: nothing to interpolate")
    base = (df.where(F.col(label) == F.lit(rare))
            .select(F.col(id_col).cast("long").alias("_id"), F.col(label).alias("_label"),
                    F.array(*[F.col(c).cast("double") for c in names]).alias("_x")).checkpoint())
    near = nearest_neighbours(base, "_id", "_x", k).select("_id", F.col("rank").alias("_pick"),
                                                           F.col("neighbour").alias("_near"))
    turns = (F.lit(more // rows) + (F.col("_pos") <= more % rows).cast("int")).cast("int")
    digest = F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.col("_copy").cast("string"), F.lit(str(seed))))

    def part(start: int):
        return F.conv(F.substring("_draw", start, 8), 16, 10).cast("long")

    drawn = (split_rank(base, "_label", "_id", seed).withColumn("_turns", turns).where("_turns > 0")
             .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_turns"))))
             .withColumn("_draw", digest)
             .select("_id", "_label", "_x", "_copy", (part(1) % min(k, rows - 1) + 1).cast("int").alias("_pick"),
                     (part(9) / F.lit(4294967296.0)).alias("_weight")))
    # No hints: rows with many copies make some neighbours hot, which AQE splits on this side.
    made = (drawn.join(near, ["_id", "_pick"])
            .join(base.select(F.col("_id").alias("_near"), F.col("_x").alias("_y")), "_near"))
    return made.select(F.col("_id").alias(id_col), F.col("_copy").alias("copy"), F.col("_near").alias("neighbour"),
                       F.col("_weight").alias("weight"),
                       *[(F.col("_x")[i] + F.col("_weight") * (F.col("_y")[i] - F.col("_x")[i])).alias(c)
                         for i, c in enumerate(names)], F.col("_label").alias(label))


def with_oversampling(df: DataFrame, label: str, id_col: str, features: Sequence[str], k: int = NEIGHBOURS,
                      ratio: float = TARGET_RATIO, seed: int = 42) -> DataFrame:
    """Training rows and the rows to add: ``id_col`` (null for added rows), features as doubles, label."""
    plain = df.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c).cast("double").alias(c) for c in features],
                      label)
    extra = oversample(df, label, id_col, features, k, ratio, seed)
    return plain.unionByName(extra.select(F.lit(None).cast("long").alias(id_col), *features, label))
