"""Exact top-k inner-product search by norm buckets (operator 10).

Vectors are grouped by length (Euclidean norm) into buckets, the longest
first; a bucket is cut into blocks of bounded size by a hash, so one norm that
a third of the rows share still spreads.  A first pass takes every query
against the longest bucket and gives it a lower bound ``theta`` on its k-th
score.  In every other bucket the bound becomes a local cosine threshold
``theta / (|q| * longest vector of the bucket)``:

* above 1 the whole bucket is skipped;
* a high threshold prunes by a coordinate: the normalised candidate must lie
  in the feasible interval around the query's largest coordinate;
* otherwise candidates are pruned by length, as a prefix of the bucket in
  norm order.

Survivors are verified with exact integer products, and the best k per query
are kept (ties: smaller id).  Pruning bounds have a slack for rounding, so the
result is exact.

Defined results: a vector that is null, holds a null or a non-finite component
takes no part; vectors of different dimension are not compared; equal rows
(id and vector) count once; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 16          # norm classes
BLOCK = 4096          # vectors of one block, on average
QUERY_BLOCK = 512     # queries of one block, on average
COORDINATE_FROM = 0.5  # local cosine threshold from which a coordinate prunes
SLACK = 1e-6


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, norms, dims = [], [], [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                if len(q) and np.abs(q).max() >= 2.0 ** 62:
                    raise ValueError("a vector component does not fit a 64-bit integer")
                ids.append(i)
                rows.append(q.astype(np.int64).tobytes())
                norms.append(float(np.sqrt((q * q).sum())))
                dims.append(len(q))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(norms, pa.float64()),
                 pa.array(dims, pa.int32())], ["id", "v", "norm", "dim"])
    return run


def _block_row(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One block as one row: ids and vectors in descending norm order."""
    pdf = pdf.sort_values(["norm", "id"], ascending=[False, True])
    return pd.DataFrame({"dim": [int(key[0])], "bucket": [int(key[1])], "block": [int(key[2])],
                         "ids": [pdf.id.to_numpy(np.int64).tobytes()],
                         "vectors": [b"".join(pdf.v)]})


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point only where every sum fits 53 bits."""
    bound = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(v.shape[1], 1)
    if bound < 2 ** 53:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if bound < 2 ** 63:
        return v @ q
    return (v.astype(object) @ q.astype(object)).astype(object)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Block:
    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.v = np.frombuffer(vectors, np.int64).reshape(len(self.ids), dim)
        self.f = self.v.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))
        self.unit = self.f / np.maximum(self.norm, 1e-300)[:, None]
        self.exact = 2 ** 53 / max(float(np.abs(self.f).max(initial=0)) * max(dim, 1), 1.0)

    def search(self, query_id: int, q: np.ndarray, k: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k candidates that reach ``theta``."""
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        rows = slice(0, len(self.ids))
        if length > 0 and theta > 0:
            local = theta / (length * max(self.norm[0], 1e-300))
            if local > 1 + SLACK:
                return self.ids[:0], np.zeros(0, np.int64)
            if local >= COORDINATE_FROM:
                c = min(local, 1.0)
                f = int(np.argmax(np.abs(q)))
                x = q[f] / length
                half = np.sqrt(max(0.0, (1 - x * x) * (1 - c * c))) + SLACK
                low, high = x * c - half, x * c + half
                # The query's own angle to the axis is inside the cone: the interval ends at the axis.
                if x >= 0 and high >= 0 and x >= c:
                    high = 1 + SLACK
                if x < 0 and x <= -c:
                    low = -1 - SLACK
                rows = np.flatnonzero((self.unit[:, f] >= low) & (self.unit[:, f] <= high))
            else:
                rows = slice(0, int(np.searchsorted(-self.norm, -(theta / length) * (1 - SLACK), "right")))
        ids = self.ids[rows]
        if float(np.abs(q).max(initial=0)) < self.exact:
            scores = (self.f[rows] @ q.astype(np.float64)).astype(np.int64)
        else:
            scores = products(self.v[rows], q)
        keep = ids != query_id
        if np.isfinite(theta):
            keep &= scores >= theta
        ids, scores = ids[keep], scores[keep]
        at = best(ids, scores, k)
        return ids[at], scores[at]


def _search(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                block = Block(r.ids, r.vectors, r.dim)
                qids = np.frombuffer(r.query_ids, np.int64)
                qs = np.frombuffer(r.queries, np.int64).reshape(len(qids), r.dim)
                bounds = np.frombuffer(r.bounds, np.float64)
                for qid, q, theta in zip(qids, qs, bounds):
                    ids, scores = block.search(int(qid), q, k, float(theta))
                    if len(ids):
                        yield pd.DataFrame({"query_id": np.full(len(ids), qid), "vec_id": ids, "score": scores})
    return run


def _pairs(queries: DataFrame, blocks: DataFrame, layout: list[tuple[int, int, float]], n_blocks: int,
           k: int) -> DataFrame:
    """Products of query blocks and the vector blocks whose bound they can reach.

    ``layout`` lists the buckets (dim, bucket, longest vector), at most
    ``BUCKETS`` per dimension.  A query block goes only to buckets where at
    least one of its queries can still find a better candidate; a row of the
    join is a pair of blocks, never a pair of vectors.
    """
    spark = queries.sparkSession
    if not layout:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    targets = F.broadcast(
        spark.createDataFrame(layout, "dim int, bucket int, longest double")
        .groupBy("dim").agg(F.collect_list(F.struct("bucket", "longest")).alias("to")))
    sent = (queries.join(targets, "dim")
            .withColumn("to", F.explode(F.filter("to", lambda t: t["longest"] * (1 + SLACK) >= F.col("reach"))))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
            .select("dim", "query_ids", "queries", "bounds", F.col("to.bucket").alias("bucket"), "block"))
    return (sent.hint("merge").join(blocks, ["dim", "bucket", "block"])
            .mapInPandas(_search(k), "query_id long, vec_id long, score long"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    norm = np.maximum(pdf.norm.to_numpy(float), 1e-300)
    theta = pdf.theta.fillna(-np.inf).to_numpy(float)
    reach = np.where(theta > 0, theta / norm, -np.inf)
    return pd.DataFrame({"dim": [int(key[0])], "query_ids": [pdf.id.to_numpy(np.int64).tobytes()],
                         "queries": [b"".join(pdf.v)], "bounds": [theta.tobytes()], "reach": [float(reach.min())]})


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
                vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query row against all rows but its own.

    Only the norm limits (15 numbers) and each bucket's longest norm reach the
    driver.
    """
    # Written once: bucket limits, layout and both passes must see the same rows.
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"),
                           is_query.alias("is_query"))
            .where(F.col("id").isNotNull()))
    ints = (rows.select("id", "v").mapInArrow(_quantise(scale), "id long, v binary, norm double, dim int")
            .dropDuplicates(["id", "v"]))
    asked = rows.where("is_query").select("id").distinct()
    ints = ints.checkpoint()
    n = ints.count()
    limits = sorted(set(ints.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.01)), reverse=True) \
        if n else []
    n_blocks = max(1, -(-n // (BUCKETS * BLOCK)))
    bucket = sum(((F.col("norm") < x).cast("int") for x in limits), F.lit(0))
    placed = ints.select("*", bucket.alias("bucket"),
                         F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("block"))
    blocks = (placed.groupBy("dim", "bucket", "block").applyInPandas(
        _block_row, "dim int, bucket int, block int, ids binary, vectors binary")).checkpoint()
    layout = [tuple(r) for r in placed.groupBy("dim", "bucket").agg(F.max("norm")).collect()]
    queries = ints.join(asked, "id")
    n_queries = max(1, -(-(n // 50 + 1) // QUERY_BLOCK))

    def in_blocks(q: DataFrame) -> DataFrame:
        return (q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_queries)))
                .groupBy("dim", "part").applyInPandas(
                    _query_rows, "dim int, query_ids binary, queries binary, bounds binary, reach double"))

    first = {d: min(b for e, b, _ in layout if e == d) for d in {x[0] for x in layout}}
    head = [x for x in layout if x[1] == first[x[0]]]
    rest = [x for x in layout if x[1] != first[x[0]]]
    found = _top(_pairs(in_blocks(queries.withColumn("theta", F.lit(None).cast("double"))), blocks, head,
                        n_blocks, k), k)
    found = found.drop("rank").checkpoint()
    theta = (found.groupBy(F.col("query_id").alias("id"))
             .agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("theta")))
    later = _pairs(in_blocks(queries.join(theta, "id", "left")), blocks, rest, n_blocks, k)
    return _top(found.unionByName(later), k).select("query_id", F.col("rank").cast("int").alias("rank"),
                                                   "vec_id", "score")
