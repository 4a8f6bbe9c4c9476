"""Vector code compression: product codes trained by active-entry Lloyd rounds.

A vector's components become whole numbers ``floor(256 * x)``; the vector is cut
into 16 equal consecutive parts and every part is coded by the index of its
nearest entry (squared Euclidean distance, ties to the lower index) in the
codebook of its position.

Codebooks start as the parts of the first 64 vectors (least id).  A round
assigns every part and replaces each used entry by its parts' componentwise
``floor(sum / count)``.  From the second assignment on, a part whose entry did
not move keeps its stored exact distance and is compared with the *moved*
entries only: entries that stayed were no better before and still are not.  A
part whose entry moved is compared with all entries.  Either way the entry
chosen is the lowest of the nearest, as a full scan would choose it.

Between rounds vectors, codes and distances are a written table in the shared
folder; a round's sums are added up inside tasks, so 16 * 64 * (part length)
numbers a task are all that is shuffled, and codebooks are all the driver holds
(64 whole numbers per component).

Defined results: vectors that are null or hold a null or non-finite component
are dropped; vectors of different lengths are separate collections with
codebooks of their own; where 16 does not divide the length, part ``i`` ends at
``floor((i + 1) * length / 16)``, so parts may be empty (code 0, distance 0);
with fewer than 64 vectors a codebook has that many entries; rows of one id
count one by one, ordered by their vectors; null ids come last; whole-number
components are held to +-2**26, which keeps distances exact in 64 bits; equal
labels form one group, nulls another; an empty table gives no rows.  Columns
other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilo.session import remove_dir, scratch_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
BLOCK = 4096               # rows whose distances are held at once
SALTS = 16                 # ways that a label's rows are dealt when its total is joined
_STATE = "id {id}, label {label}, dim int, vector binary, code binary, distance binary"


def borders(dim: int, parts: int = PARTS) -> list[int]:
    return [i * dim // parts for i in range(parts + 1)]


# ------------------------------------------------------------ numpy core
def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index and squared distance of the nearest entry."""
    code, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), BLOCK):
        d = ((x[i:i + BLOCK, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        code[i:i + BLOCK] = k = d.argmin(axis=1)
        dist[i:i + BLOCK] = d[np.arange(len(k)), k]
    return code, dist


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray,
             dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after some entries moved, from the stored codes and distances."""
    code, dist = code.copy(), dist.copy()
    lost = moved[code]
    if lost.any():
        code[lost], dist[lost] = nearest(x[lost], book)
    active, kept = np.flatnonzero(moved), np.flatnonzero(~lost)
    if len(active) and len(kept):
        at, d = nearest(x[kept], book[active])
        at = active[at]
        closer = (d < dist[kept]) | ((d == dist[kept]) & (at < code[kept]))
        code[kept[closer]], dist[kept[closer]] = at[closer], d[closer]
    return code, dist


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-number components end to end, borders of rows, and which rows take part."""
    column = column.cast(pa.large_list(pa.float64()))
    valid = ~np.asarray(column.is_null())
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    bad = np.zeros(len(x) + 1, np.int64)
    np.cumsum(~np.isfinite(x), out=bad[1:])
    valid &= bad[offsets[1:]] == bad[offsets[:-1]]
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.clip(np.floor(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) * SCALE), -LARGEST, LARGEST)
    return x.astype(np.int32), offsets, valid


def _assigned(x: np.ndarray, books: list[np.ndarray], moved: list[np.ndarray] | None, code: np.ndarray | None,
              dist: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    cut = borders(x.shape[1], len(books))
    codes, dists = np.zeros((len(x), len(books)), np.int64), np.zeros((len(x), len(books)), np.int64)
    for p, book in enumerate(books):
        part = x[:, cut[p]:cut[p + 1]].astype(np.int64)
        codes[:, p], dists[:, p] = nearest(part, book) if moved is None else \
            reassign(part, book, moved[p], code[:, p], dist[:, p])
    return codes, dists


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(a)], pa.binary())


def _matrix(column: pa.Array, dtype, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)


# ------------------------------------------------------------ Spark jobs
def _prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """id, label, dim and whole-number components (binary) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"),
                          (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"),
                          F.col(vector_col).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at, valid = whole_vectors(batch.column("vector"))
            keep = np.flatnonzero(valid)
            rows = pa.array([x[at[i]:at[i + 1]].tobytes() for i in keep], pa.binary())
            dims = pa.array((at[keep + 1] - at[keep]).astype(np.int32))
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(keep), batch.column("label").take(keep), dims, rows],
                                             ["id", "label", "dim", "vector"])

    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, dim int, vector binary")


def _first_books(rows: DataFrame, dim: int, entries: int, parts: int) -> list[np.ndarray]:
    """Parts of the vectors of least id; rows of one id by their components."""
    numbers = F.hex("vector")
    order = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.concat(
        *[F.substring(numbers, i * 8 + k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")) if dim else F.array(F.lit(0))
    signed = F.transform(order, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v))
    rows = rows.filter(F.col("dim") == dim)
    last = rows.select("id").orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()[-1]["id"]
    near = rows if last is None else rows.filter(F.col("id") <= F.lit(last))
    first = near.select("id", "vector", signed.alias("order")) \
        .orderBy(F.col("id").asc_nulls_last(), "order").limit(entries).collect()
    x = np.stack([np.frombuffer(bytes(r["vector"]), np.int32) for r in first]).astype(np.int64)
    cut = borders(dim, parts)
    return [x[:, cut[p]:cut[p + 1]] for p in range(parts)]


def _assign(state: DataFrame, books: dict[int, list[np.ndarray]], moved: dict[int, list[np.ndarray]] | None) -> DataFrame:
    """Rows with codes and distances; with ``moved``, from those of the last round."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                n = part.num_rows
                x, own = _matrix(part.column("vector"), np.int32, n), books[int(dim)]
                if moved is None:
                    code, dist = _assigned(x, own, None, None, None)
                else:
                    code, dist = _assigned(x, own, moved[int(dim)], _matrix(part.column("code"), np.uint8, n).astype(np.int64),
                                           _matrix(part.column("distance"), np.int64, n))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "label", "dim", "vector")), _bytes(code.astype(np.uint8)), _bytes(dist)],
                    ["id", "label", "dim", "vector", "code", "distance"])

    return state.mapInArrow(run, _STATE.format(**kinds))


def _updated(state: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """Codebooks with every used entry at the floored mean of its parts."""
    shapes = {dim: (len(own), len(own[0])) for dim, own in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                parts, entries = shapes[dim]
                x = _matrix(part.column("vector"), np.int32, part.num_rows).astype(np.int64)
                code = _matrix(part.column("code"), np.uint8, part.num_rows)
                sums, counts = total.setdefault(dim, (np.zeros((entries, dim), np.int64), np.zeros((parts, entries), np.int64)))
                cut = borders(dim, parts)
                for p in range(parts):
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(sums[:, cut[p]:cut[p + 1]], code[:, p], x[:, cut[p]:cut[p + 1]])
        for dim, (sums, counts) in total.items():
            parts, entries = shapes[dim]
            cut = borders(dim, parts)
            for p in range(parts):
                used = np.flatnonzero(counts[p])
                width = cut[p + 1] - cut[p]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used) * (width + 1), dim, np.int32)),
                    pa.array(np.full(len(used) * (width + 1), p, np.int32)),
                    pa.array(np.repeat(used, width + 1).astype(np.int32)),
                    pa.array(np.tile(np.arange(-1, width), len(used)).astype(np.int32)),
                    pa.array(np.hstack([counts[p][used, None], sums[used, cut[p]:cut[p + 1]]]).ravel())],
                    ["dim", "part", "entry", "place", "total"])

    rows = state.mapInArrow(run, "dim int, part int, entry int, place int, total long") \
        .groupBy("dim", "part", "entry", "place").agg(F.sum("total").alias("total")).collect()
    totals = {(r["dim"], r["part"], r["entry"], r["place"]): r["total"] for r in rows}
    out = {dim: [book.copy() for book in own] for dim, own in books.items()}
    for (dim, part, entry, place), value in totals.items():
        if place >= 0:
            out[dim][part][entry, place] = value // totals[dim, part, entry, -1]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Codes of all vectors (id, label, dim, code, error) and the codebooks by vector length.

    ``code`` holds one byte per part, so at most 256 entries.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    spark = vectors.sparkSession
    rows = _prepare(vectors, id_col, vector_col, label_col)
    dims = [r["dim"] for r in rows.select("dim").distinct().collect()]
    books = {dim: _first_books(rows, dim, entries, parts) for dim in sorted(dims)}
    state, moved, last = rows, None, None
    for _ in range(rounds):
        folder = scratch_dir(spark, f"codes-{uuid.uuid4().hex}")
        _assign(state, books, moved).write.parquet(folder)
        state = spark.read.parquet(folder)
        if last:
            remove_dir(spark, last)
        last = folder
        new = _updated(state, books)
        moved = {dim: [(a != b).any(axis=1) for a, b in zip(new[dim], books[dim])] for dim in books}
        books = new
    folder = scratch_dir(spark, f"codes-{uuid.uuid4().hex}")
    _with_error(_assign(state, books, moved)).write.parquet(folder)
    if last:
        remove_dir(spark, last)
    return spark.read.parquet(folder), books


def _with_error(state: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                error = _matrix(batch.column("distance"), np.int64, batch.num_rows).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "dim", "code")), pa.array(error)],
                                                 ["id", "label", "dim", "code", "error"])

    return state.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, dim int, code binary, error long")


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error of all rows of the label.

    Totals are few rows; each is repeated SALTS times, so that the rows of one
    common label meet it in many tasks.
    """
    totals = codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = codes.withColumn("salt_of", F.pmod(F.hash("id", "code"), F.lit(SALTS)))
    return dealt.join(totals, F.col("label").eqNullSafe(F.col("same")) & (F.col("salt_of") == F.col("salt")), "left") \
        .drop("same", "salt", "salt_of")


def codebook_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def decode(codes: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """``codes`` with the vector that each code stands for (whole numbers / 256)."""
    flat = {dim: [b.tolist() for b in own] for dim, own in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, code in zip(batch.column("dim").to_pylist(), batch.column("code").to_pylist()):
                out.append([v / SCALE for p, k in enumerate(code) for v in flat[dim][p][k]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))],
                                             [*batch.schema.names, "vector"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{kinds}, vector array<double>")
