"""Sequence packing by cutting-stock column generation (operator 2).

Documents become token ids plus an end id and are cut into pieces: full
sequences, one multiple of a quarter sequence, and a remainder below a quarter
(short remainders are what lets the program fill sequences to the brim).
Piece lengths are counted in classes of ``STEP`` tokens, a histogram of at most
``capacity / STEP`` rows whatever the size of the corpus.  On that histogram the Gilmore-Gomory linear program is
solved: columns are patterns of one sequence, priced by an unbounded knapsack
dynamic program over the duals.  Each pattern is used the rounded-down number
of times; what is left over (fewer than one sequence per column) is packed
best-fit into further patterns.  Pieces are ranked inside their class and take
the pattern places in rank order.

Ranking is distributed: a class is dealt to groups of about a thousand rows by
a hash, group sizes give each group its first rank, and rows are numbered
inside their group, so a length that a third of all documents share is never
one task.

Defined results: a null or empty text is one piece that holds the end id;
repeated rows are packed one by one; an empty table gives no pieces; further
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigilo.llm.tokens import default_path, encoder
from vigilo.llm.words import sub_batches

CAPACITY = 2048
STEP = 2              # tokens per length class
GAP = 0.0005          # relative gap to the linear program's lower bound at which it stops
END_ID = 1
GROUP_ROWS = 1000     # rows of one ranking group, at small sizes


# ---------------------------------------------------------------- linear program
def price(duals: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Best pattern for the duals (``duals[s]``: value of one piece of size s)."""
    worth = np.zeros(units + 1)
    pick = np.zeros(units + 1, np.int64)
    sizes = np.flatnonzero(duals > 0)
    gain = duals[sizes]
    n = np.searchsorted(sizes, np.arange(units + 1), "right")
    for c in range(1, units + 1):
        worth[c] = worth[c - 1]
        if n[c]:
            total = worth[c - sizes[:n[c]]] + gain[:n[c]]
            s = total.argmax()
            if total[s] > worth[c] + 1e-12:
                worth[c], pick[c] = total[s], sizes[s]
    pattern = np.zeros(units + 1, np.int64)
    c = units
    while c > 0:
        if pick[c]:
            pattern[pick[c]] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(worth[units]), pattern


def column_generation(demand: np.ndarray, units: int, gap: float = GAP) -> tuple[list[np.ndarray], np.ndarray]:
    """Optimal basis of the cutting-stock linear program: patterns and their real-valued uses.

    ``demand[s]`` pieces of size s must be covered exactly; the objective is
    the number of sequences.  Revised simplex with an explicit basis inverse;
    it ends when the best column prices at most ``1 + gap``: the optimum is at
    least the present objective divided by that price.
    """
    sizes = np.flatnonzero(demand[:units + 1])
    sizes = sizes[sizes > 0]
    m = len(sizes)
    fits = units // sizes
    basis = np.diag(fits.astype(float))
    inverse = np.diag(1.0 / fits)
    uses = demand[sizes] / fits
    for step in count():
        duals = np.zeros(units + 1)
        duals[sizes] = np.maximum(inverse.sum(axis=0), 0.0)
        value, pattern = price(duals, units)
        if value <= 1 + gap:
            break
        column = pattern[sizes].astype(float)
        direction = inverse @ column
        ok = direction > 1e-9
        ratio = np.where(ok, uses / np.where(ok, direction, 1.0), np.inf)
        out = int(np.argmin(ratio))
        move = max(float(ratio[out]), 0.0)
        uses = uses - move * direction
        uses[out] = move
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        if step % 200 == 199:     # rounding errors do not add up
            inverse = np.linalg.inv(basis)
            uses = inverse @ demand[sizes]
    patterns = []
    for j in range(m):
        p = np.zeros(units + 1, np.int64)
        p[sizes] = np.rint(basis[:, j]).astype(np.int64)
        patterns.append(p)
    return patterns, uses


def best_fit(demand: np.ndarray, units: int) -> Counter:
    """Patterns of a best-fit-decreasing packing of the left-over pieces."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []          # (free units, bin), sorted
    for s in range(units, 0, -1):
        for _ in range(int(demand[s])):
            at = bisect_left(room, (s, -1))
            if at < len(room):
                free, b = room.pop(at)
            else:
                free, b = units, len(bins)
                bins.append([])
            bins[b].append(s)
            if free > s:
                insort(room, (free - s, b))
    return Counter(tuple(sorted(b, reverse=True)) for b in bins)


def plan(demand: np.ndarray, units: int) -> list[tuple[Counter, int]]:
    """Patterns (size -> pieces) and the whole number of sequences of each; covers the demand exactly."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[Counter, int]] = []
    if left[1:].any():
        patterns, uses = column_generation(demand.astype(float), units)
        for p, x in sorted(zip(patterns, uses), key=lambda t: -t[1]):
            n = int(np.floor(x + 1e-6))
            used = p > 0
            if n > 0 and used.any():
                n = min(n, int((left[used] // p[used]).min()))
            if n > 0:
                left -= n * p
                out.append((Counter({int(s): int(p[s]) for s in np.flatnonzero(p)}), n))
        out += [(Counter(b), n) for b, n in best_fit(left, units).items()]
    return out


# ------------------------------------------------------------------------ pieces
def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` (little-endian unsigned 32-bit ids)."""
    path = path or default_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, quarter = encoder(path), max(capacity // 4, 1)
        for batch in sub_batches(batches):
            row, start, length, total, ids = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                border = [*range(0, len(tokens), capacity)]
                rest = border[-1] + (len(tokens) - border[-1]) // quarter * quarter
                border += [x for x in (rest, len(tokens)) if x > border[-1]]
                border = sorted({*border, len(tokens)})
                for a, b in zip(border, border[1:]):
                    part = tokens[a:b]
                    row.append(i)
                    start.append(a)
                    length.append(len(part))
                    total.append(len(tokens))
                    ids.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


# ---------------------------------------------------------------------- assignment
def _places(solution: list[tuple[Counter, int]]) -> dict[int, np.ndarray]:
    """Per class: first rank, pieces per sequence, first sequence, and place of every pattern that holds it."""
    at: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, n in solution:
        place = 0
        for s in sorted(pattern, reverse=True):
            at.setdefault(s, []).append((used[s], pattern[s], sequence, place))
            used[s] += n * pattern[s]
            place += pattern[s]
        sequence += n
    return {s: np.array(rows, np.int64) for s, rows in at.items()}


def pack(rows: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """``rows`` (any columns, with ``length`` between 1 and ``capacity``) plus ``sequence_id`` and ``offset``.

    ``rows`` is written once to the shared checkpoint folder, so that row ids,
    histogram and assignment see the same pieces even after lost executors.
    """
    units = -(-capacity // step)
    columns = rows.columns
    t = rows.select("*", F.ceil(F.col("length") / step).cast("int").alias("_class"),
                    F.monotonically_increasing_id().alias("_row")).checkpoint()
    counts = {r["_class"]: r["n"] for r in t.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(units + 1, np.int64)
    for s, n in counts.items():
        demand[s] = n
    places = _places(plan(demand, units))

    # Rank in the class: groups of about `size` rows, a hot class over many groups.
    size = GROUP_ROWS + sum(counts.values()) // 10 ** 6
    groups = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, -(-n // size))]) if counts else None
    n_groups = groups[F.col("_class")] if counts else F.lit(1)
    t = t.withColumn("_group", F.pmod(F.xxhash64("_row"), n_groups).cast("int"))
    sizes = t.groupBy("_class", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_class", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_class", "_group").orderBy("_row")
    ranked = (t.join(first, ["_class", "_group"])
              .withColumn("_rank", F.col("_first") + F.row_number().over(inside) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column("_class").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence = np.zeros(len(cls), np.int64)
            place = np.zeros(len(cls), np.int64)
            for s in np.unique(cls):
                at = np.flatnonzero(cls == s)
                table = places[int(s)]
                p = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                k = rank[at] - p[:, 0]
                sequence[at] = p[:, 2] + k // p[:, 1]
                place[at] = p[:, 3] + k % p[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(place)],
                columns + ["sequence_id", "_place"])

    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    placed = ranked.select(*columns, "_class", "_rank").mapInArrow(run, f"{schema}, sequence_id long, _place long")
    so_far = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0))).drop("_place")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   path: str | None = None) -> DataFrame:
    """Packed pieces with their ids: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``."""
    return pack(pieces(docs, id_col, text_col, capacity, path), capacity)


def packed_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  path: str | None = None) -> DataFrame:
    """Packed pieces with the checksum of their ids in place of the ids."""
    parts = pieces(docs, id_col, text_col, capacity, path)
    return pack(parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), capacity)
