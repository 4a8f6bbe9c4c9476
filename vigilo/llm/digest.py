"""Document fingerprints: quartile bucket digests and their difference score.

A fingerprint counts, for every position of a text's UTF-8 bytes, the triplet of
bytes ``i, i + 4, i + 7`` in one of 256 hash buckets, and writes for each bucket
the quartile (0 to 3) that its count lies in, besides a logarithmic code of the
length: 3 hex digits of length, then 128 hex digits of two buckets each.

``difference`` of two fingerprints is the sum over the buckets of the quartile
steps between them (three steps count 6) plus 28 for each step between the
length codes, 16 at most; it lies in 0..1984, and likeness is
``1 - difference / 1984``.  Equal texts have equal fingerprints and likeness 1.

Defined results: a null text counts as empty; a text of fewer than eight bytes
has no triplet, all its quartiles are 0 and only lengths tell such texts apart;
a text of any length is read whole, in chunks.  ``neighbour_edits`` orders rows
by id descending, null ids last, rows of one id by the md5 of their text; a
table of one row is its own neighbour; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from vigilo.llm.words import sub_batches

BUCKETS = 256
OFFSETS = (0, 4, 7)               # byte positions of a triplet
FACTOR = 2654435761               # multiplicative hash of the 24-bit triplet
FAR_STEP = 6                      # what three quartile steps count
LENGTH_STEP, LENGTH_STEPS = 28, 16
BOUND = FAR_STEP * BUCKETS + LENGTH_STEP * LENGTH_STEPS
CHUNK = 1 << 21                   # bytes hashed at once
MAX_SLOTS = 1 << 14               # ranges of ids, at most
_SPAN = OFFSETS[-1]


# ------------------------------------------------------------------ digests
def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts by text and bucket."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    for i in range(0, max(len(data) - _SPAN, 0), CHUNK):
        part = data[i:i + CHUNK + _SPAN].astype(np.uint32)
        n = len(part) - _SPAN
        a, b, c = (part[o:o + n] for o in OFFSETS)
        bucket = ((a | (b << np.uint32(8)) | (c << np.uint32(16))) * np.uint32(FACTOR)) >> np.uint32(24)
        first, last = np.searchsorted(end, (i, i + n - 1), "right")
        stop = np.minimum(end[first:last + 1], i + n) - i
        begin = np.maximum(end[first:last + 1] - size[first:last + 1], i) - i
        doc = np.repeat(np.arange(last - first + 1), np.maximum(stop - begin, 0))
        whole = np.arange(n) + (i + _SPAN) < end[first:last + 1][doc]
        got = np.bincount((doc * BUCKETS + bucket)[whole], minlength=(last - first + 1) * BUCKETS)
        out[first:last + 1] += got.reshape(-1, BUCKETS)
    return out


def quartiles(counts: np.ndarray) -> np.ndarray:
    """Quartile 0..3 of every bucket: how many of the 64th, 128th and 192nd least count lie below it."""
    ordered = np.sort(counts, axis=1)
    cuts = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, :, None] > cuts[:, None, :]).sum(axis=2).astype(np.uint8)


def length_codes(sizes: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling of the length in bytes plus one."""
    m = np.asarray(sizes, np.int64) + 1
    e = np.frexp(m.astype(np.float64))[1].astype(np.int64) - 1
    return 8 * e + ((m << 3) >> e) - 8


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quartiles and length codes of some texts, a bounded number of bytes at a time."""
    return quartiles(bucket_counts(texts)), length_codes(np.fromiter(map(len, texts), np.int64, len(texts)))


def to_text(quarter: np.ndarray, length: np.ndarray) -> list[str]:
    q = quarter.reshape(len(quarter), -1, 4)
    packed = (q[:, :, 0] << 6) | (q[:, :, 1] << 4) | (q[:, :, 2] << 2) | q[:, :, 3]
    return [f"{n:03x}{row.tobytes().hex()}" for n, row in zip(length.tolist(), packed)]


def from_text(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([int(p[:3], 16) for p in prints], np.int64)
    packed = np.frombuffer(bytes.fromhex("".join(p[3:] for p in prints)), np.uint8).reshape(len(prints), -1)
    q = np.stack([packed >> 6, (packed >> 4) & 3, (packed >> 2) & 3, packed & 3], axis=2)
    return q.reshape(len(prints), -1), length


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bounded difference score of digests, row by row."""
    step = np.abs(a[0].astype(np.int64) - b[0])
    step[step == 3] = FAR_STEP
    return step.sum(axis=1) + LENGTH_STEP * np.minimum(np.abs(a[1] - b[1]), LENGTH_STEPS)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return 1.0 - difference(a, b) / BOUND


# ---------------------------------------------------------------- operators
def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and fingerprint of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(to_text(*digests(texts)), pa.string())],
                                             ["id", "fingerprint"])

    out = rows.mapInArrow(run, f"id {kind}, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def compare(pairs: DataFrame, left: str, right: str, score: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two fingerprint columns (null where one of them is)."""
    low = F.lit(0x5555555555555555)

    def step(i: int) -> Column:
        a, b = (F.conv(F.substring(c, 4 + 16 * i, 16), 16, -10).cast("long") for c in (left, right))
        ah, bh = (F.shiftrightunsigned(x, 1).bitwiseAND(low) for x in (a, b))
        al, bl = (x.bitwiseAND(low) for x in (a, b))
        high, units = ah.bitwiseXOR(bh), al.bitwiseXOR(bl)
        both, far = high.bitwiseAND(units), F.bitwise_not(ah.bitwiseXOR(al))      # 0 against 3, else 1 against 2
        return (F.bit_count(units.bitwiseAND(F.bitwise_not(high))) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(units)))
                + FAR_STEP * F.bit_count(both.bitwiseAND(far)) + F.bit_count(both.bitwiseAND(F.bitwise_not(far))))

    total = sum((step(i) for i in range(1, BUCKETS // 32)), step(0))
    a, b = (F.conv(F.substring(c, 1, 3), 16, 10).cast("long") for c in (left, right))
    total = total + LENGTH_STEP * F.least(F.abs(a - b), F.lit(LENGTH_STEPS))
    return pairs.withColumn(score, 1.0 - total / F.lit(float(BOUND)))


def _slots(rows: DataFrame, wanted: int) -> tuple[DataFrame, list[tuple]]:
    """Rows with the slot (a range of the order) they lie in, and the first row of every slot in use.

    Split points are quantiles of the ids; an id that several quantiles fall on
    (or null) is cut further by the md5 of its texts.
    """
    size = min(max(wanted, 1), MAX_SLOTS)
    cuts, total, nulls = rows.agg(
        F.percentile_approx("id", [i / size for i in range(1, size)] or [0.5], 4 * size), F.count(F.lit(1)),
        F.count_if(F.col("id").isNull())).first()
    points = sorted(set(map(float, cuts or [0])))
    borders = [-float("inf"), *points, float("inf")]
    often: dict[int, int] = {}
    for c in cuts or []:
        often[c] = often.get(c, 0) + 1
    parts = {c: k for c, k in often.items() if k > 1}
    null_parts = max(1, -(-size * nulls // max(total, 1)))

    # Ranges are numbered from the largest ids to the least, the nulls come last.
    width = [1] * (len(borders) - 1)
    for c, k in parts.items():
        width[bisect_right(borders, float(c)) - 1] += k + 1
    begin, at = [0] * (len(width) + 1), 0
    for i in reversed(range(len(width))):
        begin[i], at = at, at + width[i]
    begin[len(width)] = at
    rows = Bucketizer(splits=borders, inputCol="as_double", outputCol="range", handleInvalid="keep").transform(
        rows.withColumn("as_double", F.col("id").cast("double")))
    place = F.conv(F.substring("tie", 1, 6), 16, 10).cast("long")
    within = F.when(F.col("id").isNull(), F.shiftright(place * null_parts, 24))
    for c, k in sorted(parts.items()):
        # The ids of this range above c, then c itself cut into k, then ids below c (equal to it as doubles).
        b = bisect_right(borders, float(c)) - 1
        within = within.when(F.col("range") == b, F.when(F.col("id") == c, F.shiftright(place * k, 24) + 1)
                             .when(F.col("id") > c, 0).otherwise(k + 1))
    span = F.coalesce(F.col("range").cast("int"), F.lit(len(width)))
    rows = rows.withColumn("slot", (F.element_at(F.lit(begin), span + 1)
                                    + within.otherwise(F.lit(0))).cast("int")).drop("as_double", "range")
    firsts = rows.groupBy("slot").agg(F.min(F.struct(F.bitwise_not("id").alias("down"), "tie")).alias("f"))
    return rows, sorted((r["slot"], r["f"]["down"], r["f"]["tie"]) for r in firsts.collect())


def neighbour_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the fingerprints of its text and of its edited text.

    The edited text replaces the last third of the code points by the first as
    many (or all) of the next row's text, in descending order of the (whole-number) id; after
    the last row comes the first.  Texts move once, to the slot of their range;
    the first row of each slot goes to the slot before it as well.  A slot is
    sorted and streamed, so only neighbouring rows are held.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("tie", F.md5("text"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, firsts = _slots(rows, 4 * wanted)
    mark = F.concat_ws(":", F.col("slot"), F.col("tie"), F.bitwise_not("id").cast("string"))
    named = [":".join([str(s), tie, *([] if down is None else [str(down)])]) for s, down, tie in firsts]
    before = {name: (firsts[i - 1][0], 2 if i == 0 else 1) for i, name in enumerate(named)}
    own = F.struct(F.col("slot"), F.lit(0).alias("guest"))
    if before:
        to = F.create_map(*[F.lit(x) for name, (slot, guest) in before.items() for x in (name, slot * 4 + guest)])
        there = F.element_at(to, mark)
        seats = F.when(mark.isin(list(before)), F.array(own, F.struct(
            F.shiftright(there, 2).alias("slot"), there.bitwiseAND(F.lit(3)).alias("guest")))).otherwise(F.array(own))
    else:
        seats = F.array(own)
    seated = rows.withColumn("seat", F.explode(seats)) \
        .select("id", "text", "tie", "seat.slot", "seat.guest") \
        .repartition(wanted, "slot") \
        .sortWithinPartitions("slot", F.col("guest") == 2, F.bitwise_not("id").asc_nulls_last(), "tie", "guest") \
        .select("slot", "guest", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None                      # last row seen: slot, guest, id, text, digest
        for batch in sub_batches(batches):
            slots, guests = batch.column("slot").to_pylist(), batch.column("guest").to_pylist()
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            own = digests([t.encode() for t in texts])
            out, edits, mine, after = [], [], [], []
            for i, (slot, guest, key, text) in enumerate(zip(slots, guests, ids, texts)):
                row = (slot, guest, key, text, own[0][i], own[1][i])
                if held is not None and held[0] == slot and not held[1]:
                    third = len(held[3]) // 3
                    edited = (held[3][:len(held[3]) - third] + text[:third]).encode()
                    edits.append(edited)
                    mine.append(held[4:])
                    after.append(row[4:])
                    out.append((held[2], len(held[3]), hashlib.sha256(edited).hexdigest()))
                held = row
            if not out:
                continue
            got = digests(edits)
            mine, after = ((np.stack([r[0] for r in x]), np.array([r[1] for r in x])) for x in (mine, after))
            key, size, digest = zip(*out)
            yield pa.RecordBatch.from_arrays([
                pa.array(key, batch.schema.field("id").type), pa.array(size, pa.int64()), pa.array(digest, pa.string()),
                pa.array(to_text(*mine), pa.string()), pa.array(to_text(*got), pa.string()),
                pa.array(likeness(mine, got), pa.float64()), pa.array(likeness(mine, after), pa.float64())], names)

    out = seated.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
