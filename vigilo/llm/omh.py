"""Near-duplicates by Order MinHash and banded alignment (operator 3).

Equal texts are one text from the start.  A text's words give its 5-word
shingles; equal shingles get occurrence numbers, so repeats count.  For each
of ``SKETCHES`` hash functions the two least shingles are kept *in text order*
(Order MinHash), so a sketch agrees only if shared shingles also stand in the
same order: its probability follows edit similarity.  Texts that agree in a
sketch are candidates and are verified by a banded word alignment: similar if
``1 - edits / longer length >= 0.8``.

A sketch value that thousands of texts share is not expanded into pairs at once:
its members are first compared with one member, the pivot, the one that shares
its values with the most texts (the original of a family of variants).  Where
a value is crowded (unrelated texts share a common line), two successive sketches
together are a second, purer key with a pivot of its own.  The comparisons of a
pivot are dealt to groups of bounded size, each with a copy of the pivot's text.

Then every pair that shares a value and is not in one class yet is settled.  The
members of a crowded value are dealt to bands of length and in them to blocks of
bounded size, which meet in cells, except that the largest class does not meet
itself; a pair that shares several values meets in the first.  Lengths and word bags (counts of
hashed words, whose distance is a lower bound) rule out strangers without their
texts; the texts of the others are aligned, members with many partners first,
unless a link made before has put both in one class.  Linked texts form classes by
alternating large and small stars.  The result has one row per document.

Defined results: texts without words (null, empty, blank) are one class; texts
of fewer than five words have one shingle, all their words; equal texts share a
class whatever their length; an empty table gives an empty result; repeated ids
are separate rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilo.llm.words import Spans, Words, gram_positions, mix, sub_batches

SHINGLE = 5
SKETCHES = 16         # 0.95 of pairs at similarity 0.9 share one, 0.67 at 0.85, 0.44 at 0.8
ORDER = 2            # shingles of one sketch
SIMILARITY = 0.8
GROUP_MEMBERS = 256  # comparisons of one group
GROUP_WORDS = 1 << 18  # words of one group, unless one text is longer
BLOCK_MEMBERS = 4096  # texts of one block; two blocks meet in a cell
BLOCK_WORDS = 1 << 19  # words of one block
BAG = 256            # counters of a word bag
CROWD = 64           # members from which a value is crowded
FILTER_BITS = 1 << 27  # largest table of wanted texts that is broadcast (16 MB)
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# ------------------------------------------------------------------------ sketches
def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes, their documents, and each document's first shingle."""
    h = words.hashes()
    span = Spans(h)
    at, doc = gram_positions(words.ptr, SHINGLE)
    key = span.of(at, at + SHINGLE)
    short = np.flatnonzero(words.counts < SHINGLE)       # all their words are one shingle
    a, b = words.ptr[short], words.ptr[short + 1]
    key = np.concatenate([key, span.of(a, b)])
    doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    # Occurrence number of equal shingles in one document, in text order.
    by = np.lexsort((np.arange(len(key)), key, doc))
    k, d = key[by], doc[by]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    run = np.flatnonzero(fresh)
    number = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
    label = np.empty(len(k), np.uint64)
    label[by] = mix(k + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return label, doc, np.searchsorted(doc, np.arange(words.n_docs))


def sketches(words: Words, n: int = SKETCHES) -> np.ndarray:
    """Order MinHash of every document: ``n`` values, each of the two least shingles in text order."""
    label, doc, first = shingles(words)
    place = np.arange(len(label), dtype=np.uint64)
    places = np.uint64((1 << max(24, len(label).bit_length())) - 1)
    out = np.empty((words.n_docs, n), np.uint64)
    single = np.diff(np.append(first, len(label))) < 2
    for i in range(n):
        # The hash in the upper bits, the place in the lower: a minimum also tells where it is.
        low = (mix(label ^ _SEEDS[i]) & ~places) | place
        one = np.minimum.reduceat(low, first)
        p = (one & places).astype(np.int64)
        low[p] = np.uint64(0xFFFFFFFFFFFFFFFF)
        two = np.minimum.reduceat(low, first)
        q = np.where(single, p, (two & places).astype(np.int64))
        a, b = label[np.minimum(p, q)], label[np.maximum(p, q)]
        out[:, i] = mix(a * np.uint64(3) + mix(b) + np.uint64(i))
    return out


def bags(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Counts of the words of every document by hash, at most 15 each, two to a byte."""
    n = len(ptr) - 1
    at = np.repeat(np.arange(n), np.diff(ptr)) * BAG + (h % np.uint64(BAG)).astype(np.int64)
    count = np.minimum(np.bincount(at, minlength=n * BAG), 15).astype(np.uint8).reshape(n, BAG)
    return count[:, ::2] << 4 | count[:, 1::2]


def counters(packed: np.ndarray) -> np.ndarray:
    """The counters of packed bags."""
    return np.concatenate([packed >> 4, packed & 15], axis=1).astype(np.int16)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        words = Words(batch.column("text"))
        keys = sketches(words).view(np.int64)
        offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(words.counts.astype(np.int64)),
             pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
             pa.array([x.tobytes() for x in bags(words.hashes(), words.ptr)], pa.binary())],
            ["doc_id", "text_key", "n", "keys", "bag"])


# ----------------------------------------------------------------------- alignment
def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edits between ``a`` and ``b``, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Common ends need no alignment.
    k = min(len(a), len(b))
    same = a[:k] == b[:k]
    head = k if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    same = a[::-1][:k] == b[::-1][:k]
    tail = k if same.all() else int(np.argmin(same))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not len(b) or not most:
        return min(len(a), most + 1)
    return banded(a.tolist(), b.tolist(), min(most, len(a)), most)


def banded(a: list, b: list, band: int, most: int) -> int:
    """Alignment in the band of ``band`` diagonals to either side, one bit per diagonal.

    Bit-parallel dynamic programming (Hyyro's banded form of Myers' algorithm):
    a column of the band is two bit vectors of vertical differences, up and
    down; they slide one row down with every word of ``b``.  ``a`` is the longer.
    """
    n, m = len(a), len(b)
    width = 2 * band + 1
    ones = (1 << width) - 1
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    up, down = (ones >> band) << band, 0          # differences +1 and -1 between neighbouring rows
    distance = band                               # at the lowest diagonal of the band
    bottom, side = 1 << (width - 1), 1 << (width - 2)
    for j in range(m):
        shift = j - band
        hits = place.get(b[j], 0)
        match = (hits >> shift if shift >= 0 else hits << -shift) & ones
        diagonal = (((match & up) + up) ^ up | match | down) & ones
        across_up = (down | ~(diagonal | up)) & ones
        across_down = diagonal & up
        if j < n - band:                          # the lowest diagonal is still inside: follow it down
            distance += not diagonal & bottom
            if band == most and distance > 2 * band + m - n:
                return most + 1                   # the last row cannot win that back
        else:                                     # along the last row
            distance += bool(across_up & side) - bool(across_down & side)
            side >>= 1
        diagonal >>= 1
        up = (across_down | ~(diagonal | across_up)) & ones
        down = diagonal & across_up
    return distance if distance <= most else most + 1


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection."""
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    return int(np.minimum(np.bincount(where[:len(a)], minlength=len(both)),
                          np.bincount(where[len(a):], minlength=len(both))).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int(np.floor((1 - least) * longer + 1e-9))
    if longer - min(len(a), len(b)) > most or longer - common_words(a, b) > most:
        return False        # so many words have no partner at all
    return edit_distance(a, b, most) <= most


# ---------------------------------------------------------------------------- links
def _keep_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop rows whose id equals the row before (copies of a text stand together after the join)."""
    last = None
    for batch in batches:
        ids = batch.column("id").to_numpy()
        if not len(ids):
            continue
        fresh = np.ones(len(ids), bool)
        fresh[1:] = ids[1:] != ids[:-1]
        fresh[0] = ids[0] != last
        last = ids[-1]
        yield batch.filter(pa.array(fresh))


def _verify(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Members of one group that are similar to its pivot."""
        pivot, ids = table.column("pivot")[0].as_py(), table.column("id").to_numpy()
        words = Words(table.column("text").combine_chunks())
        h = words.hashes()
        parts = [h[words.ptr[i]:words.ptr[i + 1]] for i in range(len(ids))]
        centre = next((p for p, i in zip(parts, ids) if i == pivot), None)
        found = [] if centre is None else sorted(
            {int(i) for p, i in zip(parts, ids) if i != pivot and similar(centre, p, least)})
        return pa.table({"a": pa.array([pivot] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})
    return run


def _partners(table: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of a cell that may be similar, are in different classes and meet in no earlier sketch."""
    block, root, n = (table.column(c).to_numpy() for c in ("block", "root", "n"))
    x, y = (table.column(c)[0].as_py() for c in ("x", "y"))
    early = table.column("early").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    bag = counters(np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint8).reshape(len(n), BAG // 2))
    second = np.flatnonzero(block == y)
    for i in np.flatnonzero(block == x):
        j = second[second > i] if x == y else second
        longer = np.maximum(n[i], n[j])
        most = np.floor((1 - least) * longer + 1e-9).astype(np.int64)
        fit = (root[j] != root[i]) & (longer - np.minimum(n[i], n[j]) <= most)
        j, longer, most = j[fit], longer[fit], most[fit]
        fit = np.abs(bag[j] - bag[i]).sum(axis=1) <= n[i] + n[j] - 2 * (longer - most)
        j = j[fit]
        j = j[~(early[j] == early[i]).any(axis=1)]
        if len(j):
            yield int(i), j


def _near(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Members of one cell whose texts are needed."""
        some = np.zeros(table.num_rows, bool)
        for i, j in _partners(table, least):
            some[i] = True
            some[j] = True
        return table.filter(pa.array(some)).select(["id", "key", "x", "y", "block", "early"])
    return run


def _settle(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of one cell: every pair is aligned unless links made before join it."""
        ids = table.column("id").to_numpy()
        found = [(np.full(len(j), i), j) for i, j in _partners(table, least)]
        links_a, links_b = [], []
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            words = Words(table.column("text").combine_chunks())
            h = words.hashes()
            parts = [h[words.ptr[i]:words.ptr[i + 1]] for i in range(len(ids))]
            many = np.bincount(np.concatenate([a, b]), minlength=len(ids))
            hub = np.where(many[a] >= many[b], a, b)
            above = np.unique(table.column("root").to_numpy(), return_inverse=True)[1].tolist()
            top = list(range(len(ids)))

            def find(i: int) -> int:
                while top[i] != i:
                    top[i] = top[top[i]]
                    i = top[i]
                return i

            for at in np.lexsort((hub, -many[hub])).tolist():
                i, j = int(a[at]), int(b[at])
                p, q = find(above[i]), find(above[j])
                if p != q and similar(parts[i], parts[j], least):
                    top[p] = q
                    links_a.append(int(ids[i]))
                    links_b.append(int(ids[j]))
        return pa.table({"a": pa.array(links_a, pa.int64()), "b": pa.array(links_b, pa.int64())})
    return run


def _cells(member: DataFrame, least: float) -> DataFrame:
    """Places of the members of every key that holds several classes: ``id, key, block, x, y`` (a cell is key, x, y).

    A key that fits in one block is one cell.  The members of a larger one are
    dealt to bands of length (a similar pair lies in one band or in neighbouring
    ones), in a band to its largest class and the rest, and there to blocks of
    bounded size; blocks of the rest meet each other and those of the largest
    class, blocks of the largest class do not meet.
    """
    by_root = member.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("words"))
    by_key = by_root.groupBy("key").agg(F.max(F.struct("m", "words", "root")).alias("big"), F.sum("m").alias("m"),
                                        F.sum("words").alias("words"), F.count("*").alias("roots")).where("roots > 1")
    by_key = by_key.select("key", F.col("big.root").alias("main"),
                           ((F.col("m") > BLOCK_MEMBERS) | (F.col("words") > BLOCK_WORDS)).alias("large"))
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-np.log(least) + 1e-12)).cast("int")
    dealt = member.join(by_key, "key").select(
        "key", "id", "n", F.when(F.col("large"), band).otherwise(0).alias("band"),
        F.when(F.col("large") & (F.col("root") == F.col("main")), 1).otherwise(0).alias("side"))
    size = dealt.groupBy("key", "band", "side").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_WORDS), F.lit(1)).cast("int").alias("blocks"))
    size = size.checkpoint()
    other = size.select("key", F.col("band").alias("b"), F.col("side").alias("s"), F.col("blocks").alias("k"))
    code = lambda at, side, k: (at * 2 + side).cast("long") * (1 << 32) + k
    meets = (size.join(other, "key").where("abs(band - b) <= 1 AND (side = 0 OR s = 0)")
             .groupBy("key", "band", "side").agg(F.first("blocks").alias("blocks"), F.flatten(F.collect_list(F.transform(
                 F.sequence(F.lit(0), F.col("k") - 1), lambda i: code(F.col("b"), F.col("s"), i)))).alias("others")))
    return (dealt.join(meets, ["key", "band", "side"])
            .withColumn("block", code(F.col("band"), F.col("side"), F.pmod(F.xxhash64("id", "key"), F.col("blocks"))))
            .select("id", "key", "block", F.explode("others").alias("other"))
            .select("id", "key", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")))


def more_links(texts: DataFrame, signs: DataFrame, shared: DataFrame, linked: DataFrame,
               least: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` among all pairs that share a sketch value and are not in one class of ``linked``."""
    root = F.coalesce("root", "id").alias("root")
    member = shared.join(linked, "id", "left").select("id", "n", root, "key")
    rooted = signs.join(linked, "id", "left").select("id", "text_key", F.col("n").cast("int").alias("n"), root, "bag", "keys")
    # Values of the sketches before a key's own tell whether a pair has met already; half of each is enough for that.
    early = F.transform(F.slice("keys", F.lit(1), F.array_position("keys", F.col("key")).cast("int") - 1),
                        lambda k: F.shiftright(k, 32).cast("int"))
    near = (_cells(member, least).join(rooted.drop("text_key"), "id").withColumn("early", early).drop("keys")
            .groupBy("key", "x", "y")
            .applyInArrow(_near(least), "id long, key long, x long, y long, block long, early array<int>"))
    places = near.groupBy("id").agg(F.collect_list(F.struct("key", "x", "y", "block", "early")).alias("to"))
    wanted = places.join(rooted.select("id", "text_key", "n", "root", "bag"), "id").checkpoint()
    row = ("id long, text string, n int, root long, bag binary, "
           "to array<struct<key:long,x:long,y:long,block:long,early:array<int>>>")
    return (_present(texts, wanted).join(wanted, "text_key").select("id", "text", "n", "root", "bag", "to")
            .mapInArrow(_keep_first, row)
            .select("*", F.explode("to").alias("at")).select("id", "text", "n", "root", "bag", "at.*")
            .groupBy("key", "x", "y").applyInArrow(_settle(least), "a long, b long"))


def _bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches and the positions that their keys have in a table of ``size`` bits (a power of two)."""
    for batch in batches:
        if batch.num_rows:
            halves = np.frombuffer(b"".join(batch.column("text_key").to_pylist()), np.uint64).reshape(-1, 2)
            yield batch, (halves & np.uint64(size - 1)).astype(np.int64)


def _present(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most rows whose key is not wanted, so that they are not moved.

    The wanted keys set bits in a table (two bits a key, at most 2 MB from a task
    and 16 MB in all); rows whose bits are not both set go.  Beyond the size
    that such a table serves, all rows stay and the join sorts them out.
    """
    n = wanted.count()
    size = 1 << max(13, (16 * max(n, 1) - 1).bit_length())
    if size > FILTER_BITS:
        return texts
    chunk = 1 << 10

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size // 8, np.uint8)
        for _, at in _bits(batches, size):
            np.bitwise_or.at(table, at.ravel() >> 3, (1 << (at.ravel() & 7)).astype(np.uint8))
        parts = table.reshape(-1, chunk)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)),
                                          pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "bits"])

    def merged(table: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, chunk)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                         "bits": pa.array([np.bitwise_or.reduce(bits, axis=0).tobytes()], pa.binary())})

    rows = (wanted.select("text_key").mapInArrow(marks, "part int, bits binary")
            .groupBy("part").applyInArrow(merged, "part int, bits binary").collect())
    table = np.zeros((size // 8 // chunk, chunk), np.uint8)
    for r in rows:
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    held = texts.sparkSession.sparkContext.broadcast(table.ravel())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in _bits(batches, size):
            hit = (held.value[at >> 3] >> (at & 7) & 1).all(axis=1)
            if hit.any():
                yield batch.filter(pa.array(hit))

    return texts.mapInArrow(keep, "text_key binary, text string")


def shared_values(signs: DataFrame) -> DataFrame:
    """Sketch values of several texts: ``id, n, place, key, m`` (``m`` texts have the value)."""
    single = signs.select("id", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("place", "key"))
    often = single.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return single.join(often, "key").checkpoint()


def links(texts: DataFrame, signs: DataFrame, shared: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Verified links ``a, b`` between distinct texts.

    ``signs``: ``id, text_key, n, keys`` of the distinct texts; ``shared``: their
    shared values; ``texts``: ``text_key, text`` of all rows.
    """
    # Two successive sketches together, where one alone is crowded.
    crowded = shared.where(F.col("m") > CROWD).select("id", "n", "place").join(signs.select("id", "keys"), "id").select(
        "id", "n", F.xxhash64(F.element_at("keys", F.col("place") + 1),
                              F.element_at("keys", F.pmod(F.col("place") + 1, F.lit(SKETCHES)) + 1), "place").alias("key"))
    double = crowded.join(crowded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")
    double = double.checkpoint()
    shared = shared.select("key", "id", "n", "m").unionByName(double.select("key", "id", "n", "m"))
    support = shared.groupBy("id").agg(F.sum("m").alias("support"))
    pivots = (shared.join(support, "id").groupBy("key")
              .agg(F.max(F.struct("support", (-F.col("id")).alias("last"), "n")).alias("p"))
              .select("key", (-F.col("p.last")).alias("pivot"), F.col("p.n").alias("pivot_n")))
    pairs = (shared.join(pivots, "key").where("id <> pivot")
             .where(F.least("n", "pivot_n") >= F.greatest("n", "pivot_n") * least - 1e-9)
             .select("id", "pivot", "n").distinct())
    # Groups of a pivot: bounded in members and in words.
    size = pairs.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / GROUP_MEMBERS),
                                                 F.ceil(F.sum("n") / GROUP_WORDS), F.lit(1)).cast("int").alias("groups"))
    size = size.checkpoint()
    sent = pairs.join(size, "pivot").select(
        "id", F.struct("pivot", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part")).alias("to"))
    own = size.select(F.col("pivot").alias("id"), F.explode(F.transform(
        F.sequence(F.lit(0), F.col("groups") - 1),
        lambda i: F.struct(F.col("pivot").alias("pivot"), i.alias("part")))).alias("to"))
    # One row per text: at most as many places as it has keys, and its own groups.
    places = sent.unionByName(own).groupBy("id").agg(F.collect_set("to").alias("to"))
    wanted = signs.select("id", "text_key").join(places, "id").checkpoint()
    return (_present(texts, wanted).join(wanted, "text_key").select("id", "text", "to")
            .mapInArrow(_keep_first, "id long, text string, to array<struct<pivot:long,part:int>>")
            .select("id", "text", F.explode("to").alias("to"))
            .select(F.col("to.pivot").alias("pivot"), F.col("to.part").alias("part"), "id", "text")
            .groupBy("pivot", "part").applyInArrow(_verify(least), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every linked text: alternating large and small stars until nothing changes."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        e = small.checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _classed(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their text's key, and per distinct text ``text_key, n, least, rows, root``."""
    rows = docs.withColumn("_text_key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    plain = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        F.col("_text_key").alias("text_key"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = plain.mapInArrow(_sketch_rows, f"doc_id {kind}, text_key binary, n long, keys array<long>, bag binary")
    signs = (signed.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"),
                                            F.first("n").alias("n"), F.first("keys").alias("keys"),
                                            F.first("bag").alias("bag"))
             .withColumn("id", F.monotonically_increasing_id()).checkpoint())
    plain = plain.select("text_key", "text")
    shared = shared_values(signs)
    linked = components(links(plain, signs, shared, least))
    linked = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b"))
                        .unionByName(more_links(plain, signs, shared, linked, least)))
    texts = (signs.select("id", "text_key", "least", "rows", "n").join(linked, "id", "left")
             .withColumn("root", F.coalesce("root", "id")))
    return rows, texts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, class_size, n_words``: the class is named by its least document id."""
    rows, texts = _classed(docs.select(id_col, text_col), id_col, text_col, least)
    # Written, so that the join below can split a class that holds a third of all texts.
    classes = texts.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size")).checkpoint()
    named = texts.join(classes, "root").select(F.col("text_key").alias("_text_key"), "class_id", "class_size",
                                               F.col("n").alias("n_words"))
    return (rows.select(F.col(id_col).alias("doc_id"), "_text_key").join(named, "_text_key")
            .select("doc_id", "class_id", "class_size", "n_words"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of every class, the one with the least id (null ids last); columns unchanged."""
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])       # no name can clash with ours
    id_col, text_col = (inner.columns[columns.index(c)] for c in (id_col, text_col))
    rows, texts = _classed(inner, id_col, text_col, least)
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id")).alias("f"))
    kept = (texts.join(first, (texts["root"] == first["root"]) & (texts["id"] == F.col("f.id")))
            .select(F.col("text_key").alias("_kept_key"), F.col("least").alias("_least")))
    return (rows.join(kept, (F.col("_text_key") == F.col("_kept_key")) & F.col(id_col).eqNullSafe(F.col("_least")))
            .dropDuplicates(["_text_key"]).select(*inner.columns).toDF(*columns))
