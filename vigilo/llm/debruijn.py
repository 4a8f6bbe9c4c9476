"""Repeated passages by De Bruijn compaction (operator 5).

Nodes are runs of ``WINDOW - 1`` words, edges the ``WINDOW``-word windows that
join them.  Walking a text, successive edges with the same *minimizer* (the
least hashed 6-word gram inside the window, by place) form one path segment;
equal windows always have equal minimizers, so all copies of an edge lie in
segments of one minimizer.  The graph is compacted before it is ever spelled
out edge by edge:

1. a count per minimizer drops every segment whose minimizer is nowhere else;
2. a minimizer with one segment content is a nonbranching repeated path: it is
   kept as one compact edge, however many windows it has;
3. a minimizer with several contents is a branching place.  Segments that
   recur verbatim stay compact; the others are opened into single edges, which
   are counted and joined back one by one.

Source coordinates (text, first word, number of windows) travel with every
segment; joined back to the texts they verify and merge into maximal repeated
spans.  A word is removed if a repeated window covers it, judged on the input.

Texts are identified by 96 bits of hash, edges by 128.  Text is shuffled once,
compressed.

Defined results: null texts have no words; texts of fewer than ``WINDOW`` words
lose none; an exact copy of a text of at least ``WINDOW`` words loses all;
repeated rows count as copies; an empty table gives an empty result; kept words
are joined by one space; further columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from vigilo.llm.words import Spans, Words, gram_positions, mix, sub_batches

WINDOW = 35
GRAM = 6
# Verdicts on a segment: repeated (nonbranching, or recurring at a branching place);
# the same, and it lends its edges to the count for all its copies; open.
REPEATED, SOURCE, OPEN = 0, 1, 2


# ------------------------------------------------------------------------ segments
class Segments:
    """Path segments of a batch: document, first word (in the document), windows, minimizer, content."""

    def __init__(self, words: Words, window: int = WINDOW):
        self.hashes = words.hashes()
        self.span = Spans(self.hashes)
        at, doc = gram_positions(words.ptr, window)
        if not len(at):
            self.doc = self.first = self.n = np.zeros(0, np.int64)
            self.minimizer = self.content = np.zeros(0, np.uint64)
            self.start = self.first
            return
        n = len(self.hashes)
        index = np.arange(n - GRAM + 1)
        gram = self.span.of(index, index + GRAM)
        places = np.uint64((1 << max(24, n.bit_length())) - 1)
        low = (mix(gram) & ~places) | index.astype(np.uint64)
        width, size = window - GRAM + 1, 1
        while 2 * size <= width:                     # sliding minimum by doubling
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if width > size:
            low = np.minimum(low[:size - width], low[width - size:])
        place = (low[at] & places).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        self.n = np.diff(np.append(head, len(at)))
        self.start = at[head]                        # in the batch
        self.doc = doc[head]
        self.first = self.start - words.ptr[self.doc]
        self.minimizer = gram[place[head]]
        self.content = self.span.of(self.start, self.start + self.n + window - 1)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, hp, minimizer, content: hp holds the rest of the text's hash, the first word and the windows."""
    for batch in sub_batches(batches):
        s = Segments(Words(batch.column("text")))
        h1 = batch.column("h1").to_numpy()[s.doc]
        h2 = batch.column("h2").to_numpy()[s.doc]
        hp = (h2 << 32) | (s.first << 5) | s.n
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (h1, hp, s.minimizer.view(np.int64), s.content.view(np.int64))],
            ["h1", "hp", "minimizer", "content"])


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the two halves of the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.xxhash64(text).alias("_h1"),
                       F.shiftright(F.xxhash64(F.lit("passage"), text), 32).alias("_h2"))


def judged_segments(texts: DataFrame) -> DataFrame:
    """Per text ``h1, h2, segments``: its repeated or open segments (first word << 7 | windows << 2 | verdict)."""
    a = texts.mapInArrow(_segment_rows, "h1 long, hp long, minimizer long, content long")
    # Written, so that the joins below can split a minimizer or content that is everywhere.
    shared = (a.groupBy("minimizer").agg(F.count("*").alias("n"), F.min("content").alias("lo"),
                                         F.max("content").alias("hi"))
              .where("n > 1").select("minimizer", (F.col("lo") != F.col("hi")).alias("branching"))).checkpoint()
    found = a.join(shared, "minimizer").checkpoint()
    contents = (found.where("branching").groupBy("minimizer", "content")
                .agg(F.count("*").alias("n"), F.min(F.struct("h1", "hp")).alias("first")).checkpoint())
    lends = (F.col("h1") == F.col("first.h1")) & (F.col("hp") == F.col("first.hp"))
    branching = (found.where("branching").join(contents, ["minimizer", "content"])
                 .select("h1", "hp", F.when(F.col("n") == 1, OPEN).when(lends, SOURCE).otherwise(REPEATED).alias("verdict")))
    verdicts = found.where("not branching").select("h1", "hp", F.lit(REPEATED).alias("verdict")).unionByName(branching)
    low = F.col("hp").bitwiseAND(F.lit(0xFFFFFFFF))
    return (verdicts.select("h1", F.shiftright("hp", 32).alias("h2"),
                            F.shiftleft(low, 2).bitwiseOR(F.col("verdict")).alias("segment"))
            .groupBy("h1", "h2").agg(F.collect_set("segment").alias("segments")))


# --------------------------------------------------------------------------- texts
def _packed(columns: list[str], text_col: str):
    """Rows with the text compressed (it is shuffled once)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in sub_batches(batches, text_col):
            z = [press.compress((x or "").encode()) for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(z, pa.binary())],
                                             columns + ["_z"])
    return run


def _texts(column: pa.Array) -> pa.Array:
    open_ = zstandard.ZstdDecompressor()
    return pa.array([open_.decompress(z) for z in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _edges(only_open: bool):
    """Single edges of the segments at branching places: one copy of each content, counted
    per batch, or the open segments' edges with their coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = Words(_texts(batch.column("_z")))
            s = Segments(words)
            known = {}
            for d, rows in enumerate(batch.column("_segments").to_pylist()):
                for x in rows or ():
                    known[d, x >> 7] = x & 3
            verdict = np.array([known.get((int(d), int(f)), REPEATED) for d, f in zip(s.doc, s.first)], np.int64)
            pick = np.flatnonzero(verdict == OPEN if only_open else verdict != REPEATED)
            n = s.n[pick]
            owner = np.repeat(pick, n)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at = s.start[owner] + k
            edge = s.span.of(at, at + WINDOW).view(np.int64)
            minimizer = s.minimizer[owner].view(np.int64)
            if only_open:
                doc = s.doc[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (minimizer, edge, batch.column("_h1").to_numpy()[doc],
                                           batch.column("_h2").to_numpy()[doc], s.first[owner] + k)],
                    ["minimizer", "edge", "h1", "h2", "first"])
            else:
                many = 1 + (verdict[owner] == SOURCE)          # a recurring segment stands for two at least
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (minimizer, edge, many)],
                                                 ["minimizer", "edge", "n"])
    return run


def _strip(columns: list[str], text_col: str):
    """Texts without the words that repeated spans cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            kept, total, removed, spans = [], [], [], []
            for z, segments, edges in zip(*(batch.column(c).to_pylist() for c in ("_z", "_segments", "_edges"))):
                words = open_.decompress(z).split()      # bytes split at the same characters as words are defined
                step = np.zeros(len(words) + 1, np.int32)
                for x in segments or ():
                    if x & 3 != OPEN:
                        step[x >> 7] += 1
                        step[(x >> 7) + ((x >> 2) & 31) + WINDOW - 1] -= 1
                for first in edges or ():
                    step[first] += 1
                    step[first + WINDOW] -= 1
                covered = np.cumsum(step[:-1]) > 0
                border = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
                spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(border[::2], border[1::2])])
                kept.append(b" ".join(w for w, c in zip(words, covered) if not c) if covered.any() else b" ".join(words))
                total.append(len(words))
                removed.append(int(covered.sum()))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if c == text_col else batch.column(c) for c in columns]
                + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))],
                columns + ["n_words", "n_removed", "spans"])
    return run


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text, plus ``n_words``,
    ``n_removed`` and the removed ``spans`` (first word, words)."""
    columns = docs.columns
    rest = [c for c in columns if c != text_col]
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])       # no name can clash with ours
    name = dict(zip(columns, inner.columns))
    text = name[text_col]
    keep = [name[c] for c in rest]
    rows = keyed(inner, text)
    segments = judged_segments(rows.select(F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), F.col(text).alias("text")))
    packed = rows.mapInArrow(_packed(keep + ["_h1", "_h2"], text), T.StructType(
        [inner.schema[c] for c in keep] + [T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType()),
                                           T.StructField("_z", T.BinaryType())]))
    segments = segments.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("segments").alias("_segments"))
    joined = packed.join(segments, ["_h1", "_h2"], "left").checkpoint()
    has = lambda least: F.exists("_segments", lambda x: x.bitwiseAND(F.lit(3)) >= least)
    branching = joined.where(has(SOURCE)).select("_h1", "_h2", "_z", "_segments")
    opened = joined.where(has(OPEN)).select("_h1", "_h2", "_z", "_segments")
    repeated = (branching.mapInArrow(_edges(False), "minimizer long, edge long, n long")
                .groupBy("minimizer", "edge").agg(F.sum("n").alias("n")).where("n > 1").select("minimizer", "edge"))
    edges = (opened.mapInArrow(_edges(True), "minimizer long, edge long, h1 long, h2 long, first long")
             .join(repeated, ["minimizer", "edge"])
             .groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.collect_set("first").alias("_edges")))
    is_open = F.coalesce(has(OPEN), F.lit(False))
    full = (joined.where(~is_open).withColumn("_edges", F.lit(None).cast("array<long>"))
            .unionByName(joined.where(is_open).join(edges, ["_h1", "_h2"], "left")))
    schema = T.StructType([*inner.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()),
                                                                           T.StructField("words", T.LongType())])))])
    out = full.select(*keep, "_z", "_segments", "_edges").mapInArrow(_strip(inner.columns, text), schema)
    extra = [c if c not in columns else f"repeat_{c}" for c in ("n_words", "n_removed", "spans")]
    return out.toDF(*columns, *extra)
