"""Source divergence audit over a minimal acyclic transducer of the kept terms.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  Each
language keeps the terms that occur in at least ``min_docs`` of its documents.
The kept terms, sorted, are built into a minimal acyclic transducer: equal
suffixes share states, and a transition carries the number of terms that sort
before it, so the numbers along a term's path add up to its ordinal in UTF-8
order.  Text is streamed through the transducer (all words of a batch advance
together, one byte a step) to count (language, source, ordinal); strings are
neither shuffled nor joined for that, and ordinals break ties of ranks.

A vocabulary grows with the corpus, so it is cut into consecutive ranges of at
most ``SHARD`` terms, each built in a task into a transducer of its own that
knows the ordinal of its first term.  Transducers are broadcast in passes of at
most ``PASS_BYTES``; a larger vocabulary takes more passes over the text.

From the counts, every (language, source) group gives term ``t`` the weight
``p = 1 + floor(10**9 * (count + 2) / (N + 2 V))``, and two weights diverge by
``f = floor((p - q)**2 / (p + q))``.  Part ``pair`` sums f over all kept terms
against each other source of the language; part ``term`` lists the ten terms
with the largest f against the whole language among those with p > q.  The sums
run over blocks of ordinals of one language, cut so that a block has about
``CELLS`` (source, term) cells, and as many terms as sources at least: a block
then sends on fewer pair sums than it has cells.

Defined results: null text, language and source count as ''; rows are documents
one by one, repeated or not; a language without kept terms has pair values 0
and no term rows; a group without terms takes part in all pairs; a language
with one source has no pairs; texts of any length are read whole; an empty
table gives no rows; other columns are ignored, whatever their names.  Weights
are exact while a group's kept words number below 9 * 10**15.
"""

from __future__ import annotations

import io
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigilo.llm.words import sub_batches, text_buffers
from vigilo.session import scratch_dir

MIN_DOCS, TOP = 10, 10
SCALE_STEPS = 3                # 10**9 as three factors of 1000
SHARD = 1 << 18                # terms of one transducer, at most
PASS_BYTES = 64 << 20          # transducers broadcast at once, at most (one at least)
CELLS = 1 << 15                # (source, term) cells of a block, unless it would hold fewer terms than sources
FLUSH = 1 << 21                # ordinals gathered before they are counted
_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


# ------------------------------------------------------------- terms of text
class Terms:
    """Terms of a text column: lower-cased bytes end to end, borders, document of each."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        inside = _TERM_BYTE[data]
        n = len(data)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        border = offsets[:-1][offsets[:-1] < n]
        begin[border] = inside[border]
        starts = np.flatnonzero(begin)
        place = np.zeros(n + 1, np.int64)
        np.cumsum(inside, out=place[1:])
        self.data = _LOWER[data[inside]]
        self.borders = np.append(place[starts], len(self.data))
        self.doc = np.searchsorted(offsets, starts, "right") - 1

    def array(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self.doc), pa.py_buffer(self.borders.astype(np.int64)),
                                                pa.py_buffer(self.data))


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.fill_null("").dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


# --------------------------------------------------------------- transducer
class Transducer:
    """Minimal acyclic automaton of sorted terms whose transitions add up to ordinals.

    The outgoing bytes of a state are a bitmap over the byte classes in use;
    transitions lie in the order of their bytes, so the number of lower bits
    finds one.
    """

    def __init__(self, classes: np.ndarray, bits: np.ndarray, base: np.ndarray, final: np.ndarray, target: np.ndarray,
                 skip: np.ndarray, root: int):
        self.classes, self.bits, self.base, self.final = classes, bits, base, final
        self.target, self.skip, self.root, self.words = target, skip, root, bits.shape[1]

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """From terms in ascending order, without repetition."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, bytes, tuple[int, ...]]] = []
        path: list[list] = [[False, bytearray(), []]]          # states still open along the last term

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, labels, targets = path.pop()
                key = (final, bytes(labels), tuple(targets))
                at = register.get(key)
                if at is None:
                    at = register[key] = len(states)
                    states.append(key)
                path[-1][2].append(at)

        last = b""
        for term in terms:
            same, most = 0, min(len(last), len(term))
            while same < most and last[same] == term[same]:
                same += 1
            close(same)
            for byte in term[same:]:
                path[-1][1].append(byte)
                path.append([False, bytearray(), []])
            path[-1][0] = True
            last = term
        close(0)
        final, labels, targets = path[0]
        states.append((final, bytes(labels), tuple(targets)))
        return cls._packed(states)

    @classmethod
    def _packed(cls, states: list[tuple[bool, bytes, tuple[int, ...]]]) -> Transducer:
        final = np.array([s[0] for s in states], bool)
        degree = np.array([len(s[1]) for s in states], np.int64)
        label = np.frombuffer(b"".join(s[1] for s in states), np.uint8)
        target = np.array([t for s in states for t in s[2]], np.int64)
        used = np.unique(label)
        classes = np.full(256, -1, np.int16)
        classes[used] = np.arange(len(used))
        words = max(1, -(-len(used) // 64))
        state = np.repeat(np.arange(len(states)), degree)
        c = classes[label].astype(np.int64)
        bits = np.zeros((len(states), words), np.uint64)
        np.bitwise_or.at(bits, (state, c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        first = np.cumsum(degree) - degree
        held = np.bitwise_count(bits).astype(np.int64)
        base = first[:, None] + np.cumsum(held, axis=1) - held
        # Terms below each state; targets come before the states that lead to them.
        below, skip, at = np.zeros(len(states), np.int64), np.zeros(len(target), np.int64), 0
        for i, (is_final, _, targets) in enumerate(states):
            n = int(is_final)
            for t in targets:
                skip[at] = n
                n += below[t]
                at += 1
            below[i] = n
        return cls(classes, bits, base.astype(np.int32), final, target.astype(np.int32), skip.astype(np.int32), len(states) - 1)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms that are accepted, and their ordinals."""
        live, at, stop = np.arange(len(starts)), starts.copy(), ends
        state, total = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        got, numbers = [], []
        bits, base = self.bits.ravel(), self.base.ravel()
        while len(live):
            over = at == stop
            if over.any():
                hit = over & self.final[state]
                got.append(live[hit])
                numbers.append(total[hit])
                go = ~over
                live, at, stop, state, total = live[go], at[go], stop[go], state[go], total[go]
            c = self.classes[data[at]].astype(np.int64)
            cell = state * self.words + (np.maximum(c, 0) >> 6)
            bit = (np.maximum(c, 0) & 63).astype(np.uint64)
            mask = bits[cell]
            go = (c >= 0) & ((mask >> bit) & np.uint64(1)).astype(bool)
            edge = base[cell[go]] + np.bitwise_count(mask[go] & ((np.uint64(1) << bit[go]) - np.uint64(1))).astype(np.int64)
            live, at, stop = live[go], at[go] + 1, stop[go]
            state, total = self.target[edge].astype(np.int64), total[go] + self.skip[edge]
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(got), np.concatenate(numbers)

    def terms(self) -> Iterator[bytes]:
        """All terms in order of their ordinals."""
        labels = [np.flatnonzero(self.classes == k)[0] for k in range(int(self.classes.max(initial=-1)) + 1)]
        stack = [(self.root, b"")]
        while stack:
            state, prefix = stack.pop()
            if self.final[state]:
                yield prefix
            out = []
            for w in range(self.words):
                mask, edge = int(self.bits[state, w]), int(self.base[state, w])
                for b in range(64):
                    if mask >> b & 1:
                        out.append((int(self.target[edge]), prefix + bytes([labels[64 * w + b]])))
                        edge += 1
            stack.extend(reversed(out))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, classes=self.classes, bits=self.bits, base=self.base, final=self.final, target=self.target,
                 skip=self.skip, root=np.int64(self.root))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        got = np.load(io.BytesIO(data))
        return cls(*(got[k] for k in ("classes", "bits", "base", "final", "target", "skip")), int(got["root"]))


@lru_cache(maxsize=64)
def _loaded(data: bytes) -> Transducer:
    return Transducer.load(data)


# ---------------------------------------------------------------- Spark jobs
def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def document_counts(docs: DataFrame) -> DataFrame:
    """Number of documents by language and term (``docs``: lang, source, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, limit=8 << 20):
            langs, names = _codes(batch.column("lang"))
            found = Terms(batch.column("text"))
            coded = found.array().dictionary_encode()
            size = max(len(coded.dictionary), 1)
            pairs = np.unique(found.doc * size + np.asarray(coded.indices))
            cells, n = np.unique(langs[pairs // size] * size + pairs % size, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(cells // size)),
                 coded.dictionary.cast(pa.string()).take(pa.array(cells % size)), pa.array(n.astype(np.int64))],
                ["lang", "term", "n"])

    return docs.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def build_shards(kept: DataFrame, shard: int = SHARD) -> DataFrame:
    """Transducers of consecutive ranges of (lang, term): lang, first ordinal, number of terms, bytes."""
    n = max(1, -(-kept.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []

        def done() -> pa.RecordBatch:
            data = Transducer.build(terms).dump()
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([terms[0].decode()], pa.string()),
                                               pa.array([len(terms)], pa.int64()), pa.array([data], pa.binary()),
                                               pa.array([len(data)], pa.int64())],
                                              ["lang", "first_term", "n_terms", "automaton", "size"])

        for batch in batches:
            for key, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if terms and (key != lang or len(terms) >= shard):
                    yield done()
                    terms = []
                lang = key
                terms.append(term.encode())
        if terms:
            yield done()

    built = kept.select("lang", "term").repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term") \
        .mapInArrow(run, "lang string, first_term string, n_terms long, automaton binary, size long")
    return _written(built, "transducers")


def numbered(shards: DataFrame) -> DataFrame:
    """Shards with the ordinal of their first term in its language (as many rows as shards)."""
    narrow = shards.select("lang", "first_term", "n_terms")
    order = Window.partitionBy("lang").orderBy("first_term").rowsBetween(Window.unboundedPreceding, -1)
    return narrow.withColumn("first_ordinal", F.coalesce(F.sum("n_terms").over(order), F.lit(0))) \
        .join(shards.select("lang", "first_term", "automaton", "size"), ["lang", "first_term"])


def vocabulary(shards: DataFrame) -> DataFrame:
    """Every kept term with its ordinal, read off the transducers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, first, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "first_ordinal", "automaton"))):
                terms = [t.decode() for t in Transducer.load(data).terms()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()),
                                                  pa.array(np.arange(first, first + len(terms))), pa.array(terms, pa.string())],
                                                 ["lang", "ordinal", "term"])

    return numbered(shards).select("lang", "first_ordinal", "automaton") \
        .mapInArrow(run, "lang string, ordinal long, term string")


def recount(docs: DataFrame, shards: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Occurrences by language, source and ordinal, from streaming all text through the transducers."""
    spark = docs.sparkSession
    listed = sorted((r["lang"], r["first_ordinal"], r["size"]) for r in
                    numbered(shards).select("lang", "first_ordinal", "size").collect())
    passes: list[list[tuple[str, int]]] = []
    room = 0
    for lang, first, size in listed:
        if not passes or room + size > pass_bytes:
            passes.append([])
            room = 0
        passes[-1].append((lang, first))
        room += size
    out = None
    for some in passes:
        own = spark.createDataFrame(some, "lang string, first_ordinal long")
        rows = numbered(shards).join(F.broadcast(own), ["lang", "first_ordinal"]).select("lang", "first_ordinal", "automaton").collect()
        held = spark.sparkContext.broadcast([(r["lang"], r["first_ordinal"], bytes(r["automaton"])) for r in rows])
        one = docs.mapInArrow(_recounter(held), "lang string, source string, ordinal long, n long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _recounter(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang = defaultdict(list)
        for lang, first, data in held.value:
            by_lang[lang].append((first, _loaded(data)))
        waiting: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), parts in waiting.items():
                at, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()),
                                                  pa.array(at), pa.array(n.astype(np.int64))], ["lang", "source", "ordinal", "n"])

        for batch in sub_batches(batches):
            langs, lang_names = _codes(batch.column("lang"))
            sources, source_names = _codes(batch.column("source"))
            found = Terms(batch.column("text"))
            of_lang = langs[found.doc]
            for k, lang in enumerate(lang_names):
                mine = np.flatnonzero(of_lang == k)
                for first, automaton in by_lang.get(lang, ()):
                    hit, number = automaton.ordinals(found.data, found.borders[mine], found.borders[mine + 1])
                    source = sources[found.doc[mine[hit]]]
                    order = np.argsort(source, kind="stable")
                    cut = np.searchsorted(source[order], np.arange(len(source_names) + 1))
                    for s in np.flatnonzero(np.diff(cut)):
                        waiting[lang, source_names[s]].append(number[order[cut[s]:cut[s + 1]]] + first)
                    size += len(hit)
            if size > FLUSH:
                yield from counted()
                waiting.clear()
                size = 0
        yield from counted()

    return run


# ---------------------------------------------------------------- divergence
def weights(counts: np.ndarray, total) -> np.ndarray:
    """``1 + floor(10**9 * (counts + 2) / total)`` by long division, without overflow."""
    rest = counts + 2
    out = np.zeros_like(rest)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _block(top: int):
    def run(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        sources = groups.column("source").to_pylist()
        names = {s: i for i, s in enumerate(sources)}
        size, begin = groups.column("size")[0].as_py(), groups.column("begin")[0].as_py()
        kept = groups.column("n_kept")[0].as_py()
        totals = np.array(groups.column("total").to_pylist(), np.int64)
        n = np.zeros((len(sources), size), np.int64)
        who = cells.column("source").combine_chunks().dictionary_encode() if cells.num_rows else None
        if who is not None:
            who = who.combine_chunks() if isinstance(who, pa.ChunkedArray) else who
            row = np.array([names[s] for s in who.dictionary.to_pylist()])[np.asarray(who.indices)]
            n[row, np.asarray(cells.column("ordinal")) - begin] = np.asarray(cells.column("n"))
        p = weights(n, (totals + 2 * kept)[:, None])
        q = weights(n.sum(axis=0), np.int64(groups.column("lang_total")[0].as_py() + 2 * kept))
        left, right, ordinals, values = [], [], [], []
        for i in range(len(sources)):
            left += [sources[i]] * (len(sources) - 1 - i)
            right += sources[i + 1:]
            values.append(divergence(p[i + 1:], p[i]).sum(axis=1))
        ordinals.append(np.full(len(left), -1, np.int64))
        for i in range(len(sources)):
            at = np.flatnonzero((n[i] > 0) & (p[i] > q))
            f = divergence(p[i, at], q[at])
            first = np.lexsort((at, -f))[:top]
            left += [sources[i]] * len(first)
            right += [None] * len(first)
            ordinals.append(at[first] + begin)
            values.append(f[first])
        return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(left, pa.string()),
                         "other": pa.array(right, pa.string()), "ordinal": pa.array(np.concatenate(ordinals)),
                         "value": pa.array(np.concatenate(values).astype(np.int64))})

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS, shard: int = SHARD,
          pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Ranked divergences: lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in
                         ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = _written(document_counts(docs).filter(F.col("n") >= min_docs).select("lang", "term"), "kept-terms")
    shards = build_shards(kept, shard)
    counts = _written(recount(docs, shards, pass_bytes), "term-counts")
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one") \
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left") \
        .withColumn("total", F.coalesce("total", F.lit(0)))
    groups = _written(groups, "groups")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("total").alias("lang_total")) \
        .join(shards.groupBy("lang").agg(F.sum("n_terms").alias("n_kept")), "lang", "left") \
        .withColumn("n_kept", F.coalesce("n_kept", F.lit(0))) \
        .withColumn("width", F.greatest(F.col("n_sources"), F.floor(F.lit(cells) / F.col("n_sources"))))
    langs = _written(langs, "languages")
    blocks = langs.filter("n_kept > 0").withColumn("block", F.explode(F.expr("sequence(0L, (n_kept - 1) div width)"))) \
        .select("lang", "block", "n_kept", "lang_total", (F.col("block") * F.col("width")).alias("begin"),
                F.least("width", F.col("n_kept") - F.col("block") * F.col("width")).alias("size"))
    cell = counts.join(langs.select("lang", "width"), "lang") \
        .select("lang", F.expr("ordinal div width").alias("block"), "source", "ordinal", "n")
    grid = groups.join(blocks, "lang")
    parts = _written(cell.groupBy("lang", "block").cogroup(grid.groupBy("lang", "block")).applyInArrow(
        _block(top), "lang string, source string, other string, ordinal long, value long"), "divergence")
    order = [F.desc("value"), F.asc("item")]
    halves = parts.filter(F.col("other").isNotNull()).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    empty = groups.join(langs.filter("n_kept = 0").select("lang"), "lang", "left_semi").select("lang", "source")
    none = empty.join(empty.withColumnRenamed("source", "other"), "lang").filter("source < other") \
        .withColumn("value", F.lit(0).cast("long"))
    both = halves.unionByName(none).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    turned = F.col("side") == 1
    pairs = both.select("lang", F.when(turned, F.col("other")).otherwise(F.col("source")).alias("source"), F.lit("pair").alias("part"),
                        F.when(turned, F.col("source")).otherwise(F.col("other")).alias("item"), "value") \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = parts.filter(F.col("other").isNull()).withColumn("rank", F.row_number().over(by_ordinal)).filter(F.col("rank") <= top)
    terms = best.join(vocabulary(shards), ["lang", "ordinal"]) \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
