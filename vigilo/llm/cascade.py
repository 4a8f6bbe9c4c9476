"""Quality rules as a short-circuit cascade (operator 7).

Every rule looks at one document and rejects it or not; a document is kept if
no rule rejects it, so the verdict does not depend on the order of the rules.
The order decides the work: each rule's cost (seconds per document) and
selectivity (share rejected) are estimated on a Bernoulli sample of
``sample_rows`` expected documents, and rules run by rejection per cost, each
only over the documents that are still alive.  Features that are there already
(the base rule's, the output's) cost nothing and are cut to the living rows;
a feature that a rule asks for first is computed for those rows alone, from the
words as found once.

Defined results: null text counts as empty (no words, fails the base rule);
repeated rows are judged one by one; an empty table gives an empty result;
further columns are ignored and never clash because only ``id_col`` and
``text_col`` are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilo.llm.words import Spans, Words, gram_positions, sub_batches

# Fixed values of the base rule and of the method's own rules (shares in %).
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 20         # symbols per 100 words
MAX_DUP_LINE_PERCENT = 50       # repeated lines per 100 lines with a word
MAX_SHOUT_PERCENT = 50          # words that end in two exclamation marks per 100 words
WORD_CHARS = (2, 25)            # least and largest mean word length in code points
SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


class Batch:
    """Features of a batch, each computed once and only when a rule asks for it."""

    def __init__(self, column: pa.Array):
        self._words = Words(column)
        self.n_words = self._words.counts
        self._cache: dict[str, np.ndarray] = {}

    def take(self, rows: np.ndarray) -> Batch:
        """Some documents with the features known so far; words are copied only if another one is asked for."""
        out = object.__new__(Batch)
        out._words, out._from = None, (self, rows)
        out.n_words = self.n_words[rows]
        out._cache = {k: x[rows] for k, x in self._cache.items()}
        return out

    def again(self) -> Batch:
        """The same documents; features computed here are not known to ``self``."""
        out = object.__new__(Batch)
        out._words, out.n_words, out._cache = self.words, self.n_words, dict(self._cache)
        return out

    @property
    def words(self) -> Words:
        if self._words is None:
            batch, rows = self._from
            self._words = batch.words.take(rows)
        return self._words

    def _get(self, name: str, make) -> np.ndarray:
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    @property
    def n_symbols(self) -> np.ndarray:
        return self._get("symbols", lambda: self.words.per_doc(_SYMBOL[self.words.data]))

    @property
    def word_chars(self) -> np.ndarray:
        return self._get("chars", self.words.word_chars)

    @property
    def lines(self) -> np.ndarray:
        """Per document: lines with a word, and those equal to an earlier line."""
        def make():
            out = np.zeros((self.words.n_docs, 2), np.int64)
            for i in range(self.words.n_docs):
                rows = [x for x in self.words.text(i).split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
                out[i] = len(rows), len(rows) - len(set(rows))
            return out
        return self._get("lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        return self._get("repeats", self._repeat_words)

    def _repeat_words(self) -> np.ndarray:
        w = self.words
        at, doc = gram_positions(w.ptr, 3)
        covered = np.zeros(len(w.starts) + 3, bool)
        if len(at):
            key = Spans(w.hashes()).of(at, at + 3)
            order = np.lexsort((key, doc))
            k, d = key[order], doc[order]
            same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = at[twice]
            for j in range(3):
                covered[hit + j] = True
        total = np.zeros(len(w.starts) + 1, np.int64)
        np.cumsum(covered[:len(w.starts)], out=total[1:])
        return total[w.ptr[1:]] - total[w.ptr[:-1]]

    @property
    def n_shouts(self) -> np.ndarray:
        def make():
            w = self.words
            bang = w.data == ord("!")
            last = w.ends - 1
            loud = bang[last] & bang[np.maximum(last - 1, 0)] & (w.ends - w.starts > 2)
            total = np.zeros(len(loud) + 1, np.int64)
            np.cumsum(loud, out=total[1:])
            return total[w.ptr[1:]] - total[w.ptr[:-1]]
        return self._get("shouts", make)


def _symbols(b: Batch) -> np.ndarray:
    return 100 * b.n_symbols > MAX_SYMBOL_PERCENT * b.n_words


def _dup_lines(b: Batch) -> np.ndarray:
    return 100 * b.lines[:, 1] > MAX_DUP_LINE_PERCENT * b.lines[:, 0]


def _shouting(b: Batch) -> np.ndarray:
    return 100 * b.n_shouts > MAX_SHOUT_PERCENT * b.n_words


def _word_length(b: Batch) -> np.ndarray:
    return (b.word_chars < WORD_CHARS[0] * b.n_words) | (b.word_chars > WORD_CHARS[1] * b.n_words)


#: The method's rules, by name: batch -> rejected.
RULES = {"symbols": _symbols, "dup_lines": _dup_lines, "shouting": _shouting, "word_length": _word_length}


def base_failed(b: Batch) -> np.ndarray:
    return (b.n_words < MIN_WORDS) | (100 * b.n_repeat_words > MAX_REPEAT_PERCENT * b.n_words)


def output_features(b: Batch) -> list[np.ndarray]:
    return [b.n_words, b.word_chars, b.n_symbols, b.lines[:, 1], b.n_repeat_words]


def _measure(rules: dict, known: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            rows, whole = [], Batch(batch.column("text"))
            known(whole)                  # what is computed for every document in any case
            for name, rule in rules.items():
                b = whole.again()         # nothing else shared: every rule pays for its own features
                began = time.perf_counter()
                hit = int(np.count_nonzero(rule(b)))
                rows.append((name, time.perf_counter() - began, hit, batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["rule", "seconds", "hits", "docs"])
    return run


def rule_order(docs: DataFrame, rules: dict | None = None, text_col: str = "text",
               sample_rows: int = SAMPLE_ROWS, seed: int = 7, known: Callable = base_failed) -> list[str]:
    """Rule names by estimated rejection per cost, best first.

    A cost is what a rule adds to the features that ``known`` computes anyway.

    The sample has about ``sample_rows`` documents (all, if the table is
    smaller); only one row per rule reaches the driver.
    """
    rules = RULES if rules is None else rules
    text = docs.select(F.col(text_col).alias("text"))
    n = docs.count()
    if n > sample_rows:
        text = text.sample(sample_rows / n, seed)
    seen = {r.rule: r for r in (
        text.mapInArrow(_measure(rules, known), "rule string, seconds double, hits long, docs long")
        .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits"),
                             F.sum("docs").alias("docs")).collect())}
    gain = {k: ((r.hits + 1) / (r.docs + 2)) / max(r.seconds / r.docs, 1e-9) for k, r in seen.items()}
    return sorted(rules, key=lambda k: (-gain.get(k, 0.0), k))


def _short_circuit(batch: Batch, order: list[str], rules: dict, alive: np.ndarray) -> np.ndarray:
    """Documents that no rule rejects; a rule sees only those still alive."""
    kept = alive.copy()
    rows = np.flatnonzero(alive)
    view = batch if alive.all() else batch.take(rows)
    for name in order:
        if not len(rows):
            break
        hit = rules[name](view)
        if hit.any():
            kept[rows[hit]] = False
            rows, view = rows[~hit], view.take(np.flatnonzero(~hit))
    return kept


def quality_cascade(docs: DataFrame, rules: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
                    order: list[str] | None = None) -> DataFrame:
    """One row per document: base features, ``base_failed`` and ``kept``.

    ``order`` fixes the rule order; by default it is estimated first.
    """
    rules = RULES if rules is None else rules
    order = rule_order(docs, rules, text_col, known=output_features) if order is None else order
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            b = Batch(batch.column("text"))
            features = output_features(b)
            failed = base_failed(b)
            kept = _short_circuit(b, order, rules, ~failed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(x, pa.int64()) for x in features] + [pa.array(failed), pa.array(kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                  "n_repeat_words long, base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, rules: dict | None = None, text_col: str = "text") -> DataFrame:
    """The documents that pass the base rule and the cascade, columns unchanged (no shuffle)."""
    rules = RULES if rules is None else rules
    order = rule_order(docs, rules, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text_col):
            b = Batch(batch.column(text_col))
            yield batch.filter(pa.array(_short_circuit(b, order, rules, ~base_failed(b))))

    return docs.mapInArrow(run, docs.schema)
