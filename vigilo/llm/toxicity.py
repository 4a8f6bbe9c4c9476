"""Toxicity scores by a bidirectional gated recurrent network (operator 9).

A document is read in overlapping windows of ``WINDOW`` words (every
``STRIDE``), all of them, whatever its length.  In a window every word is a
vector of word inputs and character inputs:

* word inputs: an embedding of the word's hash bucket;
* character inputs: the mean embedding of the hash buckets of its character
  n-grams, so spellings never seen before still share their parts.

Both also carry channels that say how far the word's or n-gram's document
counts exceed the labels' base rate in the training rows.  A forward
and a backward gated recurrent layer run over the window, attention pools the
states and a logistic unit scores the window; a document scores its best
window.  The network is trained in numpy by Adam on windows of a bounded
sample of the labelled rows: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` rows,
chosen by a hash of the id among texts of at most ``MAX_TEXT`` characters, so
its cost does not depend on the size of the corpus.  Scoring reads every text
whole; its input side is done once per distinct word of a batch.

Defined results: null and empty texts have one empty window and get its score;
repeated rows get equal scores; unlabelled tables score 0.5 everywhere; an
empty table gives an empty result; rows with null labels are not learned from;
further columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilo.llm.words import Spans, Words, gram_positions, mix, sub_batches

WINDOW = 32
STRIDE = 24
SLOTS = 1 << 19          # places of an evidence table
LEAST_TOXIC = 3          # toxic training rows that a word or n-gram must be in to count as evidence
EMBEDDED = 1 << 14       # hash buckets of the embeddings
WORD_DIM = 4
GRAM_DIM = 4
HIDDEN = 8
MAX_TOXIC = 1200         # rows labelled toxic that training may read
MAX_CLEAN = 3200         # rows labelled clean that training may read
MAX_TEXT = 6_000        # longest text (characters) that training may read; scoring has no limit
BATCH = 32               # windows of one gradient step
STEPS = 800              # gradient steps of training, at every size
FOLDS = 4
THRESHOLD = 0.3
_GRAMS = (3, 4, 5, 6)
_CHANNELS = 4            # evidence of the word, of its n-grams (mean, most), of its first n-grams


# ------------------------------------------------------------------------- inputs
@dataclass
class Vocabulary:
    """Distinct words of a batch: 32-bit hashes of the words and of their character n-grams (ragged)."""
    words: np.ndarray
    grams: np.ndarray
    head: np.ndarray      # n-gram starts the word
    ptr: np.ndarray


def _gram_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes of every word (lower-case ASCII, a border mark at either side),
    whether each starts the word, and their number."""
    length = ends - starts
    padded = length + 2
    ptr = np.concatenate(([0], np.cumsum(padded)))
    text = np.full(ptr[-1], 1, np.uint8)
    word = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    lower = data[starts[word] + at]
    text[ptr[word] + 1 + at] = lower + np.uint8(32) * ((lower >= 65) & (lower <= 90))
    span = Spans(mix(text.astype(np.uint64) + np.uint64(0x51)))
    buckets, owners, heads = [], [], []
    for n in _GRAMS:
        many = np.maximum(padded - n + 1, 0)
        owner = np.repeat(np.arange(len(many)), many)
        i = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + ptr[owner]
        buckets.append((span.of(i, i + n) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(owner)
        heads.append(i == ptr[owner])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.concatenate(heads)[order], np.bincount(owner, minlength=len(starts))


def vocabulary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray,
               chunk: int = 1 << 15) -> Vocabulary:
    """Hashes of the words ``data[starts:ends]``."""
    parts = [_gram_hashes(data, starts[a:a + chunk], ends[a:a + chunk]) for a in range(0, len(starts), chunk)]
    parts = parts or [(np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(0, np.int64))]
    grams, head, many = (np.concatenate(x) for x in zip(*parts))
    return Vocabulary((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), grams, head,
                      np.concatenate(([0], np.cumsum(many))))


def segment_mean(rows: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Mean of the rows of every segment; 0 for an empty one."""
    out = np.zeros((len(ptr) - 1, rows.shape[1]), np.float32)
    n = np.diff(ptr)
    filled = n > 0
    if filled.any():
        out[filled] = np.add.reduceat(rows, ptr[:-1][filled], axis=0) / n[filled][:, None]
    return out


def segment_max(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ptr) - 1, np.float32)
    filled = np.diff(ptr) > 0
    if filled.any():
        out[filled] = np.maximum.reduceat(values, ptr[:-1][filled])
    return out


class Table:
    """Evidence by 32-bit hash: one place per low bits, the hash itself as proof of identity."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.tag, self.value = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.float32)
        place = keys[order] % SLOTS
        self.tag[place], self.value[place] = keys[order], values[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        place = keys % np.uint32(SLOTS)
        return np.where(self.tag[place] == keys, self.value[place], np.float32(0))


class Batch:
    """Distinct words of a text column and the word number of every position."""

    def __init__(self, column: pa.Array):
        w = Words(column)
        h = w.hashes()
        keys, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.vocab = vocabulary(w.data, w.starts[first], w.ends[first], keys)
        self.ptr = w.ptr
        self.n_docs = w.n_docs
        # Place of the same word before, anywhere; -1 for none.
        order = np.argsort(self.ids, kind="stable")
        self.before = np.full(len(order) + 1, -1, np.int64)
        same = self.ids[order[1:]] == self.ids[order[:-1]]
        self.before[order[1:][same]] = order[:-1][same]

    def inside(self, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (steps by windows) and which of them are read: a word that the window
        has had before is passed over."""
        step = np.arange(WINDOW)[:, None]
        at = np.minimum(start + step, max(len(self.ids) - 1, 0))
        return at, (step < n) & (self.before[at] < start)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first position and word count of every window."""
        n = np.diff(self.ptr)
        many = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
        doc = np.repeat(np.arange(self.n_docs), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start = self.ptr[doc] + k * STRIDE
        return doc, start, np.minimum(WINDOW, self.ptr[doc + 1] - start)


# ------------------------------------------------------------------------ network
def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    inputs = WORD_DIM + GRAM_DIM + _CHANNELS
    w = {"word": rng.normal(0, 0.02, (EMBEDDED, WORD_DIM)), "gram": rng.normal(0, 0.02, (EMBEDDED, GRAM_DIM))}
    for side in "fb":
        w["W" + side] = rng.normal(0, 0.4 / np.sqrt(inputs), (inputs, 3 * HIDDEN))
        w["U" + side] = rng.normal(0, 0.4 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
        w["c" + side] = np.zeros(3 * HIDDEN)
    w |= {"A": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "a": rng.normal(0, 0.3, HIDDEN),
          "v": rng.normal(0, 0.3, 2 * HIDDEN), "d": np.zeros(1)}
    return {k: x.astype(np.float32) for k, x in w.items()}


def word_inputs(w: dict[str, np.ndarray], odds: dict[str, Table], vocab: Vocabulary, chunk: int = 1 << 15) -> np.ndarray:
    """Input vector of every distinct word."""
    out = np.empty((len(vocab.words), WORD_DIM + GRAM_DIM + _CHANNELS), np.float32)
    for a in range(0, len(out), chunk):
        words = vocab.words[a:a + chunk]
        ptr = vocab.ptr[a:a + chunk + 1]
        grams, ptr = vocab.grams[ptr[0]:ptr[-1]], ptr - ptr[0]
        known = odds["gram"].of(grams)
        first = np.where(vocab.head[vocab.ptr[a]:vocab.ptr[a] + len(grams)], known, 0.0)
        out[a:a + chunk] = np.concatenate(
            [w["word"][words % EMBEDDED], segment_mean(w["gram"][grams % EMBEDDED], ptr), odds["word"].of(words)[:, None],
             segment_mean(known[:, None], ptr), segment_max(known, ptr)[:, None], segment_max(first, ptr)[:, None]], axis=1)
    return out


def _layer(x: np.ndarray, u: np.ndarray, mask: np.ndarray, reverse: bool, keep: bool):
    """Gated recurrent layer over ``x`` (steps, windows, 3 * HIDDEN inputs already projected)."""
    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    tape = []
    for t in (range(steps - 1, -1, -1) if reverse else range(steps)):
        m = mask[t][:, None]
        hu = h @ u
        zr = sigmoid(x[t][:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[t][:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
        new = h + m * z * (c - h)
        if keep:
            tape.append((t, h, z, r, c, hu[:, 2 * HIDDEN:], m))
        h = new
        out[t] = h
    return out, tape


def _layer_back(grad: np.ndarray, tape: list, u: np.ndarray):
    """Gradients of the projected inputs and of ``u``."""
    gx = np.zeros(grad.shape[:2] + (3 * HIDDEN,), np.float32)
    gu = np.zeros_like(u)
    gh = np.zeros(grad.shape[1:], np.float32)
    for t, h, z, r, c, hc, m in reversed(tape):
        gh = gh + grad[t]
        gz = gh * m * (c - h) * z * (1 - z)
        gc = gh * m * z * (1 - c * c)
        gr = gc * hc * r * (1 - r)
        ghu = np.concatenate([gz, gr, gc * r], axis=1)
        gx[t] = np.concatenate([gz, gr, gc], axis=1)
        gu += h.T @ ghu
        gh = gh * (1 - m * z) + ghu @ u.T
    return gx, gu


def forward(w: dict[str, np.ndarray], projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray,
            keep: bool = False):
    """Window scores (logits).  ``ids`` and ``mask``: steps by windows."""
    hf, tf = _layer(projected["f"][ids], w["Uf"], mask, False, keep)
    hb, tb = _layer(projected["b"][ids], w["Ub"], mask, True, keep)
    h = np.concatenate([hf, hb], axis=2)
    k = np.tanh(h @ w["A"])
    e = np.where(mask > 0, k @ w["a"], -30).astype(np.float32)
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", alpha, h)
    return pooled @ w["v"] + w["d"][0], (tf, tb, h, k, alpha, pooled)


def gradients(w, x, projected, ids, mask, target, weight):
    """Loss gradients of a batch of windows; ``x``: inputs of the distinct words."""
    logit, (tf, tb, h, k, alpha, pooled) = forward(w, projected, ids, mask, True)
    p = sigmoid(logit)
    gl = ((p - target) * weight).astype(np.float32)
    g = {"v": pooled.T @ gl, "d": np.array([gl.sum()], np.float32)}
    gp = gl[:, None] * w["v"]
    ga = np.einsum("nh,tnh->tn", gp, h)
    ge = alpha * (ga - (alpha * ga).sum(axis=0))
    gk = ge[:, :, None] * w["a"] * (1 - k * k)
    g["a"] = np.einsum("tn,tnh->h", ge, k)
    g["A"] = np.einsum("tnh,tnk->hk", h, gk)
    gh = alpha[:, :, None] * gp + gk @ w["A"].T
    gxf, g["Uf"] = _layer_back(gh[:, :, :HIDDEN], tf, w["Uf"])
    gxb, g["Ub"] = _layer_back(gh[:, :, HIDDEN:], tb, w["Ub"])
    flat = ids.ravel()
    gin = np.zeros((len(x), x.shape[1]), np.float32)
    for side, gx in (("f", gxf), ("b", gxb)):
        per_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(per_word, flat, gx.reshape(-1, 3 * HIDDEN))
        g["W" + side] = x.T @ per_word
        g["c" + side] = per_word.sum(axis=0)
        gin += per_word @ w["W" + side].T
    return g, gin, p


def project(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    return {side: x @ w["W" + side] + w["c" + side] for side in "fb"}


def window_scores(weights: dict, odds: dict, batch: Batch, windows, chunk: int = 4096) -> np.ndarray:
    """Logit of every window."""
    x = word_inputs(weights, odds, batch.vocab)
    # The last row stands for places that are not read.
    projected = project(weights, np.vstack([x, np.zeros((1, x.shape[1]), np.float32)]))
    doc, start, n = windows
    ids = np.append(batch.ids, 0)
    out = np.empty(len(doc), np.float32)
    for a in range(0, len(doc), chunk):
        place, inside = batch.inside(start[a:a + chunk], n[a:a + chunk])
        at = np.where(inside, ids[place], len(x))
        out[a:a + chunk], _ = forward(weights, projected, at, inside.astype(np.float32))
    return out


def best_window(n_docs: int, doc: np.ndarray, logit: np.ndarray) -> np.ndarray:
    best = np.full(n_docs, -np.inf, np.float32)
    np.maximum.at(best, doc, logit)
    return best


def score_batch(model: dict, column: pa.Array) -> np.ndarray:
    """Score of every document: its best window."""
    batch = Batch(column)
    windows = batch.windows()
    logit = window_scores(model["weights"], model["odds"], batch, windows)
    return sigmoid(best_window(batch.n_docs, windows[0], logit).astype(np.float64))


# ----------------------------------------------------------------------- training
def evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Cautious log-odds of document counts against the base rate (one standard error
    off); 0 below it.  Purity counts for more than frequency."""
    odds = np.log((toxic + 0.5) / (clean + 0.5)) - np.log(share / (1 - share))
    return np.maximum(odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), 0).astype(np.float32)


def _training_windows(batch: Batch, labels: np.ndarray, odds: dict, rng: np.random.Generator):
    """Windows to learn from (document, start, words): of every document those that
    hold its most telling word, of a clean document about two others as well."""
    v = batch.vocab
    tell = np.append(odds["word"].of(v.words) + segment_max(odds["gram"].of(v.grams), v.ptr), -9)[np.append(batch.ids, len(v.words))]
    doc, start, n = batch.windows()
    step = np.arange(WINDOW)
    peak = np.empty(len(doc), np.float32)
    for a in range(0, len(doc), 65536):
        s, m = start[a:a + 65536, None], n[a:a + 65536, None]
        peak[a:a + 65536] = np.where(step < m, tell[np.minimum(s + step, len(tell) - 1)], -9).max(axis=1)
    best = np.full(batch.n_docs, -np.inf, np.float32)
    np.maximum.at(best, doc, peak)
    extra = rng.random(len(doc)) < 2.0 / np.bincount(doc, minlength=batch.n_docs)[doc]
    rows = np.flatnonzero((peak >= best[doc] - 1e-6) | (extra & (labels[doc] == 0)))
    return doc[rows], start[rows], n[rows]


def _evidence(batch: Batch, labels: np.ndarray, fold: np.ndarray) -> list[dict[str, Table]]:
    """Evidence of words and n-grams by the documents that hold them: without each
    fold in turn, and last of all documents."""
    v = batch.vocab
    doc = np.repeat(np.arange(batch.n_docs), np.diff(batch.ptr))
    pair = np.unique(doc * len(v.words) + batch.ids)
    doc, word = pair // len(v.words), pair % len(v.words)
    border = np.searchsorted(doc, np.arange(0, batch.n_docs + 100, 100))

    def held(kind: str):
        """Document and distinct hashes of 100 whole documents at a time (pairs are sorted by document)."""
        for a, b in zip(border[:-1], border[1:]):
            d, keys = doc[a:b], v.words[word[a:b]]
            if kind == "gram":
                w = word[a:b]
                reps = v.ptr[w + 1] - v.ptr[w]
                at = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(v.ptr[w], reps)
                d, keys = np.repeat(d, reps), v.grams[at]
            both = np.unique(d << 32 | keys)
            yield both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)

    share = labels.mean()
    out: list[dict[str, Table]] = [{} for _ in range(FOLDS + 1)]
    for kind in ("word", "gram"):
        seen = np.concatenate([keys[labels[d] == 1] for d, keys in held(kind)])
        keys, many = np.unique(seen, return_counts=True)
        keys = keys[many >= LEAST_TOXIC]
        del seen, many
        counts = np.zeros((FOLDS, 2, len(keys)), np.int32)
        for d, k in held(kind):
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            hit = np.flatnonzero(keys[at] == k) if len(keys) else np.zeros(0, np.int64)
            np.add.at(counts, (fold[d[hit]], labels[d[hit]], at[hit]), 1)
        total = counts.sum(axis=0)
        for f in range(FOLDS + 1):
            clean, toxic = total - (counts[f] if f < FOLDS else 0)
            out[f][kind] = Table(keys, evidence(toxic, clean, share))
    return out


def distinct_texts(words: Words, sketches: int = 6) -> np.ndarray:
    """Documents that share no minimum 3-word shingle with an earlier one.

    Copies of a training row would let its rare words pass for evidence.
    """
    at, doc = gram_positions(words.ptr, 3)
    out = np.ones(words.n_docs, bool)
    if not len(at):
        return out
    gram = Spans(words.hashes()).of(at, at + 3)
    filled, first = np.unique(doc, return_index=True)
    low = np.stack([np.minimum.reduceat(mix(gram ^ np.uint64(977 * (i + 1))), first) for i in range(sketches)], axis=1)
    seen: set = set()
    for d, keys in zip(filled, low):
        keys = {(i, int(x)) for i, x in enumerate(keys)}
        out[d] = not (keys & seen)
        seen |= keys
    return out


def train(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 11,
          steps: int = STEPS) -> dict:
    """Model of labelled texts; deterministic for the same rows in the same order.

    A training document sees the evidence of the other folds only, as an unseen
    document would.  Passes over the windows follow each other until ``steps``
    batches have been learned, whatever the size of the sample (the last pass is
    finished).  ``prior`` is the share of toxic rows among all labelled
    rows (default: in the sample); rows are weighted to it.
    """
    y = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    kept = distinct_texts(Words(pa.array(texts, pa.large_string())))
    if len(set(y[kept])) == 2:
        texts, y = [t for t, k in zip(texts, kept) if k], y[kept]
    batch = Batch(pa.array(texts, pa.large_string()))
    fold = rng.permutation(len(y)) % FOLDS
    odds = _evidence(batch, y, fold)
    weights = new_weights(rng)
    windows = batch.windows()
    telling = [np.concatenate(x) for x in zip(*(
        [a[fold[w[0]] == f] for a in w] for f in range(FOLDS) for w in [_training_windows(batch, y, odds[f], rng)]))]
    prior = y.mean() if prior is None else prior
    of_class = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    ids = np.append(batch.ids, 0)
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in weights.items()}
    step = 0
    while step < steps:
        rate = 0.01 * (1 - step / steps)
        doc, start, n = telling
        if step:        # what the network itself takes for the most toxic window of each document
            logit = np.empty(len(windows[0]), np.float32)
            for f in range(FOLDS):
                own = fold[windows[0]] == f
                logit[own] = window_scores(weights, odds[f], batch, [a[own] for a in windows])
            top = np.flatnonzero(logit >= best_window(batch.n_docs, windows[0], logit)[windows[0]])
            doc, start, n = (np.concatenate([a, b[top]]) for a, b in zip(telling, windows))
        target = y[doc].astype(np.float32)
        # Every document weighs the same in its class; the classes weigh as among all labelled rows.
        weight = of_class[doc] / np.bincount(doc, minlength=batch.n_docs)[doc]
        weight = (weight / weight.mean()).astype(np.float32)
        order = rng.permutation(len(doc))
        picks = [x[a:a + BATCH] for f in range(FOLDS) for x in [order[fold[doc[order]] == f]]
                 for a in range(0, len(x), BATCH)]
        for i in rng.permutation(len(picks)):
            pick = picks[i]
            part_odds = odds[fold[doc[pick[0]]]]
            place, inside = batch.inside(start[pick], n[pick])
            at = ids[place]
            words, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            part = _part(batch.vocab, words)
            x = word_inputs(weights, part_odds, part)
            g, gin, _ = gradients(weights, x, project(weights, x), local, inside.astype(np.float32),
                                  target[pick], weight[pick] / len(pick))
            step += 1
            _adam(weights, moment, g, step, rate)
            _adam_rows(weights, moment, "word", part.words % EMBEDDED, gin[:, :WORD_DIM], step)
            reps = np.diff(part.ptr)
            per_gram = np.repeat(gin[:, WORD_DIM:WORD_DIM + GRAM_DIM] / np.maximum(reps, 1)[:, None], reps, axis=0)
            _adam_rows(weights, moment, "gram", part.grams % EMBEDDED, per_gram, step)
    return {"weights": weights, "odds": odds[FOLDS]}


def _part(v: Vocabulary, words: np.ndarray) -> Vocabulary:
    reps = (v.ptr[words + 1] - v.ptr[words])
    ptr = np.concatenate(([0], np.cumsum(reps)))
    at = np.arange(ptr[-1]) - np.repeat(ptr[:-1], reps) + np.repeat(v.ptr[words], reps)
    return Vocabulary(v.words[words], v.grams[at], v.head[at], ptr)


def _adam(weights, moment, g, step, rate=0.01, b1=0.9, b2=0.99):
    fix = rate * np.sqrt(1 - b2 ** step) / (1 - b1 ** step)
    for k, x in g.items():
        m, s = moment[k]
        m *= b1
        m += (1 - b1) * x
        s *= b2
        s += (1 - b2) * x * x
        weights[k] -= fix * m / (np.sqrt(s) + 1e-8)


def _adam_rows(weights, moment, name, rows, grads, step, rate=0.01):
    """Adagrad on the touched rows of an embedding."""
    touched, where = np.unique(rows, return_inverse=True)
    g = np.zeros((len(touched), grads.shape[1]), np.float32)
    np.add.at(g, where, grads)
    s = moment[name][1]
    s[touched] += g * g
    weights[name][touched] -= 0.1 * rate * g / (np.sqrt(s[touched]) + 1e-6)


def sample_rows(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC,
                max_clean: int = MAX_CLEAN, max_text: int = MAX_TEXT) -> DataFrame:
    """Labelled texts ``text, y`` chosen by a hash of the id, in a fixed order, among those of
    at most ``max_text`` characters; at most ``max_toxic`` and ``max_clean`` rows.
    An id with both labels counts as toxic."""
    known = (labels.where(allowed & F.col(label_col).isin(0, 1))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    short = docs.where(F.length(F.coalesce(F.col(text_col), F.lit(""))) <= max_text).select(F.col(id_col).alias("id"))
    known = known.join(short, "id", "left_semi")
    mixed = F.xxhash64("id")
    chosen = (known.where("y = 1").orderBy(mixed, "id").limit(max_toxic)
              .unionByName(known.where("y = 0").orderBy(mixed, "id").limit(max_clean)))
    # The sample has at most max_toxic + max_clean ids: a proven bound for the broadcast.
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "id").where(F.length("text") <= max_text).dropDuplicates(["id"])
            .orderBy(mixed, "id").limit(max_toxic + max_clean).select("text", "y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, *args, **kwargs) -> tuple[list[str], list[int]]:
    """The rows of :func:`sample_rows`, at the driver."""
    rows = sample_rows(docs, labels, allowed, *args, **kwargs).collect()
    return [r.text for r in rows], [r.y for r in rows]


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> dict | None:
    """Model of the rows that may be learned from; None without rows of both labels.

    The sample is learned in a task, so that neither its texts nor the memory of
    training (several times the texts) stay with the driver, which gets the model.
    """
    allowed = ~held_out(F.col(id_col))
    prior = labels.where(allowed & F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            y += batch.column("y").to_pylist()
        if len(set(y)) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, y, prior))], pa.binary())], ["model"])

    # The sample is bounded and its order matters: one partition.
    sample = sample_rows(docs, labels, allowed, id_col, text_col, label_col).coalesce(1)
    found = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def _scores(shared, column: pa.Array) -> np.ndarray:
    return np.full(len(column), 0.5) if shared.value is None else score_batch(shared.value, column)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))   # about 1.5 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(shared, batch.column("text")))],
                                             ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
              .mapInArrow(run, f"doc_id {kind}, score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, columns unchanged (no shuffle); all without a model."""
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text_col, 2 << 20):
            yield batch.filter(pa.array(_scores(shared, batch.column(text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)
