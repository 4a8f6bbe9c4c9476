"""Masked pseudo-likelihood of texts (operator 4).

A bidirectional window network predicts every token from the tokens on both
sides: ``tanh(left[l] + right[r] + b)`` into a softmax over the token classes.
A text scores the sum of the conditional log-probabilities of all its tokens,
``log P(class | neighbours) + log P(token | class)``.

The second term comes from the vocabulary, the counts of all words of the corpus
in a Spark table that is joined to the words of every text: ``(n + 1) / (tokens +
words + 1)`` within the class, so an unseen word counts as one more word that
never occurred.  A frequent word is its class and adds nothing.  The network's
contexts are those of classes, at most ``CLASSES ** 3`` at any size.

Token classes come from the word counts of the whole corpus: the ``FREQUENT``
most frequent words are classes of their own, other words share
``SUFFIX_CLASSES`` classes by their last three bytes, and one class stands for
the ends of a text.  With a window of one token to either side the counts of
(left, token, right) over *all* documents are everything the network's training
objective depends on; they are counted in dense arrays inside the tasks and
added up by Spark, at most ``CLASSES ** 3`` rows whatever the corpus.  The
network is trained on them in numpy: full-batch Adam over every counted
context, so no text is left out of training and the order of rows is
irrelevant.

Defined results: null and empty texts have no tokens and score 0 with a null
mean; repeated rows score alike and count as often as they occur; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilo.llm.words import Words, mix, sub_batches

FREQUENT = 96
SUFFIX_CLASSES = 31
EDGE = FREQUENT + SUFFIX_CLASSES      # the ends of a text
CLASSES = EDGE + 1
HIDDEN = 24
STEPS = 150
UNIT = 1 << 32        # log P(token | class) is kept in whole units, so sums do not depend on their order


# --------------------------------------------------------------------------- counts
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        key, n = np.unique(Words(batch.column("text")).hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])


def frequent_words(texts: DataFrame, many: int = FREQUENT) -> np.ndarray:
    """Hashes of the most frequent words of the corpus, sorted (ties: smaller hash)."""
    top = (texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(many).collect())
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def classes(words: Words, frequent: np.ndarray) -> np.ndarray:
    """Token class of every word."""
    h = words.hashes()
    at = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
    known = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
    suffix = np.zeros(len(h), np.uint64)
    for k in (3, 2, 1):
        place = words.ends - k
        suffix = suffix << np.uint64(8) | np.where(place >= words.starts, words.data[np.maximum(place, 0)], 0).astype(np.uint64)
    return np.where(known, at, FREQUENT + (mix(suffix + np.uint64(1)) % np.uint64(SUFFIX_CLASSES)).astype(np.int64))


def contexts(words: Words, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left class, class and right class of every token."""
    c = classes(words, frequent)
    left, right = np.full(len(c), EDGE), np.full(len(c), EDGE)
    left[1:], right[:-1] = c[:-1], c[1:]
    filled = words.counts > 0
    left[words.ptr[:-1][filled]] = EDGE
    right[words.ptr[1:][filled] - 1] = EDGE
    return left, c, right


def context_counts(texts: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Counts (left, right, token) over all documents."""
    size = CLASSES ** 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in sub_batches(batches):
            left, c, right = contexts(Words(batch.column("text")), frequent)
            total += np.bincount((left * CLASSES + right) * CLASSES + c, minlength=size)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 1 << 16):
            part = some[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["context", "n"])

    # At most CLASSES ** 3 rows of 12 bytes reach the driver, as Arrow columns.
    table = (texts.mapInArrow(run, "context int, n long").groupBy("context").agg(F.sum("n").alias("n"))).toArrow()
    out = np.zeros(size, np.float32)
    out[table.column("context").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES, CLASSES)


# ----------------------------------------------------------------------- vocabulary
def _class_words(frequent: np.ndarray, by_text: bool):
    """Words outside the frequent ones with class and count, by batch or by text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            words = Words(batch.column("text"))
            c = classes(words, frequent)
            rare = np.flatnonzero(c >= FREQUENT)
            h, c = words.hashes()[rare], c[rare]
            doc = words.doc[rare] if by_text else np.zeros(len(rare), np.int64)
            order = np.lexsort((h, doc))
            h, c, doc = h[order], c[order], doc[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(h)))
            columns = {"word": pa.array(h[first].view(np.int64)), "class": pa.array(c[first].astype(np.int32)),
                       "n": pa.array(n.astype(np.int64))}
            if by_text:
                columns["text_key"] = batch.column("text_key").take(pa.array(doc[first]))
            for a in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_pydict({k: x[a:a + (1 << 16)] for k, x in columns.items()})
    return run


def vocabulary(texts: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Counts ``word, class, n`` of all words that share a class, and ``class, size`` of these classes."""
    counts = (texts.select("text").mapInArrow(_class_words(frequent, False), "word long, class int, n long")
              .groupBy("word", "class").agg(F.sum("n").alias("n")).checkpoint())
    return counts, counts.groupBy("class").agg((F.sum("n") + F.count("*") + 1).alias("size"))


def token_scores(rows: DataFrame, known: tuple[DataFrame, DataFrame], frequent: np.ndarray) -> DataFrame:
    """``text_key, within``: mean of log P(token | class) over a text's words outside the frequent ones."""
    counts, sizes = known
    asked = rows.select("text", "text_key").mapInArrow(_class_words(frequent, True),
                                                       "word long, class int, n long, text_key long")
    # At most SUFFIX_CLASSES rows; a class without any word has the unseen word only.
    each = (asked.join(counts.select("word", F.col("n").alias("seen")), "word", "left")
            .join(F.broadcast(sizes), "class", "left"))
    log = F.round(F.log((F.coalesce("seen", F.lit(0)) + 1) / F.coalesce("size", F.lit(1))) * UNIT).cast("long")
    # Copies of a text add the same again to both sums.
    return each.groupBy("text_key").agg((F.sum(F.col("n") * log) / F.sum("n") / UNIT).alias("within"))


# -------------------------------------------------------------------------- network
def log_probabilities(w: dict[str, np.ndarray]) -> np.ndarray:
    """Log-probability of every class given its two neighbours (left, right, class)."""
    out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
    for i in range(CLASSES):
        z = np.tanh(w["left"][i] + w["right"] + w["b"]) @ w["out"] + w["c"]
        z -= z.max(axis=1, keepdims=True)
        out[i] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def train(counts: np.ndarray, steps: int = STEPS, seed: int = 5) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights after full-batch Adam on the counted contexts, and the mean loss per step."""
    rng = np.random.default_rng(seed)
    n = max(float(counts.sum()), 1.0)
    unigram = counts.sum(axis=(0, 1))
    w = {"left": rng.normal(0, 0.1, (CLASSES, HIDDEN)), "right": rng.normal(0, 0.1, (CLASSES, HIDDEN)),
         "b": np.zeros(HIDDEN), "out": rng.normal(0, 0.1, (HIDDEN, CLASSES)),
         "c": np.log((unigram + 1) / (n + CLASSES))}
    w = {k: x.astype(np.float32) for k, x in w.items()}
    m = {k: np.zeros_like(x) for k, x in w.items()}
    s = {k: np.zeros_like(x) for k, x in w.items()}
    total = counts.sum(axis=2) / n
    losses = []
    block = 16
    for step in range(1, steps + 1):
        g = {k: np.zeros_like(x) for k, x in w.items()}
        loss = 0.0
        for a in range(0, CLASSES, block):
            target = counts[a:a + block].reshape(-1, CLASSES) / np.float32(n)
            weight = total[a:a + block].reshape(-1)
            h = np.tanh(w["left"][a:a + block, None] + w["right"][None] + w["b"]).reshape(-1, HIDDEN)
            z = h @ w["out"] + w["c"]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            norm = p.sum(axis=1, keepdims=True)
            loss -= float((target * (z - np.log(norm))).sum(dtype=np.float64))
            gz = p * (weight[:, None] / norm) - target
            g["out"] += h.T @ gz
            g["c"] += gz.sum(axis=0)
            gh = ((gz @ w["out"].T) * (1 - h * h)).reshape(-1, CLASSES, HIDDEN)
            g["left"][a:a + block] += gh.sum(axis=1)
            g["right"] += gh.sum(axis=0)
            g["b"] += gh.sum(axis=(0, 1))
        losses.append(loss)
        rate = 0.05 * (1 - step / (steps + 1))
        for k, x in g.items():
            m[k] += 0.1 * (x - m[k])
            s[k] += 0.01 * (x * x - s[k])
            w[k] -= (rate * m[k] / (1 - 0.9 ** step) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-9)).astype(np.float32)
    return w, losses


def fit(texts: DataFrame) -> dict:
    """Model of all texts (a ``text`` column): frequent words and log-probability table (8 MB, fixed)."""
    frequent = frequent_words(texts)
    weights, losses = train(context_counts(texts, frequent))
    return {"frequent": frequent, "table": log_probabilities(weights), "weights": weights, "losses": losses}


def score_batch(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed log-probability of every document."""
    words = Words(column)
    left, c, right = contexts(words, model["frequent"])
    out = np.zeros(words.n_docs)
    filled = words.counts > 0
    if filled.any():      # summed per document, so a score does not depend on the batch
        each = model["table"].ravel()[(left * CLASSES + right) * CLASSES + c].astype(np.float64)
        out[filled] = np.add.reduceat(each, words.ptr[:-1][filled])
    return words.counts, out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None,
          known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood``.

    ``known`` is the ``vocabulary`` of the corpus that ``model`` was fitted to; a
    model given without one scores the classes only.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    if model is None:
        model = fit(rows.select("text"))
        known = vocabulary(rows, model["frequent"])
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("frequent", "table")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            column = batch.column("text")
            n, s = score_batch(shared.value, column)
            words = Words(column)
            total = np.concatenate(([0], np.cumsum(classes(words, shared.value["frequent"]) >= FREQUENT)))
            rare = total[words.ptr[1:]] - total[words.ptr[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n.astype(np.int64)),
                                              pa.array(rare.astype(np.int64)), pa.array(s)],
                                             ["doc_id", "text_key", "n_tokens", "rare", "log_likelihood"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, text_key long, n_tokens long, rare long, log_likelihood double")
    if known:
        out = out.join(token_scores(rows, known, model["frequent"]), "text_key", "left").withColumn(
            "log_likelihood", F.col("log_likelihood") + F.coalesce(F.col("rare") * F.col("within"), F.lit(0.0)))
    out = out.select("doc_id", "n_tokens", "log_likelihood")
    return out.withColumn("mean_log_likelihood",
                          F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
