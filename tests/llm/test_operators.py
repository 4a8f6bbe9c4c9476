"""Operators on Spark against brute force, and their defined results on awkward tables."""

import hashlib
import itertools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilo.llm import cascade, debruijn, masked_lm, omh, packing, perspectives, topk, toxicity, viterbi, warc
from vigilo.llm.words import Words

SF = os.environ.get("VIGILO_TEST_SF", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (4, "a b c"), (5, "word " * 900), (6, "word " * 900),
        (6, "word " * 900), (7, LONG), (8, "é 日本 \N{SLIGHTLY SMILING FACE}"), (9, LONG + " tail"),
        (10, "one\ntwo\none\n\none")]
CLASH = ("text_key", "id", "ids", "n", "n_words", "n_removed", "spans", "sequence_id", "offset", "length", "start", "score",
         "_class", "_h1", "_z", "_text_key", "kept", "c0", "doc_tokens", "class_id", "label")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


def words(text):
    return (text or "").encode().split()


# ------------------------------------------------------------------------- packing
def check_packing(rows, expected, crc):
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    assert sorted(sequences) == list(range(len(sequences)))
    for doc_id, parts in docs.items():
        ids = expected[doc_id]
        starts = sorted((p.start, p.length, p.ids_crc32) for p in parts)
        many = Counter(starts)
        at = 0
        for (start, length, found), n in sorted(many.items()):
            assert start == at and found == crc(ids[start:start + length])
            at += length
        assert at == len(ids) and all(p.doc_tokens == len(ids) for p in parts)
    return sequences


def token_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_packing_of_documents(documents, texts):
    encode = token_ids(None)
    rows = packing.packed_digest(documents).collect()
    expected = {i: encode(t) for i, t in texts.items()}
    sequences = check_packing(rows, expected, lambda x: zlib.crc32(x.tobytes()))
    total = sum(map(len, expected.values()))
    assert sum(r.length for r in rows) == total
    assert len(sequences) <= -(-total // packing.CAPACITY) + 2


def test_packing_of_odd_rows(spark, odd):
    encode = token_ids(None)
    rows = packing.packed_digest(odd).collect()
    check_packing(rows, {i: encode(t) for i, t in ROWS}, lambda x: zlib.crc32(x.tobytes()))
    assert Counter(r.doc_id for r in rows)[1] == 1
    assert packing.packed_digest(odd.limit(0)).count() == 0
    full = packing.pack_documents(odd).where("doc_id = 8").collect()
    assert full[0].ids == bytes(encode("é 日本 \N{SLIGHTLY SMILING FACE}").tobytes())


def test_token_ids_are_those_of_the_tokenizer():
    from vigilo.llm import tokens
    encode = token_ids(None)
    fast = tokens.encoder(tokens.default_path())
    for t in ("", "a<|endoftext|>b", "  \n\n\t x", "é日本" * 40, "a" * 2000, " " * 2000, "don't 123 !!"):
        assert [*fast(t), 1] == encode(t).tolist()


# ----------------------------------------------------------------- near-duplicates
def shingle_pairs(texts, least):
    sets, where = {}, {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    common = Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1:])
    return [(a, b) for (a, b), c in common.items() if c / len(sets[a] | sets[b]) >= least]


def test_near_duplicates_of_documents(documents, texts):
    rows = omh.near_duplicates(documents).collect()
    cls = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(texts)
    pairs = shingle_pairs(texts, 0.8)
    assert pairs and all(cls[a] == cls[b] for a, b in pairs)
    members = {}
    for i, c in cls.items():
        members.setdefault(c, []).append(i)
    for c, ids in members.items():
        assert c == min(ids)
        for i in ids:      # everyone has a verified relative in the class
            parts = [np.array([hash(x) for x in words(texts[k])], np.int64) for k in (i, *(x for x in ids if x != i))]
            assert len(ids) == 1 or any(texts[i] == texts[k] or omh.similar(parts[0], p)
                                        for k, p in zip((x for x in ids if x != i), parts[1:]))


def test_near_duplicates_do_not_depend_on_partitions(documents):
    one = {(r.doc_id, r.class_id) for r in omh.near_duplicates(documents.repartition(1)).collect()}
    many = {(r.doc_id, r.class_id) for r in omh.near_duplicates(documents.repartition(13)).collect()}
    assert one == many


def test_a_chain_of_copies_is_one_class(spark):
    base = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(12):     # each differs a little more from the first
        base = [f"n{k}x{i}" if k and k * 8 <= i < k * 8 + 6 else w for i, w in enumerate(base)]
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join(f"u{k}y{i}" for i in range(200)) + " shared line of some seven words here") for k in range(40)]
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(12)} == {0}
    assert all(got[100 + k] == 100 + k for k in range(40))


def family(variants, start=0):
    """An original of 95 words and variants with three passages of their own: like the original, unlike each other."""
    base = [f"o{start}x{i}" for i in range(95)]
    rows = [(start + 5, " ".join(base))]
    for k, slots in enumerate(itertools.islice(itertools.combinations(range(19), 3), variants)):
        rows.append((start + 10 + k, " ".join(f"p{start}x{k}y{i}" if i // 5 in slots else w for i, w in enumerate(base))))
    return rows


def sketched(rows):
    column = Words(pa.array([t for _, t in rows]))
    h = column.hashes()
    return omh.sketches(column), [h[column.ptr[i]:column.ptr[i + 1]] for i in range(len(rows))]


def test_variants_like_their_original_only_are_one_class(spark):
    rows = family(960)
    value, parts = sketched(rows)
    assert all(omh.similar(parts[0], p) for p in parts[1:])
    assert not any(omh.similar(parts[i], p) for i in (1, 500) for j, p in enumerate(parts) if j not in (0, i))
    got = omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    met = {rows[i][0] for i in np.flatnonzero((value == value[0]).any(axis=1))}
    assert len(met) > 900
    assert met <= {r.doc_id for r in got.collect() if r.class_id == 5}


def test_pairs_without_a_pivot_are_settled(spark, monkeypatch):
    rows = family(60) + family(30, 1000) + [(2000 + k, " ".join(f"u{k}y{i}" for i in range(95))) for k in range(20)]
    value, parts = sketched(rows)
    expected = {i: i for i, _ in rows}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (value[i] == value[j]).any() and omh.similar(parts[i], parts[j]):
            x, y = sorted((expected[rows[i][0]], expected[rows[j][0]]))
            expected = {k: x if c == y else c for k, c in expected.items()}
    monkeypatch.setattr(omh, "links", lambda *a: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(omh, "BLOCK_MEMBERS", 16)
    got = omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == expected


def test_sketches_find_pairs_at_the_stated_similarity():
    rng = np.random.default_rng(2)
    for share, least in ((0.05, 0.99), (0.1, 0.88), (0.15, 0.55), (0.2, 0.3)):
        rows = []
        for k in range(150):
            text = [f"w{x}" for x in rng.integers(0, 5000, 300)]
            other = list(text)
            for i in rng.choice(300, int(share * 300), replace=False):
                other[i] = f"z{k}x{i}"
            rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
        value, parts = sketched(rows)
        assert all(omh.similar(a, b) for a, b in zip(parts[::2], parts[1::2]))
        assert (value[::2] == value[1::2]).any(axis=1).mean() >= least


def test_the_table_of_wanted_texts_loses_none(spark, monkeypatch):
    texts = spark.range(3000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("text_key"), F.col("id").cast("string").alias("text"))
    wanted = texts.where("cast(text as int) % 10 = 3").select("text_key")
    left = {r.text for r in omh._present(texts, wanted).collect()}
    assert {str(i) for i in range(3, 3000, 10)} <= left and len(left) < 500
    assert omh._present(texts, wanted.limit(0)).count() == 0
    monkeypatch.setattr(omh, "FILTER_BITS", 8)
    assert omh._present(texts, wanted).count() == 3000


def test_near_duplicates_of_odd_rows(odd):
    rows = omh.near_duplicates(odd).collect()
    cls = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(ROWS)
    assert cls[1] == cls[2] == cls[3] == 1 and cls[4] == 4 and cls[6] == cls[5] == 5 and cls[9] == cls[7] == 7
    assert omh.near_duplicates(odd.limit(0)).count() == 0


def test_one_row_of_each_class_stays(odd):
    kept = omh.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 4, 5, 7, 8, 10]
    assert omh.keep_one(odd.limit(0)).count() == 0


# --------------------------------------------------------------- repeated passages
def strip(texts):
    many = Counter(tuple(w[i:i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for w in texts:
        covered = [False] * len(w)
        for i in range(len(w) - 34):
            if many[tuple(w[i:i + 35])] > 1:
                covered[i:i + 35] = [True] * 35
        out.append((len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c)))
    return out


def test_repeated_passages_of_documents(documents, texts):
    rows = debruijn.remove_repeats(documents.select("doc_id", "text")).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.text.encode()) for r in rows}
    assert len(rows) == len(texts)
    assert got == dict(zip(texts, strip([words(t) for t in texts.values()])))
    for r in rows:
        assert sum(s.words for s in r.spans) == r.n_removed and all(s.words >= 35 for s in r.spans)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_of_braided_texts(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}w{i % (7 if k == 0 else 1000)}" for i in range(rng.integers(20, 90))] for k in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.integers(1, 5)):
            p = passages[rng.integers(6)]
            a = rng.integers(0, 12)
            w += p[a:a + rng.integers(10, 90)] + [f"d{d}f{rng.integers(100)}" for _ in range(rng.integers(0, 20))]
        rows.append((d, "  ".join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1].replace("  ", "\n"))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text.encode())
           for r in debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(zip((r[0] for r in rows), strip([words(r[1]) for r in rows])))


def test_repeated_passages_of_odd_rows(odd):
    out = debruijn.remove_repeats(odd)
    assert out.columns == [*odd.columns, "repeat_n_words", "repeat_n_removed", "repeat_spans"]
    got = sorted(((r.doc_id or 0), r.repeat_n_words, r.repeat_n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    expected = sorted(((i or 0), n, k, hashlib.sha256(t).hexdigest())
                      for (i, _), (n, k, t) in zip(ROWS, strip([words(t) for _, t in ROWS])))
    assert got == expected
    assert debruijn.remove_repeats(odd.limit(0)).count() == 0


# ------------------------------------------------------------------------- cascade
def test_cascade_verdict_does_not_depend_on_the_order(documents):
    names = sorted(cascade.RULES)
    one = {r.doc_id: r.kept for r in cascade.quality_cascade(documents, order=names).collect()}
    two = {r.doc_id: r.kept for r in cascade.quality_cascade(documents, order=names[::-1]).collect()}
    assert one == two and 0 < sum(one.values()) < len(one)
    assert {r.doc_id for r in cascade.filter_quality(documents).collect()} == {i for i, k in one.items() if k}


def test_rules_by_rejection_per_cost(documents):
    import time

    def costly(b):
        time.sleep(0.05)
        return np.zeros(b.words.n_docs, bool)
    rules = {"costly": costly, "all": lambda b: np.ones(b.words.n_docs, bool)}
    assert cascade.rule_order(documents, rules) == ["all", "costly"]


def test_cascade_of_odd_rows(odd):
    rows = {(r.doc_id, r.n_words): r for r in cascade.quality_cascade(odd).collect()}
    assert rows[1, 0].base_failed and not rows[1, 0].kept and rows[1, 0].word_chars == 0
    assert rows[10, 4].n_dup_lines == 2 and rows[5, 900].n_repeat_words == 900
    assert rows[7, 30000].kept and rows[9, 30001].kept
    assert cascade.quality_cascade(odd.limit(0)).count() == 0
    assert cascade.filter_quality(odd).columns == odd.columns


# ------------------------------------------------------------------ pseudo-likelihood
def test_pseudo_likelihood_prefers_real_text(documents, texts):
    import random
    import pyarrow as pa
    model = masked_lm.fit(documents.select("text"))
    counts = masked_lm.context_counts(documents.select("text"), model["frequent"])
    assert counts.sum() == sum(len(words(t)) for t in texts.values())
    share = counts.sum(axis=(0, 1)) / counts.sum()
    assert model["losses"][-1] < -(share[share > 0] * np.log(share[share > 0])).sum() - 0.1
    assert np.allclose(np.exp(model["table"]).sum(axis=2), 1, atol=1e-3)
    real, mixed = [t for t in texts.values() if len(words(t)) > 20], []
    rng = random.Random(0)
    for t in real:
        w = t.split()
        rng.shuffle(w)
        mixed.append(" ".join(w))
    _, a = masked_lm.score_batch(model, pa.array(real))
    _, b = masked_lm.score_batch(model, pa.array(mixed))
    assert (a > b).mean() > 0.85


def test_pseudo_likelihood_is_the_sum_over_tokens(documents, odd):
    model = masked_lm.fit(documents.select("text"))
    frequent = model["frequent"]
    rows = {(r.doc_id, r.n_tokens): r for r in masked_lm.score(odd, model=model).collect()}
    import pyarrow as pa
    from vigilo.llm.words import Words
    for doc_id, text in ROWS:
        c = masked_lm.classes(Words(pa.array([text or ""])), frequent)
        padded = [masked_lm.EDGE, *c, masked_lm.EDGE]
        expected = sum(float(model["table"][padded[i], padded[i + 2], padded[i + 1]]) for i in range(len(c)))
        r = rows[doc_id, len(c)]
        assert r.log_likelihood == pytest.approx(expected, rel=1e-6)
        assert (r.mean_log_likelihood is None) == (len(c) == 0)
    assert masked_lm.score(odd.limit(0)).count() == 0


def test_unseen_words_lower_the_score(spark):
    common = [(i, "the cat sat on the mat and the dog ran to the house " * 3 + f"rare{i}ing other{i % 5}ing") for i in range(40)]
    fillers = [(100 + i, f"filler{i} filler{i} filler{i}") for i in range(120)]
    docs = spark.createDataFrame(common + fillers, "doc_id long, text string")
    model = masked_lm.fit(docs)
    known = masked_lm.vocabulary(docs, model["frequent"])
    assert known[0].count() > masked_lm.SUFFIX_CLASSES
    turned = docs.withColumn("text", F.regexp_replace("text", "(rare|other)(\\d+)ing", "zq$2xing"))
    a = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs, model=model, known=known).collect()}
    b = {r.doc_id: r.log_likelihood for r in masked_lm.score(turned, model=model, known=known).collect()}
    assert all(b[i] < a[i] for i in range(40))
    own = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs.unionByName(docs.limit(0))).collect()}
    assert own == pytest.approx(a, rel=1e-6)
    words_of = {r["word"]: r for r in known[0].collect()}
    size = {r["class"]: r["size"] for r in known[1].collect()}
    for i, text in (common[3], fillers[7]):
        h = Words(pa.array([text])).hashes().view(np.int64).tolist()
        _, s = masked_lm.score_batch(model, pa.array([text]))
        inner = sum(np.log((words_of[x]["n"] + 1) / size[words_of[x]["class"]]) for x in h if x in words_of)
        assert a[i] == pytest.approx(s[0] + inner, rel=1e-6)


# -------------------------------------------------------------------- sentencepiece
def test_ids_against_the_library(documents, texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    path = viterbi.default_path()
    rows = viterbi.decode(viterbi.encode(documents)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    # The library's best-path mode loses precision at scores of -1e9 (runs of spaces): raise them in both.
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    best = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    table = viterbi.Pieces.load(path)
    table.scores, table.unknown = np.maximum(table.scores, -40000.0), -40010.0
    worker = viterbi.Encoder(table)
    for r in rows:
        assert r.decoded == texts[r.doc_id]
        assert np.frombuffer(r.merged_ids, "<u4").tolist() == library.encode(texts[r.doc_id])
        if "  " not in texts[r.doc_id]:
            ids = np.frombuffer(worker.texts([texts[r.doc_id]])[0][0], "<u4").tolist()
            assert ids == best.encode(texts[r.doc_id]) and r.ids == np.array(ids, "<u4").tobytes()


def test_sentencepiece_of_odd_rows(odd):
    rows = viterbi.decode(viterbi.encode(odd)).collect()
    assert len(rows) == len(ROWS)
    assert Counter(((r.doc_id or 0), r.decoded) for r in rows) == Counter(((i or 0), t or "") for i, t in ROWS)
    assert all(r.ids == r.merged_ids == b"" for r in rows if not r.text)
    assert viterbi.encode(odd.limit(0)).count() == 0


# ------------------------------------------------------------------------- toxicity
def test_held_out_toxicity(spark):
    # Enough labels to learn from: the largest of the small tables.
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
               for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8
    assert hit / sum(r.predicted for r in rows) > 0.75


def test_toxicity_learns_nothing_from_held_out_rows_and_other_columns(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string"))
    a = {r.doc_id: r.score for r in toxicity.score(documents, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(other, turned).collect()}
    assert a == b


def test_without_a_model_all_rows_stay(spark, odd):
    labels = spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        assert toxicity.filter_toxic(odd, known).count() == len(ROWS)


def test_training_rows_are_chosen_among_short_texts(spark):
    docs = spark.createDataFrame([(k, "long " * 9 if k < 20 else f"short {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(21, 0), (20, None)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(docs, labels, F.lit(True), max_toxic=10, max_clean=10, max_text=20)
    assert len(texts) == 20 and sum(y) == 10 and all(t.startswith("short") for t in texts)
    assert dict(zip(texts, y))["short 21"] == 1          # both labels: the larger


def test_toxicity_is_learned_in_a_task_from_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    want = toxicity.labelled_sample(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    monkeypatch.setattr(toxicity, "train", lambda texts, y, prior: {"process": os.getpid(), "rows": (texts, y)})
    got = toxicity.fit(docs, labels)
    assert got["process"] != os.getpid() and got["rows"] == want


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (4, None), (5, 1), (7, 0), (8, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert all(r.score == 0.5 for r in toxicity.score(odd, labels.limit(0)).collect())
    assert toxicity.score(odd.limit(0), labels).count() == 0
    assert toxicity.filter_toxic(odd, labels).columns == odd.columns


# ---------------------------------------------------------------------------- top-k
def brute_top(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault((i, tuple(int(np.floor(256 * float(x))) for x in v)), None)
    out = []
    for q, qv in vectors:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vectors if i != q and len(v) == len(qv))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", ["normal", "skewed", "equal"])
def test_top_k_is_exact(spark, spread):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 6)).astype(np.float32)
    if spread == "skewed":
        v *= rng.pareto(1.0, (700, 1)).astype(np.float32) + 0.01
    if spread == "equal":
        v[: 300] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(700, None), (750, [None] * 6), (800, [float("nan")] * 6), (850, [float("inf")] * 6), (900, [0.5] * 6),
             (900, [0.5] * 6), (None, [1.0] * 6), (950, [0.25, 0.5]), (951, [0.5, 0.5]), (1000, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("norm", F.lit(1))
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows)


def test_top_k_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(empty, F.col("vec_id") % 50 == 0).count() == 0


# --------------------------------------------------------------------- perspectives
def test_perspectives_of_odd_conversations(spark):
    rows = [(1, 0, "system", "rules"), (1, 2, "bob", None), (1, 1, "ann", "hi <|im_end|>"), (1, None, "eve x", "first"),
            (1, 2, "bob", None), (1, 70, None, "who"), (2, 0, "system", "alone"), (None, 0, "ann", "lost"),
            (3, 500, "ann", "late"), (3, -3, "bob", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit("?"))
    out = perspectives.rotate(df).collect()
    assert Counter((r.conv_id, r.perspective) for r in out) == {(1, "bob"): 6, (1, "ann"): 6, (1, "eve x"): 6,
                                                               (None, "ann"): 1, (3, "ann"): 2, (3, "bob"): 2}
    for key in {(r.conv_id, r.perspective) for r in out}:
        parts = sorted((r for r in out if (r.conv_id, r.perspective) == key), key=lambda r: r.position)
        assert [p.position for p in parts] == list(range(len(parts)))
        whole = "".join(p.segment for p in parts)
        for p in parts:
            assert whole[p.char_start:p.char_end] == p.segment and p.trained == (p.role == key[1])
            if p.trained:
                assert p.segment.startswith("<|im_start|>assistant\n")
                assert whole[p.mask_start:p.mask_end].endswith("<|im_end|>")
    ann = [r for r in out if r.conv_id == 1 and r.perspective == "ann"]
    assert "<|im_start|>user name=eve_x\nfirst" in ann[[r.position for r in ann].index(0)].segment
    assert any("hi <| im_end|><|im_end|>" in r.segment for r in ann)
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_a_long_conversation_spans_many_blocks(spark):
    df = spark.range(1000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = sorted((r for r in perspectives.rotate(df).collect() if r.perspective == "user"), key=lambda r: r.position)
    assert [r.turn for r in out] == list(range(1000))
    assert all(a.char_end == b.char_start for a, b in zip(out, out[1:])) and out[0].char_start == 0


# ----------------------------------------------------------------------------- WARC
def test_warc_records_of_odd_pages(spark, tmp_path):
    pages = [(1, "http://a", "<p>x &amp; y</p>"), (2, None, None), (3, "http://c", ""), (1, "http://a", "<p>x &amp; y</p>"),
             (None, "http://d", "<a href='http://e'>é</a><script>hidden</script>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("?"))
    source = warc.responses(df).collect()
    out = warc.derive(warc.responses(df)).collect()
    assert Counter(r.record_type for r in out) == {"metadata": 5, "conversion": 5}
    assert {r.refers_to for r in out} == {r.record_id for r in source}
    for r in out:
        assert r.content_length == len(r.block.encode())
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.warc_header
    by = {(r.source_id, r.record_type): r for r in out}
    assert by[1, "conversion"].block == "x & y" and by[2, "conversion"].block == ""
    assert "outlink: http://e\r\n" in by[None, "metadata"].block and by[None, "conversion"].block == "é"
    assert by[1, "conversion"].record_id in by[1, "metadata"].block
    assert warc.derive(warc.responses(df.limit(0))).count() == 0
    warc.write_records(warc.derive(warc.responses(df)), str(tmp_path / "out"))
    import glob
    import gzip
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/out/*.gz"))
    found = 0
    while data:      # read back by Content-Length, as a WARC reader does
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:n + 4] == b"\r\n\r\n"
        data, found = rest[n + 4:], found + 1
    assert found == 10
