"""Fingerprints, divergence audit and vector codes against brute force, and their defined results."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo.llm import digest, pq, transducer

CLASH = ("id", "tie", "slot", "guest", "range", "seat", "n", "term", "ordinal", "value", "rank", "item", "part", "dim", "code",
         "distance", "error", "vector", "label_error", "total", "width", "block")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60000))
TEXTS = [(1, None), (2, ""), (3, "short"), (4, "short"), (None, "no id"), (None, "no id, another"), (5, LONG), (6, "é 日本 ünï ß" * 40),
         (6, "é 日本 ünï ß" * 40), (6, "another text of six " * 9), (7, "\n \t"), (8, LONG + "."), (2 ** 62, "large id " * 30),
         (2 ** 62 + 1, "larger id " * 30), (-5, "negative id " * 30)]


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


# ----------------------------------------------------------------- fingerprints
def plain_digest(text):
    b = text.encode()
    counts = [0] * 256
    for i in range(len(b) - 7):
        counts[(b[i] + 256 * b[i + 4] + 65536 * b[i + 7]) * 2654435761 % 2 ** 32 >> 24] += 1
    ordered = sorted(counts)
    q = [(c > ordered[63]) + (c > ordered[127]) + (c > ordered[191]) for c in counts]
    m = len(b) + 1
    e = m.bit_length() - 1
    code = 8 * e + (m * 8 >> e) - 8
    return f"{code:03x}" + "".join(f"{4 * q[i] + q[i + 1]:x}" for i in range(0, 256, 2)), q, code


def plain_near(a, b):
    d = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[1], b[1])) + 28 * min(abs(a[2] - b[2]), 16)
    return 1 - d / 1984


def plain_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows),
                  key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        a, b, c = plain_digest(text), plain_digest(edited), plain_digest(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a[0], b[0], plain_near(a, b), plain_near(a, c)))
    return Counter(out)


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:1], [(9, "same")] * 7, [(k % 3, f"text {k} " * (k % 11)) for k in range(90)],
                                  [(None, f"text {k}") for k in range(40)]])
def test_neighbour_edits_match_brute_force(spark, rows):
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r) for r in digest.neighbour_edits(df).collect())
    assert got == plain_edits(rows)


def test_no_rows_no_neighbours(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert digest.neighbour_edits(df).collect() == [] and digest.fingerprints(df).collect() == []


def test_chunks_do_not_change_counts(monkeypatch):
    texts = [b"", b"abc", b"0123456789" * 50, b"x" * 8, b"", bytes(range(1, 200))]
    whole = digest.bucket_counts(texts)
    monkeypatch.setattr(digest, "CHUNK", 17)
    assert (digest.bucket_counts(texts) == whole).all()
    assert whole.sum(axis=1).tolist() == [max(len(t) - 7, 0) for t in texts]


def test_likeness_of_columns_equals_numpy(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randrange(400))) for _ in range(60)]
    prints = digest.to_text(*digest.digests([t.encode() for t in texts]))
    pairs = [(prints[i], prints[-1 - i]) for i in range(60)] + [(prints[0], prints[0]), (prints[0], None)]
    got = [r.likeness for r in digest.compare(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()]
    want = digest.likeness(*(digest.from_text([p[k] for p in pairs[:-1]]) for k in (0, 1)))
    assert got[:-1] == want.tolist() and got[-1] is None and got[-2] == 1.0
    assert digest.to_text(*digest.from_text(prints)) == prints


def test_edits_stand_nearer_than_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text") >= 500)
    rows = digest.neighbour_edits(docs).collect()
    edits, others = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    assert (edits[:, None] > others[None, :]).mean() >= 0.99


# ----------------------------------------------------------------- divergence
def plain_audit(rows, min_docs, top):
    docs = [(la or "", s or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in
                                 re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for la, s, t in rows]
    df, counts, out = defaultdict(Counter), defaultdict(Counter), set()
    for la, s, words in docs:
        df[la].update(set(words))
        counts[la, s].update(words)
    for la in {d[0] for d in docs}:
        kept = sorted(t for t, n in df[la].items() if n >= min_docs)
        sources = sorted(s for x, s in counts if x == la)

        def weight(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // total for t in kept}

        p = {s: weight(counts[la, s]) for s in sources}
        q = weight(sum((counts[la, s] for s in sources), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[la, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out.update((la, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top)
    return out


AUDIT = [("en", f"s{k % 4}", " ".join(f"Word{(k * j) % 13}" if j % 3 else "ÉTÉ été Zebra" for j in range(k % 9))) for k in range(80)]
AUDIT += [("de", None, "ein Wort"), ("de", "s1", None), (None, None, ""), ("fr", "only", "seul " * 20)] + [("xx", f"q{k}", "--- 123") for k in range(3)]
AUDIT += [("en", "s1", "zebra " * 5000), ("日本", "s", "語 漢字"), ("日本", "s", "語 漢字"), ("日本", "t", "語 Ａ")]


@pytest.mark.parametrize("options", [{}, {"shard": 3, "pass_bytes": 1, "cells": 8}, {"min_docs": 1}, {"min_docs": 1, "shard": 2, "cells": 1}])
def test_audit_matches_brute_force(spark, options):
    df = clash(spark.createDataFrame([(k, *r) for k, r in enumerate(AUDIT)], "doc_id long, lang string, source string, text string"))
    got = [tuple(r) for r in transducer.audit(df, top=4, **options).collect()]
    want = plain_audit(AUDIT, options.get("min_docs", 10), 4)
    assert len(got) == len(want) and set(got) == want


def test_audit_of_nothing(spark):
    assert transducer.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_transducer_is_minimal_and_numbers_terms():
    rng = random.Random(11)
    terms = sorted({"".join(rng.choice("abcé日z") for _ in range(rng.randrange(1, 7))).encode() for _ in range(3000)})
    automaton = transducer.Transducer.load(transducer.Transducer.build(terms).dump())
    assert list(automaton.terms()) == terms
    asked = terms + [t + b"q" for t in terms[:50]] + [t[:-1] for t in terms[:200]] + [b"", "ÿ".encode()]
    data, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([len(t) for t in asked])
    hit, number = automaton.ordinals(data, ends - [len(t) for t in asked], ends)
    place = {t: k for k, t in enumerate(terms)}
    assert dict(zip(hit.tolist(), number.tolist())) == {k: place[t] for k, t in enumerate(asked) if t in place}
    # Minimal: as many states as distinct sets of suffixes.
    suffixes = defaultdict(set)
    for t in terms:
        for k in range(len(t) + 1):
            suffixes[t[:k]].add(t[k:])
    assert len(automaton.final) == len({frozenset(s) for s in suffixes.values()})


def test_wide_alphabets_use_several_words():
    terms = sorted(bytes([a, b]) for a in range(128, 250) for b in range(128, 250, 3))
    automaton = transducer.Transducer.build(terms)
    assert automaton.words == 2 and list(automaton.terms()) == terms


def test_weights_are_exact():
    rng = np.random.default_rng(1)
    total = 9 * 10 ** 15
    counts = rng.integers(0, total - 2, 200)
    assert transducer.weights(counts, np.int64(total)).tolist() == [1 + 10 ** 9 * (c + 2) // total for c in counts.tolist()]


# ----------------------------------------------------------------- vector codes
def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * x)) for x in v], la) for i, v, la in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [p * dim // parts for p in range(parts + 1)]
        books = [[v[cut[p]:cut[p + 1]] for _, v, _ in own[:entries]] for p in range(parts)]

        def assign():
            return [[min((sum((a - b) ** 2 for a, b in zip(v[cut[p]:cut[p + 1]], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
                    for _, v, _ in own]

        for _ in range(rounds):
            got = assign()
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [v[cut[p]:cut[p + 1]] for (_, v, _), g in zip(own, got) if g[p][1] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        out += [(i, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), la, sha) for (i, _, la), g in zip(own, assign())]
    errors = Counter()
    for r in out:
        errors[r[3]] += r[2]
    return Counter((i, code, error, errors[la], sha) for i, code, error, la, sha in out)


def digested(codes, books):
    return Counter((r.id, r.code.hex(), r.error, r.label_error, pq.codebook_digest(books[r.dim])) for r in pq.label_errors(codes).collect())


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=32)], int(k % 3) if k % 5 else None) for k in rng.permutation(300)]
    rows += [(k, [float(x) for x in rng.integers(-2, 3, 20) / 256], 1) for k in range(40)]                 # ties, uneven parts
    rows += [(k, [0.5, -0.25], None) for k in range(3)] + [(7, [], 2)] * 2 + [(8, None, 1), (9, [1.0, None], 1), (10, [float("nan")] * 32, 1),
             (11, [float("inf")] + [0.0] * 31, 1), (None, rows[0][1], 0), (rows[0][0], rows[1][1], 0), rows[2], rows[2]]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5))
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert digested(*pq.compress(df)) == plain_codes(rows)


def test_no_vectors_no_codes(spark):
    codes, books = pq.compress(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int"))
    assert pq.label_errors(codes).collect() == [] and books == {}


def test_active_entries_give_the_full_scan():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = rng.integers(-3, 4, (200, 3))
        book = rng.integers(-3, 4, (12, 3))
        code, dist = pq.nearest(x, book)
        new = np.where(rng.random((12, 1)) < rng.random(), rng.integers(-3, 4, (12, 3)), book)
        got = pq.reassign(x, new, (new != book).any(axis=1), code, dist)
        want = pq.nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_unmoved_parts_meet_moved_entries_only(monkeypatch):
    asked = []
    full = pq.nearest
    monkeypatch.setattr(pq, "nearest", lambda x, book: asked.append((len(x), len(book))) or full(x, book))
    x = np.arange(40)[:, None]
    book = np.array([[0], [10], [20], [39]])
    code, dist = full(x, book)
    moved = np.array([False, True, False, False])
    book[1] = 12
    pq.reassign(x, book, moved, code, dist)
    assert asked == [(int((code == 1).sum()), 4), (int((code != 1).sum()), 1)]


def test_decoded_vectors_are_off_by_the_error(spark):
    codes, books = pq.compress(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    vectors = {r.vec_id: np.floor(256 * np.array(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    for r in pq.decode(codes, books).collect():
        assert ((256 * np.array(r.vector) - vectors[r.id]) ** 2).sum() == r.error


def test_very_large_components_are_held_to_the_bound():
    import pyarrow as pa
    x, _, valid = pq.whole_vectors(pa.array([[1e30, -1e30, 0.999]], pa.list_(pa.float32())))
    assert valid.all() and x.tolist() == [pq.LARGEST, -pq.LARGEST, 255]
