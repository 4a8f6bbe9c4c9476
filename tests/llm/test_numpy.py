"""The numpy kernels against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigilo.llm import omh, packing, topk, toxicity, viterbi, warc
from vigilo.llm.words import Spans, Words, gram_positions

TEXTS = ["a b  c\tc", None, "", "  \n", "é\x0bü 日本 x", "x" * 3000 + " y", "one\x85two", "end"]


def test_words_are_the_contract_pattern():
    import re
    w = Words(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        expected = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        a, b = w.ptr[i], w.ptr[i + 1]
        assert [w.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] == expected
        assert w.word_chars()[i] == sum(map(len, expected))


def test_hashes_do_not_depend_on_the_batch():
    alone = [Words(pa.array([t], pa.string())).hashes() for t in TEXTS]
    assert (np.concatenate(alone) == Words(pa.array(TEXTS)).hashes()).all()
    sliced = pa.array(["zzz", *TEXTS]).slice(1)
    assert (Words(sliced).hashes() == Words(pa.array(TEXTS)).hashes()).all()


def test_spans_are_equal_for_equal_words_only():
    w = Words(pa.array(["a b c a b c d", "b c a"]))
    at, doc = gram_positions(w.ptr, 3)
    key = Spans(w.hashes()).of(at, at + 3)
    words = "a b c a b c d b c a".split()
    grams = [tuple(words[i:i + 3]) for i in at]
    for x in range(len(at)):
        for y in range(len(at)):
            assert (key[x] == key[y]) == (grams[x] == grams[y])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_alignment_is_the_edit_distance(seed):
    rng = random.Random(seed)
    for _ in range(150):
        a = [rng.randrange(4) for _ in range(rng.randrange(40))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randrange(4) for _ in range(rng.randrange(4))]
        most = rng.randrange(15)
        expected = min(plain_distance(a, b), most + 1)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert omh.edit_distance(x, y, most) == expected


def test_long_alignments():
    rng = random.Random(4)
    a = [rng.randrange(1000) for _ in range(600)]
    b = [x if rng.random() > 0.12 else rng.randrange(1000) for x in a]
    d = plain_distance(a, b)
    assert omh.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), 120) == d
    assert omh.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (d <= 120)


def test_sketches_keep_text_order():
    text = " ".join(f"w{i}" for i in range(60))
    turned = " ".join(f"w{i}" for i in [*range(30, 60), *range(30)])
    value = omh.sketches(Words(pa.array([text, text, turned])))
    assert (value[0] == value[1]).all()
    assert (value[0] == value[2]).mean() < 0.9       # same shingles mostly, other order


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    units = 64
    demand = np.zeros(units + 1, np.int64)
    for s in rng.integers(1, units + 1, 400 if seed else 1):
        demand[s] += 1
    solution = packing.plan(demand, units)
    used = Counter()
    for pattern, n in solution:
        assert sum(s * k for s, k in pattern.items()) <= units and n > 0
        for s, k in pattern.items():
            used[s] += k * n
    assert used == Counter({s: int(n) for s, n in enumerate(demand) if n and s})
    least = -(-int((np.arange(units + 1) * demand).sum()) // units)
    assert sum(n for _, n in solution) <= max(1.12 * least, least + 3)


def test_knapsack_prices_the_best_pattern():
    import itertools
    duals = np.array([0, .11, .0, .37, .0, .64, .0, .0, .0])
    value, pattern = packing.price(duals, 8)
    best = max(a * .11 + b * .37 + c * .64 for a, b, c in itertools.product(range(9), range(3), range(2)) if a + 3 * b + 5 * c <= 8)
    assert value == pytest.approx(best) and (pattern * duals).sum() == pytest.approx(best)
    assert (pattern * np.arange(9)).sum() <= 8


@pytest.mark.parametrize("low,high", [(-300, 300), (200, 256), (-5, 5)])
def test_block_search_is_exact(low, high):
    rng = np.random.default_rng(3)
    v = rng.integers(low, high, (400, 8))
    v[100:180] = v[7]
    ids = rng.permutation(400).astype(np.int64)
    norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((ids, -norm))
    v, ids = v[order], ids[order]
    block = topk.Block(ids.tobytes(), v.astype(np.int64).tobytes(), 8)
    for qi in range(0, 400, 37):
        q, own = v[qi], int(ids[qi])
        scores = v @ q
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != own)[:5]
        for theta in (-np.inf, -best[-1][0], -best[-1][0] - 3):
            got_ids, got = block.search(own, q, 5, float(theta))
            assert [(-int(s), int(i)) for i, s in zip(got_ids, got)][:5] == best


def test_large_products_are_exact():
    v = np.array([[2 ** 30, -3], [2 ** 30 + 1, 5]], np.int64)
    q = np.array([2 ** 30 - 1, 2 ** 29], np.int64)
    assert topk.products(v, q).tolist() == [sum(int(a) * int(b) for a, b in zip(r, q)) for r in v]


def test_viterbi_is_the_best_segmentation():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "<0xC3>", "<0xA9>"]
    scores = [0, -3.0, -2.0, -2.0, -3.5, -4.0, -3.0, -7.0, 0, 0]
    kinds = ["unknown"] + ["normal"] * 7 + ["byte"] * 2
    table = viterbi.Pieces(pieces, scores, kinds)
    score = dict(zip(pieces[1:8], scores[1:8]))

    def best(text):
        out = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            options = []
            for start in range(end):
                p = text[start:end]
                s = score.get(p, table.unknown if len(p) == 1 else None)
                if s is not None:
                    options.append((out[start][0] + s, len(p), out[start][1] + [p]))
            top = max(options, key=lambda x: (x[0], x[1]))
            out[end] = (top[0], top[2])
        return out[len(text)][1]

    rng = random.Random(0)
    words = ["".join(rng.choice("▁abé") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    words = [w for w in words if set(w) & set("ab")]
    words.sort(key=len)
    flat_ids, size = table.encode_parts(words)[0]
    for w, ids in zip(words, np.split(flat_ids.astype("<u4"), np.cumsum(size)[:-1])):
        flat = []
        for p in best(w):
            flat += [pieces.index(p)] if p in score else [8, 9]
        assert ids.tolist() == flat
        assert table.decode(b"".join([np.array([1], "<u4").tobytes(), ids.tobytes()])) == w.replace("▁", " ")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    old = toxicity.EMBEDDED
    w = {k: x.astype(np.float64) for k, x in toxicity.new_weights(rng).items()}
    x = rng.normal(size=(7, w["Wf"].shape[0]))
    ids = rng.integers(0, 7, (5, 3))
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    target, weight = np.array([1.0, 0, 1]), np.ones(3)

    def loss(weights):
        z, _ = toxicity.forward(weights, toxicity.project(weights, x), ids, mask)
        return float((np.logaddexp(0, z) - target * z).sum())

    g, _, _ = toxicity.gradients(w, x, toxicity.project(w, x), ids, mask, target, weight)
    for k in ("Wf", "Ub", "A", "a", "v", "cf"):
        at = np.unravel_index(rng.integers(w[k].size), w[k].shape)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, abs=5e-3)
    assert toxicity.EMBEDDED == old


class _Reader:
    """Independent reading of a page by the standard library's parser."""

    def text(self, html):
        from html.parser import HTMLParser

        class P(HTMLParser):
            hidden, out = 0, ()

            def handle_starttag(self, tag, attrs):
                self.hidden += tag in ("script", "style", "noscript")
                self.out += ("\n",) if tag in ("p", "div", "br", "li", "ul", "h1", "title", "head", "nav", "article", "body", "html") else ()

            def handle_endtag(self, tag):
                self.hidden -= tag in ("script", "style", "noscript")
                self.out += ("\n",) if tag in ("p", "div", "li", "ul", "h1", "title", "head", "nav", "article", "body", "html") else ()

            def handle_data(self, data):
                self.out += () if self.hidden else (data,)
        p = P(convert_charrefs=True)
        p.feed(html)
        p.close()
        lines = (" ".join(x.split(" ")) for x in "".join(p.out).split("\n"))
        import re
        return "\n".join(y for y in (re.sub(r"[ \t\r\f]+", " ", x).strip(" ") for x in lines) if y)


def test_page_text_against_a_real_parser():
    import pyarrow.parquet as pq
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    for html in pages:
        assert warc.page_parts(html)[0] == _Reader().text(html)


def test_references_are_decoded_once():
    assert warc.page_parts("<p>&amp;lt; &#233;&#xE9; &eacute; &nope; &#0;&#xD800; &amp</p>")[0] == "&lt; éé é &nope; �� &amp"
