"""Unbroken text, control characters in links, rules over the rows that are left."""

import time

import numpy as np
import pyarrow as pa
import pytest

from vigilo.llm import cascade, viterbi, warc
from vigilo.llm.words import Words


def parts_of(rng, sizes, letters="abcdé漢 ▁".replace(" ", "")):
    return ["".join(rng.choice(list(letters), n)) for n in sizes]


def by_batches(table, part):
    """The batched loops on a single part, whatever its length."""
    codes = viterbi._codes([part], len(part))
    power, inverse = viterbi._powers(len(part) + 1)
    total = viterbi._prefix_hashes(codes, power)
    return table._equal_length(codes, total, inverse)[0].tolist(), table._merged(codes, total, inverse)[0].tolist()


def small_table():
    pieces = ["<unk>", "a", "b", "c", "d", "ab", "bc", "abc", "cd", "dd", "aa", "aab", "é", "漢a", "abcd"]
    scores = [0.0, -2.0, -2.0, -2.5, -3.0, -3.0, -3.0, -3.0, -4.0, -4.0, -3.0, -6.0, -5.0, -1.0, -6.0]
    return viterbi.Pieces(pieces, scores, ["unknown"] + ["normal"] * (len(pieces) - 1))


@pytest.mark.parametrize("probed", [7, 1 << 20])
def test_long_parts_equal_the_batched_loops(monkeypatch, probed):
    monkeypatch.setattr(viterbi, "PROBED", probed)
    table = small_table()
    for part in parts_of(np.random.default_rng(4), [1, 2, 3, 20, 257, 300, 600]) + ["a" * 400, "漢" * 300]:
        path, merged = table._long(viterbi._codes([part], len(part)))
        assert (path[0].tolist(), merged[0].tolist()) == by_batches(table, part)
        assert path[1].tolist() == [len(path[0])] and merged[1].tolist() == [len(merged[0])]


def test_long_parts_of_the_public_file():
    table = viterbi.pieces(viterbi.default_path())
    rng = np.random.default_rng(9)
    part = "▁" + "".join(rng.choice(["the", "ing", "and", "q", "漢", "://", "=", "0"], 300))
    flat, size = zip(*table.encode_parts([part]))
    assert (flat[0].tolist(), flat[1].tolist()) == by_batches(table, part)
    assert [x.tolist() for x in size] == [[len(flat[0])], [len(flat[1])]]


def test_unbroken_text_is_linear():
    table = viterbi.pieces(viterbi.default_path())
    part = "▁" + "".join(np.random.default_rng(1).choice(list("abcdefghij"), 200_000))
    began = time.perf_counter()
    flat, _ = zip(*table.encode_parts([part]))
    assert time.perf_counter() - began < 60
    for ids in flat:
        assert table.decode(ids.tobytes()) == part[1:]


def test_control_characters_write_no_header(spark):
    page = '<a href="http://x/\r\nWARC-Type: response">y</a><a href="http://z/\x7f\x00">z</a>'
    df = spark.createDataFrame([(1, "http://h/\r\nEvil: 1\x7f", page), (2, None, None)],
                               "page_id long, url string, html string")
    rows = warc.derive(warc.responses(df)).collect()
    for r in rows:
        lines = r.warc_header.split("\r\n")
        assert sum(x.startswith("WARC-Type:") for x in lines) == 1
        assert not any(x.startswith("Evil") for x in lines)
    meta = next(r for r in rows if r.source_id == 1 and r.record_type == "metadata")
    assert meta.target_uri == "http://h/%0D%0AEvil: 1%7F"
    assert "outlink: http://x/%0D%0AWARC-Type: response\r\n" in meta.block
    assert "outlink: http://z/%7F%00\r\n" in meta.block


def test_control_characters_as_in_sql(spark, tmp_path):
    import duckdb
    from tests.oracle import compare
    from vigilo.llm import queries
    page = '<p>t</p><a href="http://x/\r\n\tWARC-Type: response">y</a>' + "<b>long</b> " * 100_000
    spark.createDataFrame([(1, "http://h/\r\nEvil: 1\x7f", page), (2, "http://u/a b", "<a href='q'>r</a>")],
                          "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ok, msg = compare(queries.QUERIES["op1_warc_derivatives"](spark, str(tmp_path)),
                      queries.SQL["op1_warc_derivatives"], con)
    assert ok, msg[:500]


TEXTS = ["a b a b a b", None, "", "x\ny\nx\n", "WOW!! NO!! yes", "# $ % &", " lead and trail ", "é漢 ü!!"] * 3


def test_taken_words_equal_a_fresh_table():
    column = pa.array(TEXTS)
    words = Words(column)
    for rows in (np.arange(len(TEXTS)), np.array([5, 0, 7, 1, 3]), np.zeros(0, np.int64)):
        got, want = words.take(rows), Words(column.take(pa.array(rows)))
        for name in ("starts", "ends", "ptr", "counts", "offsets", "data", "_inside"):
            assert getattr(got, name).tolist() == getattr(want, name).tolist(), name
        assert got.hashes().tolist() == want.hashes().tolist()


def test_features_of_taken_rows():
    column = pa.array(TEXTS)
    rows = np.array([4, 7, 0])
    want = cascade.Batch(column.take(pa.array(rows)))
    late = cascade.Batch(column).take(rows)
    early = cascade.Batch(column)
    cascade.output_features(early)
    early = early.take(rows)
    for name in ("n_words", "n_symbols", "word_chars", "lines", "n_repeat_words", "n_shouts"):
        for got in (late, early, late.take(np.arange(3)), early.again()):
            assert getattr(got, name).tolist() == getattr(want, name).tolist(), name
