"""The corpus pipeline, stage by stage, against brute force on what each stage was given."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import check_packing, shingle_pairs, strip, token_ids, words
from vigilo.llm import cascade, omh, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "repeated_passages", "packing"]
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, stages):
    scores = {r.doc_id: r.predicted for r in toxicity.score(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    before, after = by_id(stages[0]), by_id(stages[1])
    assert set(after) == {i for i in before if not scores[i]} and all(after[i] == before[i] for i in after)


def test_low_quality_documents_go(stages):
    kept = {r.doc_id: r.kept for r in cascade.quality_cascade(stages[1]).collect()}
    before, after = by_id(stages[1]), by_id(stages[2])
    assert set(after) == {i for i in before if kept[i]} and all(after[i] == before[i] for i in after)


def test_one_document_of_each_class_stays(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    cls = {r.doc_id: r.class_id for r in omh.near_duplicates(stages[2]).collect()}
    assert set(after) == set(cls.values()) and all(after[i] == before[i] for i in after)
    assert not shingle_pairs({i: r.text for i, r in after.items()}, 0.8)


def test_repeated_passages_are_cut(stages):
    before, after = stages[3].collect(), by_id(stages[4])
    assert len(after) == len(before)
    for r, (_, _, text) in zip(before, strip([words(r.text) for r in before])):
        got = after[r.doc_id]
        assert got.text.encode() == text and got.n_chars == len(got.text) and (got.lang, got.source) == (r.lang, r.source)


def test_packing_holds_every_id(stages):
    encode = token_ids(None)
    check_packing(stages[5].collect(), {r.doc_id: encode(r.text) for r in stages[4].collect()},
                  lambda x: zlib.crc32(x.tobytes()))


def test_run_is_the_stages_in_order(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert Counter(map(key, corpus_pipeline.run(spark, SF).collect())) == Counter(map(key, stages[5].collect()))


def test_an_empty_corpus_gives_an_empty_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
