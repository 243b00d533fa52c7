"""Each stage against brute force on its own input, and the whole run."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_text_operators import SCHEMA, WORD, brute_lines, brute_links, check_packing, corpus  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_language_stage_rejects_texts_without_letters(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    gone = ids(docs) - ids(out)
    assert set(gone) >= {200, 201, 202, 211} and all(i in {200, 201, 202, 211, None} or i >= 203 for i in gone)
    assert {r.kept for r in out.collect()} == {"own"}


def test_passage_stage(spark, docs):
    out = corpus_pipeline.passages(spark, docs, "")
    text, gone = brute_lines()
    whole = {i for i in text if i is not None and text[i] and gone[i] and len(gone[i]) == sum(x != "" for x in text[i].split("\n"))}
    assert out.columns == docs.columns
    assert set(ids(docs)) - set(ids(out)) == whole
    for r in out.collect():
        assert r.n_chars == len(r.text or "")


def test_near_duplicate_stage(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    expected = {i for i, (_, _, root) in brute_links().items() if root == i}
    found = ids(out)
    assert out.columns == docs.columns
    assert {i for i in found if i is not None} == expected and found[None] == 2 and found[300] == 1


def test_mixture_and_packing_stages(spark, docs):
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and {r.size for r in mixed.collect()} == {"own"}
    out = corpus_pipeline.packed(spark, mixed, "").collect()
    check_packing(out, 2048)
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == ids(mixed)


def test_run(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "piece", "sequence_id", "offset"} <= set(out[0].asDict())
    assert not {r.doc_id for r in out} & {200, 201, 202, 101, 102, 111}


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_agree():
    assert WORD.findall("a\x1cb c") == ["a\x1cb", "c"]
