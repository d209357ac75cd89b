"""The pipeline and the registered corpus queries."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from docketry.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0),
        (3, "short text of five words", "en", "a", 24), (3, "short text of five words", "en", "a", 24),
        (None, "write to someone@example.com about it", "en", None, 37), (4, "SHORT text of five words", "en", "b", 24),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_odd_rows(spark, sf_dir, edge):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, sf_dir)
        assert out.columns[:5] == COLUMNS, name
        assert stage(spark, edge.limit(0), sf_dir).count() == 0, name
        if name == "near_dedup":
            assert sorted((r.doc_id or 0, r.text) for r in out.filter("text is not null").collect()) == [
                (0, "write to someone@example.com about it"), (2, ""), (3, "short text of five words")]
        if name == "pii":
            assert "write to <EMAIL> about it" in [r.text for r in out.collect()] and out.count() == 7
        if name == "decontamination":
            assert out.count() == 7


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 50
    assert all(r.n_tokens == len(r.ids) for r in rows.select("n_tokens", "ids").collect())


def test_one_query_for_each_operator():
    known = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(known)
