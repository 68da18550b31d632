import pytest

from lexmill.llm import queries
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name, key, table", [("op2_bpe_forced", "doc_id", "documents"), ("op7_token_trie", "doc_id", "documents"), ("op8_page_diff", "page_id", "pages"), ("op4_language_mixture", "doc_id", "documents")])
def test_query_has_a_row_for_each_input_row(spark, sf_dir, name, key, table):
    found = sorted(r[0] for r in queries.QUERIES[name](spark, sf_dir).select(key).collect())
    assert found == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    from tests.llm.test_operators import SCHEMA, odd_rows, roots, slow_simhash

    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    first = corpus_pipeline.known_language(spark, docs, "")
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert kept == {r[0] for r in odd_rows()} - {100, 101, 102}
    second = corpus_pipeline.one_of_each(spark, first, "")
    assert second.columns == docs.columns
    rows = [(r[0], slow_simhash(r[1])) for r in odd_rows() if r[0] in kept]
    fps = sorted({f for _, f in rows})
    group = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    firsts = {}
    for doc, fp in rows:
        firsts[group[fp]] = min(doc, firsts.get(group[fp], doc))
    assert sorted(r.doc_id for r in second.collect()) == sorted(firsts.values())
    third = corpus_pipeline.mixed(spark, second, "")
    assert third.columns == docs.columns
    from lexmill.llm.source_mix import mix

    want = sorted(r.doc_id for r in mix(second).collect() for _ in range(r.copies))
    assert sorted(r.doc_id for r in third.collect()) == want
    last = corpus_pipeline.encoded(spark, third, "")
    assert sorted(r.doc_id for r in last.collect()) == want


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
