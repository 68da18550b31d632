import random

import pytest

from lexmill.operators import ranking, search_index


def corpus(seed=4, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "규정 제1조 W1")]


QUERIES = [(1, "w0 w1 w2 w50"), (2, "w59"), (3, "nothing here"), (4, "w0 W0 w3 w7 w11 w20 w30 규정"), (5, ""), (6, None), (7, "w0")]


@pytest.mark.parametrize("block, k", [(128, 10), (4, 3), (1, 1)])
def test_hits_equal_those_of_all_postings(spark, tmp_path, block, k):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    search_index.build(docs, str(tmp_path / "index"), block=block)
    found, steps = search_index._search(spark, str(tmp_path / "index"), queries, k, 6)
    want = sorted(map(tuple, ranking.bm25(docs, queries, k).select("query_id", "doc_id", "score", "rank").collect()))
    assert sorted(map(tuple, found.select("query_id", "doc_id", "score", "rank").collect())) == want
    every = ranking.bm25(docs, queries, 10_000).count()
    assert steps["ranked"].where("light").count() > 0 and steps["candidates"].count() < every


def test_nothing(spark, tmp_path):
    search_index.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "index"))
    assert search_index.search(spark, str(tmp_path / "index"), spark.createDataFrame(QUERIES, "query_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_many_candidates_meet_light_postings_without_a_join(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search_index, "BROADCAST_TERMS", few)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    # blocks go on from batch to batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    docs = spark.createDataFrame(corpus(6, 150), "doc_id long, text string").repartition(2)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    search_index.build(docs, str(tmp_path / "index"), block=4)
    blocks = spark.read.parquet(str(tmp_path / "index/blocks")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert all(len(r.docs) == len(r.parts) <= 4 and r.best == r.parts[0] == max(r.parts) for r in blocks) and max(len(r.docs) for r in blocks) == 4
    found, steps = search_index._search(spark, str(tmp_path / "index"), queries, 3, 6)
    want = sorted(map(tuple, ranking.bm25(docs, queries, 3).select("query_id", "doc_id", "score", "rank").collect()))
    assert sorted(map(tuple, found.select("query_id", "doc_id", "score", "rank").collect())) == want
    assert ("LeftSemi" in steps["looked"]._jdf.queryExecution().optimizedPlan().toString()) == bool(few)
