import pytest
from pyspark.sql import functions as F

from lexmill.functions import stats
from lexmill.functions import text as X
from lexmill.operators import ranking, sync, tree
from lexmill.sources import tables


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_tokens_and_counts(spark):
    assert one(spark, X.tokens(F.lit("교원 임용 Rule-7, Über"))) == ["교원", "임용", "rule", "7", "ber"]
    assert [one(spark, X.token_count(F.lit(t))) for t in ("", "a", "abcde", "x" * 100)] == [0, 1, 2, 40]
    assert one(spark, X.token_count(F.lit(None).cast("string"))) == 0


def test_sort_numbers(spark):
    for label, want in (("제29조의2", (29, 2)), ("①", (1, 0)), ("1.", (1, 0)), ("가.", (1, 0)), ("", (None, 0))):
        assert tuple(one(spark, X.sort_number(F.lit(label)))) == want


def test_article_references_and_citations(spark):
    text = "제8조의2와 제8조의2, 그리고 「학칙」 제3조에 따른다."
    assert one(spark, X.article_references(F.lit(text))) == ["제8조의2", "제3조"]
    assert one(spark, X.unwrapped_citation(F.lit(text))) == ["학칙 제3조"]


def test_private_use_signs(spark):
    assert one(spark, X.collapse_private_use(F.lit("abc"))) == "a·b✓c"


def test_set_likeness(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, X.jaccard(a(), a())) == 1.0
    assert one(spark, X.jaccard(a("x"), a())) == 0.0
    assert one(spark, X.jaccard(a("x", "y"), a("y", "z"))) == 1 / 3
    assert one(spark, X.overlap_coefficient(a("x", "y"), a("y"))) == 1.0


def test_statistics(spark):
    assert abs(one(spark, stats.two_tailed_p(F.lit(1.96))) - 0.05) < 1e-3
    assert one(spark, stats.z_score(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0))) == 0.0
    low, high = one(spark, stats.wilson(F.lit(50), F.lit(100)))
    assert 0.40 < low < 0.41 and 0.59 < high < 0.60
    assert tuple(one(spark, stats.wilson(F.lit(0), F.lit(0)))) == (0.0, 0.0)


def test_bm25_ranks_the_matching_document_first(spark):
    docs = spark.createDataFrame([(1, "교원 임용 규정 교원 임용"), (2, "학생 등록 규정"), (3, "직원 휴가 규정")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "교원 임용"), (2, "없는단어")], "query_id long, text string")
    found = ranking.bm25(docs, asked).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in found] == [(1, 1, 1)]


def test_fusion_adaptive_filter_and_calibration(spark):
    ranked = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.2, 2), (2, 12, 0.1, 1), (2, 13, 0.05, 2)], "query_id long, doc_id long, score double, rank int")
    kept = ranking.adaptive_filter(ranked, 0.5)
    assert sorted(r.doc_id for r in kept.collect()) == [10, 12]
    fused = ranking.reciprocal_rank_fusion([(ranked, 0.5), (ranked, 0.5)]).collect()
    assert {r.doc_id: round(r.score, 9) for r in fused if r.query_id == 1} == {10: round(1 / 61, 9), 11: round(1 / 62, 9)}
    scaled = {r.doc_id: r.c for r in ranked.withColumn("c", ranking.calibrated()).collect()}
    assert abs(scaled[10] - 0.95) < 1e-9 and abs(scaled[11] - 0.1) < 1e-9


def test_sync_diff_and_apply(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "key string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "key string, hash string")
    actions = sync.diff(old, new)
    assert {r.key: r.action for r in actions.collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}
    store = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "key string, v int")
    changed = spark.createDataFrame([("a", 2), ("b", 2), ("d", 2)], "key string, v int")
    assert {r.key: r.v for r in sync.apply_changes(store, changed, actions, "key").collect()} == {"a": 1, "b": 2, "d": 2}


def test_tree_paths_references_and_ids(spark):
    rows = [("d", 1, None, "chapter", "제1장", ""), ("d", 2, 1, "article", "제1조", "제2조에 따른다"), ("d", 3, 1, "article", "제2조", "x"), ("d", 4, 3, "text", "제2조", "y")]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id long, parent_id long, type string, label string, text string")
    assert {r.node_id: r.path for r in tree.paths(nodes).collect()} == {1: ["제1장"], 2: ["제1장", "제1조"], 3: ["제1장", "제2조"], 4: ["제1장", "제2조", "제2조"]}
    assert tree.depth(nodes).first().depth == 3
    assert [(r.node_id, r.target_node) for r in tree.resolve_references(nodes).collect()] == [(2, 3)]
    ids = [r.stable_id for r in tree.stable_ids(nodes).collect()]
    assert len(set(ids)) == 4
    assert one(spark, tree.deduped_path(F.array(F.lit("a b"), F.lit("ab"), F.lit("c")))) == ["a b", "c"]


def test_document_json(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"docs": [{"title": "A", "doc_type": "regulation", "metadata": {"rule_code": "1-1"}, "content": [{"id": "n1", "type": "article", "text": "x", "children": [{"id": "n2", "text": "y"}]}], "addenda": [{"id": "n3", "text": "z"}]},'
        '{"title": "T", "doc_type": "toc", "rule_code": "9"}, {"title": "N", "doc_type": "regulation"}]}'
    )
    docs = tables.read_documents(spark, str(tmp_path / "d.json"))
    assert [r.rule_code for r in docs.collect()] == ["1-1"]
    nodes = tables.flatten_nodes(docs).orderBy("position").collect()
    assert [(n.id, n.level) for n in nodes] == [("n1", 1), ("n2", 2), ("n3", 1)]


def test_json_lines_and_sinks(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"query": "a", "rating": 1}\n\nnot json\n{"query": "b", "rating": -1}\n')
    rows = tables.read_json_lines(spark, str(tmp_path / "f.jsonl"))
    assert sorted(r.query for r in rows.collect() if r.query) == ["a", "b"]
    tables.write_table(rows.where("query IS NOT NULL"), str(tmp_path / "out"), ("rating",))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in tables.upsert(store, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_trees_and_documents_of_any_depth(spark, tmp_path):
    import json

    from lexmill.operators import tree
    from lexmill.sources import tables

    chain = spark.createDataFrame([(1, i, i - 1 if i else None, f"n{i}") for i in range(14)], "doc_id long, node_id long, parent_id long, label string")
    assert tree.depth(chain).first().depth == 14
    with pytest.raises(ValueError):
        tree.paths(chain, 5)
    node = {"id": "n11", "title": "t"}
    for i in range(10, -1, -1):
        node = {"id": f"n{i}", "title": "t", "children": [node, {"id": f"side{i}"}]}
    (tmp_path / "deep.json").write_text(json.dumps({"docs": [{"id": "R1", "title": "x", "content": [node]}]}))
    rows = tables.flatten_nodes(tables.read_documents(spark, str(tmp_path / "deep.json"))).collect()
    assert {r.id for r in rows} == {f"n{i}" for i in range(12)} | {f"side{i}" for i in range(11)}
    assert max(r.level for r in rows) == 12


def test_vector_queries_in_blocks(spark, monkeypatch):
    from lexmill.operators import ranking

    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = vectors.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, ranking.cosine_top_k(vectors, queries, 3).collect()))
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, ranking.cosine_top_k(vectors, queries, 3).collect())) == whole
