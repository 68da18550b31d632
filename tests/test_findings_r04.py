"""Faults that the fourth review found."""

import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F


def test_weights_are_fitted_to_all_texts_at_every_step(spark, sf_dir, monkeypatch):
    from lexmill.llm import maxent_lm

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").select("text", F.xxhash64("doc_id").alias("key")).cache()
    small = maxent_lm.train(docs.select("text"), steps=1).small
    texts, start = [r.text for r in docs.collect()], np.ones_like(small.gains)

    def loss(gains):
        small.gains = gains
        found = -small.opened().place_scores(texts, fit=True)[3].sum()
        small.gains = start
        return found

    def fitted(documents):
        monkeypatch.setattr(maxent_lm, "WEIGHT_DOCS", documents)
        small.gains = start
        return loss(maxent_lm.fit_gains(docs, small, len(texts)))

    # where the fit starts from decides nothing: a few texts and all of them lead to the same weights
    few, whole = fitted(10), fitted(3000)
    assert abs(few - whole) < 1e-4 * whole and whole < 474_033


def test_intents_are_found_where_the_text_is(spark):
    from lexmill.operators import dictionary as d

    deal = random.Random(4)
    ends = ["", "요", "하나요???", "싶어요", "????", "!", "줘\n", "니다\x0b", "요\x85"]
    texts = [unicodedata.normalize(deal.choice(["NFC", "NFD"]), deal.choice(["규정 ", "휴 학", "a b", ""]) + deal.choice(["\t장학금 ", " 12", "@me "]) + deal.choice(ends)) for _ in range(300)]
    queries = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "query_id long, text string").repartition(3)
    triggers = spark.createDataFrame([("x", "장학금"), ("x", "장 학금요"), ("legacy_y", "규정"), ("z", "a b @me"), ("z", "?"), ("w", "휴학 12"), ("w", None), ("v", "12")], "intent_id string, trigger string")
    near, far = (d.match_intents(queries, triggers, [("digits", "[0-9]{2}"), ("x", "@")], limit=n) for n in (1 << 20, 0))
    assert near.schema.names == far.schema.names and sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    assert near.count() > 300 and "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert d.prepared("a \x0b하나요???") == "a\x0b" and d.prepared("a요\x85") == "a요\x85" and d.prepared("?" * 100_000) == "?" * 99_999
    # rows that share an id, as in SQL, count each
    twice = d.match_intents(spark.createDataFrame([(1, "장학금"), (1, "장학금 x"), (None, "a b @me")], "query_id long, text string"), triggers).collect()
    assert sorted(map(tuple, twice), key=str) == [(1, "x", 12, 1), (None, "z", 4, 1)]


def test_likeness_of_sets_exchanges_few_tokens(spark, monkeypatch):
    from lexmill.operators import dedup

    monkeypatch.setattr(dedup, "SLOTS", 1 << 16)
    deal = random.Random(6)
    texts = []
    for family in range(30):
        # all share rare words, and no two are alike but for a copy with other words here and there
        rare = [f"r{family}x{i}" for i in range(32)]
        many = [rare + deal.sample([f"w{i}" for i in range(300)], 118) for _ in range(38)]
        texts += [" ".join(words) for words in [*many, *([w if deal.random() > 0.05 else "y" for w in many[k]] for k in (0, 1))]]
    docs = spark.createDataFrame([*enumerate([*texts, texts[0], "", None])], "doc_id long, text string").repartition(4).cache()
    docs.count()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    # as with large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = written()
    found = {(r.a, r.b): r.jaccard for r in dedup.jaccard_pairs(docs, 0.8).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = written() - before
    sets = [set(t.split()) for t in texts]
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for f in range(0, 1200, 40) for a in range(f, f + 40) for b in range(a + 1, f + 40) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert found == want and len(want) > 50
    assert moved < 5 * sum(map(len, texts))
