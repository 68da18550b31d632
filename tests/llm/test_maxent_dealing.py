import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import maxent_lm


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(maxent_lm, "TASK_TOKENS", 5_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = []
    for dealt, partitions in ((docs.repartition(7), "3"), (docs.orderBy(F.desc("doc_id")).coalesce(1), "5")):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        model = maxent_lm.train(dealt.where("doc_id % 5 <> 1"), steps=2)
        found.append({r.doc_id: r.score for r in maxent_lm.score(dealt, model).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0].keys() == found[1].keys()
    np.testing.assert_allclose([found[0][k] for k in found[0]], [found[1][k] for k in found[0]], rtol=2e-5)


def test_counts_beyond_16_bits_are_kept(spark):
    docs = spark.createDataFrame([(i, "a b " * 9_000) for i in range(12)], "doc_id long, text string")
    model = maxent_lm.train(docs, steps=1)
    slots = len(model.small.followers.cell)
    kept = maxent_lm.statistics(docs.select("text", F.xxhash64("doc_id").alias("key")), model.small.frequent, slots, model.total).where("kind = 1").collect()
    totals = np.concatenate([maxent_lm.unpacked(bytes(r.data), 5)[4] for r in kept])
    assert totals.max() >= 12 * 9_000 - 12 and totals.sum() == 4 * model.total


def test_weights_come_from_all_texts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").select("text", F.xxhash64("doc_id").alias("key")).cache()
    small = maxent_lm.train(docs.select("text"), steps=1).small
    texts = [r.text for r in docs.collect()]
    start = np.ones_like(small.gains)

    def loss(gains):
        """Less the logarithm of the probability of all texts, each token's own count left out."""
        small.gains = gains
        found = -small.opened().place_scores(texts, fit=True)[3].sum()
        small.gains = start
        return found

    small.gains = start
    whole = maxent_lm.fit_gains(docs, small, len(texts))
    monkeypatch.setattr(maxent_lm, "WEIGHT_DOCS", 10)
    slices = maxent_lm.fit_gains(docs, small, len(texts))
    # nearly as good as weights fitted on all texts at once, and every text has a part in them
    assert loss(slices) - loss(whole) < 0.05 * (loss(start) - loss(whole))
    without = [maxent_lm.fit_gains(docs.where(F.pmod("key", F.lit(4)) != k), small, len(texts)) for k in range(4)]
    assert all(np.abs(slices - w).max() > 1e-3 for w in without)
    later = F.pmod(F.xxhash64(F.lit("slice"), "key"), F.lit(1 << 31)) >= (1 << 31) // 2
    other = maxent_lm.fit_gains(docs.withColumn("text", F.when(later, F.lit("a b a c")).otherwise(F.col("text"))), small, len(texts))
    assert np.abs(slices - other).max() > 0.05
