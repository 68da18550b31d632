"""Near copies against brute force over five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import near_copies
from tests.llm.test_operators import roots


def shingle_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(words, changes, pick):
    words = list(words)
    for at in pick.sample(range(len(words)), changes):
        words[at] = f"new{pick.randrange(10**9)}"
    return " ".join(words)


def kept_and_wanted(rows, got):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {r.doc_id: r.component_id for r in got}, roots(list(sets), links), links


def test_stage_takes_five_words_and_eight_tenths(spark):
    import corpus_pipeline

    pick, rows = random.Random(11), []
    for i in range(200):
        words = [f"w{pick.randrange(5000)}" for _ in range(250)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(words, 1 + i % 8, pick))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, want, links = kept_and_wanted(rows, near_copies.near_copies(docs).collect())
    assert len(links) > 80
    # no link is false, and few are missed
    assert all(want[i] == want[c] for i, c in found.items())
    recall = sum(found[a] == found[b] for a, b in links) / len(links)
    assert recall >= 0.95, recall
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert kept == set(found.values())


@pytest.mark.parametrize("long", [2048, 100])
def test_crowds_lose_no_link(spark, monkeypatch, long):
    """Compared in their shards, or as pairs where sets are too long to travel."""
    pick = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, edited(words, 1 + i % 9, pick)) for i in range(150)]
    rows += [(200 + i, edited(words[:150] + [f"x{k}" for k in range(150)], 1 + i % 9, pick)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "CROWD", 5)
    monkeypatch.setattr(near_copies, "LONG", long)
    few, want, _ = kept_and_wanted(rows, near_copies.near_copies(docs).collect())
    assert all(want[i] == want[c] for i, c in few.items())
    assert few == want
    assert near_copies.near_copies(docs.where(F.lit(False))).count() == 0


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(1, one), (1, two), (1, two), (5, one), (None, three), (None, three), (None, four), (9, four)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (1, two), (None, three), (9, four)], key=str)


def test_more_blocks_than_one_shard_holds(spark):
    """Blocks of a single shard beyond any packed number: no pair is lost in another band or shard."""
    from lexmill.llm import simhash_vptree

    values = [(i << 40) | (i & 1) for i in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash_vptree.near_pairs(frame, shard=1000, block=2).collect()
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    assert roots(values, [(r.u, r.v) for r in links]) == want


def test_crowds_ask_pairs_in_proportion_to_their_sets(spark, monkeypatch):
    """Pairs inside a crowd wait: what is asked at once are two for each set, and no pair of two of its sets is asked later."""
    pick, counts, linked = random.Random(13), [], near_copies.linked
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, edited(words, 1 + i % 3, pick)) for i in range(120)], "doc_id long, text string")

    def counting(first, pairs, *rest):
        counts.append((first.count(), pairs.count()))
        return linked(first, pairs, *rest)

    monkeypatch.setattr(near_copies, "CROWD", 5)
    monkeypatch.setattr(near_copies, "linked", counting)
    assert {r.component_id for r in near_copies.near_copies(docs).collect()} == {0}
    assert counts[0][0] <= 2 * 120 and counts[0][1] < 120


def test_small_results_are_read_back_by_few_tasks(spark):
    """A checkpoint keeps a partition, and behind it files of each shuffle, for every partition that a shuffle had."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    found = near_copies.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"))
    try:
        assert {r.root for r in found.collect()} == {0}
        assert spark.createDataFrame([(i,) for i in range(40)], "i long").distinct().rdd.getNumPartitions() == 64
        # the pairs twice, once by a shuffle: the part that is read back has a few
        assert found.rdd.getNumPartitions() < 64 + 32
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
