import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import maxent_lm

ODD = ["A b\x0bC \x1c ÄÖ b", "", None, "  \t\n", "end", "\ud800 a", "a b \x85", "x" * 70_000 + " a", " y", "aa A a"]


def test_tokens_classes_and_hashes_are_those_of_a_loop():
    frequent = {b"a": 1, b"end": 2}
    for texts in (ODD, [None], ["", " "], ["a"]):
        distinct, ids, lengths = maxent_lm.tokens_of(texts)
        loops = [[*maxent_lm.words(t), b""] for t in texts]
        tokens = distinct.to_pylist()
        assert tokens == list(dict.fromkeys(w for t in loops for w in t))
        assert [tokens[i] for i in ids] == [w for t in loops for w in t] and lengths.tolist() == [len(t) for t in loops]
        assert maxent_lm.classes_of(distinct, frequent).tolist() == [maxent_lm.class_of(t, frequent) for t in tokens]
        assert maxent_lm.hashes(distinct).tolist() == [xxhash.xxh64_intdigest(t, 42) for t in tokens]
    assert maxent_lm.class_of(b"xyz", frequent) == 32 + zlib.crc32(b"yz") % 32


def test_followers_by_weight_number():
    """The weight number and the own count left out, for all counts, against their definition."""
    n, total = (x.ravel() for x in np.meshgrid(np.arange(256), np.arange(256), indexing="ij"))
    real = (n <= total) & ((n > 0) | (total == 0))
    n, total = np.where(real, n, 0), np.where(real, total, 0)
    slots = 1 << 16
    cell = np.arange(slots) % 60_000
    table = maxent_lm.Followers(cell.astype(np.uint16), (np.arange(slots) % 256).astype(np.uint8), n.astype(np.uint8), total.astype(np.uint8)).opened()
    history = np.arange(slots, dtype=np.uint64) << np.uint64(48) | np.arange(slots, dtype=np.uint64) % np.uint64(256)
    for own in (None, cell, cell + 1):
        left, all_ = n - (own is cell), total - (own is not None)
        known = left > 0
        step = np.minimum(np.log2(np.maximum(left, 1)).astype(int), 5) * 4 + np.minimum(4 * left // np.maximum(all_, 1), 3)
        found, weight = table.find(history, own)
        assert (found == np.where(known, cell, -1)).all() and (weight == np.where(known, step, 0)).all()
        assert (table.find(history ^ np.uint64(1), own)[0] == -1).all()


def test_most_places_are_answered_where_they_stand(spark):
    """What a block of texts sends to the join with the counts: under half of its distinct tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    counted = maxent_lm.count_tokens(docs)
    answered = maxent_lm.train(docs, steps=1).small.answered
    assert len(answered) <= maxent_lm.ANSWERED + maxent_lm.FREQUENT + 1
    distinct = maxent_lm.tokens_of([r.text for r in docs.limit(200).collect()])[0].to_pylist()
    assert sum(t not in answered for t in distinct) < 0.5 * len(distinct)
    assert counted.agg(F.sum("n")).first()[0] == sum(len(maxent_lm.words(r.text)) + 1 for r in docs.collect())


def test_tokens_sent_to_the_driver_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "ANSWERED", 10)
    counted = spark.createDataFrame([(b"%d" % i, 100 - i if i < 9 else 7) for i in range(500)] + [(b"", 1000)], "token binary, n long")
    assert sorted(r.n for r in maxent_lm.most_frequent(counted).collect()) == list(range(92, 101))
    assert maxent_lm.most_frequent(counted.where("n = 7")).count() == 0


def test_an_end_alone_has_a_class():
    assert maxent_lm.classes_of(pa.array([b""], pa.large_binary()), {}).tolist() == [0]
