import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import scan


def sequences(seed=1):
    rng = random.Random(seed)
    rows = []
    for key in ["a", "b", None, "long"]:
        at = 0
        for _ in range(700 if key == "long" else rng.randint(1, 30)):
            rows.append((key, at, rng.randint(0, 2), rng.randint(0, 12)))
            at += rng.choice([1, 1, 1, 4])
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(sequences(), "key string, at int, symbol int, level int").repartition(5)


@pytest.mark.parametrize("chunk", [2, 7, 256])
def test_states(rows, chunk):
    table = [[1, 0, 2], [2, 1, 0], [2, 0, 1]]
    found = {(r.key, r["at"]): r.state for r in scan.states(rows, ["key"], "at", F.col("symbol"), table, 0, chunk).collect()}
    want = {}
    for key, some in by_key(sequences()).items():
        state = 0
        for _, at, symbol, _ in some:
            want[key, at] = state
            state = table[state][symbol]
    assert found == want


@pytest.mark.parametrize("chunk", [3, 256])
def test_carried_values_and_counts(rows, chunk):
    fields = {"head": (F.col("symbol") == 2, F.when(F.col("level") > 3, F.col("level"))), "other": (F.col("level") == 5, F.col("at").cast("string"))}
    found = {(r.key, r["at"]): (r.head, r.other) for r in scan.carried(rows, ["key"], "at", fields, chunk).collect()}
    sums = {(r.key, r["at"]): (r.twos, r.fives) for r in scan.counted(rows, ["key"], "at", {"twos": F.col("symbol") == 2, "fives": F.col("level") == 5}, chunk).collect()}
    for key, some in by_key(sequences()).items():
        head = other = None
        twos = fives = 0
        for _, at, symbol, level in some:
            if symbol == 2:
                head, twos = (level if level > 3 else None), twos + 1
            if level == 5:
                other, fives = str(at), fives + 1
            assert found[key, at] == (head, other) and sums[key, at] == (twos, fives)


@pytest.mark.parametrize("chunk", [2, 16, 256])
def test_parents(rows, chunk):
    found = {(r.key, r["at"]): (r.parent_at, r.depth) for r in scan.parents(rows, ["key"], "at", "level", chunk).collect()}
    for key, some in by_key(sequences()).items():
        stack = []
        for _, at, _, level in some:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert found[key, at] == (stack[-1][0] if stack else None, len(stack) + 1)
            stack.append((at, level))


def test_deep_and_empty(spark):
    deep = spark.range(60).select(F.lit(1).alias("key"), F.col("id").alias("at"), F.col("id").alias("level"))
    found = sorted((r["at"], r.parent_at, r.depth) for r in scan.parents(deep, ["key"], "at", "level", 8).collect())
    assert found == [(i, i - 1 if i else None, i + 1) for i in range(60)]
    assert scan.parents(deep.where("false"), ["key"], "at", "level").count() == 0
