import hashlib
import random
import zlib

import pytest

from lexmill.llm import prefix_trie as module
from lexmill.llm.prefix_trie import SpillingQueue, prefix_trie, shared_starts

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = sum(len(n) == len(node) + 1 for n in below)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children, len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(convs=70, seed=5):
    rng = random.Random(seed)
    texts = ["", "a", "é\n", "same words", None]
    rows = []
    for c in range(convs):
        if c % 10 == 5:
            continue
        for turn in range(rng.choice([0, 1, 3, 8, 12])):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(c, turn, "user", f"hot {turn}") for c in range(200, 260) for turn in range(4)]
    rows += [(300, turn, "user", f"deep {turn % 3}") for turn in range(400)] + [(301, turn, "user", f"deep {turn % 3}") for turn in range(300)]
    return rows + [(None, 1, "user", "lost"), (10**15, None, None, None)] + rows[:5]


@pytest.mark.parametrize("light, queue", [(4096, 200_000), (2, 3), (5, 1)])
def test_equals_the_definition(spark, light, queue, monkeypatch):
    monkeypatch.setattr(module, "LEAST_SHARED", light)
    docs = spark.createDataFrame([(*r, 1, "x") for r in odd_rows()], SCHEMA).repartition(3)
    found = prefix_trie(shared_starts(docs), light=light, queue=queue)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == slow(odd_rows())


def test_one_turn_and_nothing(spark):
    one = prefix_trie(shared_starts(spark.createDataFrame([(3, 1, "user", "x", 1, "")], SCHEMA)))
    assert sorted(map(tuple, one.collect()), key=str) == slow([(3, 1, "user", "x")])
    assert prefix_trie(shared_starts(spark.createDataFrame([], SCHEMA))).count() == 0


def test_queue_gives_messages_in_order_whatever_it_spills():
    rng = random.Random(1)
    queue, slow_queue, out, want = SpillingQueue(limit=5, runs=3), [], [], []
    for step in range(3000):
        if rng.random() < 0.6 or not slow_queue:
            message = tuple(rng.randint(-(2**63), 2**63 - 1) if i else rng.randint(0, 9) for i in range(5))
            queue.push(message)
            slow_queue.append(message)
        else:
            slow_queue.sort()
            assert queue.first() == slow_queue[0]
            out.append(queue.pop())
            want.append(slow_queue.pop(0))
    assert out == want and queue.spilled > 1000
    assert [queue.pop() for _ in slow_queue] == sorted(slow_queue) and queue.first() is None
