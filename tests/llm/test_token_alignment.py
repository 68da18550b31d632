import hashlib
import random
from collections import Counter

import pytest

from lexmill.llm import token_alignment
from lexmill.llm.token_alignment import align, common_ends, link_strength, tokenizer_pair

SCHEMA = "doc_id long, text string, n_a string, pair int"
FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def odd_rows():
    rng = random.Random(2)
    words = ["the", "Straße", "zebra", "can't", "123456", "日本語", "🙂🙂", "…", "naïve", "x" * 40, "́", "  ", "\n\n", "\t", "ﬁ"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " "), (103, "<|endoftext|> and </s><s><unk>"), (104, "under ▁ bar"), (105, "\x00\x01"), (3, rows[3][1]), (None, "some words")]
    return rows + [(106, "word " * 30_000), (107, "y" * 70_000 + " z" * 70_000)]


def slow(rows):
    """Ids of the whole texts by both libraries, ends by sets."""
    pair = tokenizer_pair(*FILES)
    found = []
    for doc, text in rows:
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pair.b.encode(text or "")
        bytes_a, bytes_b = b"".join(pair.bytes_a[i] for i in a), b"".join(pair.bytes_b[i] for i in b)
        if not text or not bytes_a == bytes_b == (" " + text).encode():
            a = b = []
        ends = []
        for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append(at)
            ends.append(out)
        links = []
        at_b = dict(zip(ends[1], range(len(b))))
        groups, p, q = [], 0, 0
        for i, end in enumerate(ends[0]):
            if end in at_b:
                j = at_b[end]
                links.append((a[i], b[j]))
                groups.append(",".join(map(str, a[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
                p, q = i + 1, j + 1
        found.append((doc, len(a), len(b), groups, links))
    counts = Counter(link for f in found for link in f[4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(
        ((doc, a, b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for doc, a, b, groups, links in found),
        key=str,
    )


@pytest.mark.parametrize("held", [1 << 21, 40, 0])
def test_equals_the_definition(spark, held):
    docs = spark.createDataFrame([(*r, "x", 1) for r in odd_rows()], SCHEMA).repartition(3)
    found = link_strength(docs, held=held)
    assert sorted(map(tuple, found.collect()), key=str) == slow(odd_rows())


def test_ids_spans_and_groups(spark):
    rows = [r for r in odd_rows() if r[0] != 107]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for r in align(docs, outputs=("spans", "groups", "ids_a", "ids_b")).collect():
        starts = [(0, 0), *((s.a_to, s.b_to) for s in r.spans)]
        parts = [",".join(map(str, r.ids_a[p:x])) + "|" + ",".join(map(str, r.ids_b[q:y])) for (p, q), (x, y) in zip(starts, starts[1:])]
        assert r.groups == ";".join(parts) and r.n_groups == len(r.spans) and starts[-1] == (r.n_a, r.n_b)


def test_long_texts_are_cut_where_both_vocabularies_cut(monkeypatch):
    pair = tokenizer_pair(*FILES)
    texts = [t for _, t in odd_rows() if t]
    whole = list(pair.encode(texts))
    monkeypatch.setattr(token_alignment, "PIECE", 7)
    assert list(pair.encode(texts)) == whole and len(pair.parts("some words of a text that is cut")) > 2


def test_both_libraries_agree_on_common_signs():
    pair = tokenizer_pair(*FILES)
    rng = random.Random(8)
    signs = [chr(i) for i in range(0x250)]
    texts = [f"a{x}b {x}{x} 1{x}2 {x}" for x in signs] + ["".join(rng.choice(signs) for _ in range(50)) for _ in range(2000)] + ["it's he'll I'VE don't  x   y\n\n z", "<|endoftext|>"]
    assert pair.fast is not None
    for text in texts:
        assert pair.fast.encode_ordinary(" " + text) == pair.a.encode(" " + text, add_special_tokens=False).ids


def test_common_ends():
    rng = random.Random(4)
    for _ in range(500):
        a, b = (sorted(rng.sample(range(1, 80), rng.randint(0, 60))) for _ in range(2))
        i, j = common_ends(a, b)
        assert [a[x] for x in i] == [b[y] for y in j] == sorted(set(a) & set(b))
    assert common_ends([10**6], list(range(0, 10**6 + 1))) == ([0], [10**6])


def test_nothing(spark):
    assert link_strength(spark.createDataFrame([], SCHEMA)).count() == 0
