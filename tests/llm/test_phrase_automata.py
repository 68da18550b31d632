import random

import pytest

from lexmill.llm.phrase_automata import PhraseShard, remove_passages

SCHEMA = "doc_id long, text string, from string, anchor int"


def slow(rows, width):
    """By the definition: every window of every row against all windows of rows with smaller ids."""
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    firsts = {}
    for doc, words in split:
        for i in range(len(words) - width + 1 if doc is not None else 0):
            window = tuple(words[i : i + width])
            firsts[window] = min(doc, firsts.get(window, doc))
    out = []
    for doc, words in split:
        gone = {p for i in range(len(words) - width + 1 if doc is not None else 0) if firsts[tuple(words[i : i + width])] < doc for p in range(i, i + width)}
        out.append((doc, len(words), len(gone), b" ".join(w for p, w in enumerate(words) if p not in gone).decode()))
    return sorted(out, key=str)


def odd_rows(width, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passages = [[word() for _ in range(rng.choice([width - 1, width, width + 1, 3 * width]))] for _ in range(8)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 2 * width))]
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = word()
        rows.append((doc, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(7, rows[20][1]), (7, rows[20][1]), (None, rows[20][1]), (None, None), (70, None), (71, ""), (72, " \n "), (73, "x " * 5 * width), (74, "x " * 6 * width), (-5, rows[30][1])]
    rows += [(80, " ".join(f"long{i}" for i in range(20_000))), (81, " ".join(f"long{i}" for i in range(5_000, 15_000)))]
    return rows


@pytest.mark.parametrize("width, shard", [(50, 20_000), (20, 2), (7, 3)])
def test_equals_the_definition(spark, width, shard):
    rows = odd_rows(width)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    found = sorted((tuple(r) for r in remove_passages(docs, width, shard=shard).collect()), key=str)
    assert found == slow(rows, width)
    assert sum(r[2] for r in found) > 500


def test_text_ids_and_other_columns(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([("b", text), ("a", text), ("c", "y " + text)], "kept string, n_words string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_passages(docs, id_col="kept", text_col="n_words").collect()}
    assert found == {"a": (60, 0, text), "b": (60, 60, ""), "c": (61, 60, "y")}


def test_nothing(spark):
    assert remove_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    """Equal hashes confirm too much, and the automaton still reports equal words alone."""
    from lexmill.llm import phrase_automata

    monkeypatch.setattr(phrase_automata, "_hashes", type("Same", (dict,), {"__missing__": lambda self, word: 1})())
    shard = PhraseShard(10)
    shard.add(1, b" ".join(b"a%d" % i for i in range(15)))
    shard.add(2, b" ".join(b"b%d" % i for i in range(15)))
    shard.add(3, b" ".join(b"a%d" % i for i in range(3, 15)) + b" z")
    assert list(shard.located()) == [(2, [(0, 12)])]
