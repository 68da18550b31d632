import pytest

from lexmill.plans import catalogue
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    same(spark, con, sf_dir, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sentence_chunks_cover_the_text(spark):
    from lexmill.operators.dedup import sentence_chunks

    text = "".join(f"Sentence number {i} ends here. " for i in range(200))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 3000)], "doc_id long, text string")
    parts = sentence_chunks(rows).orderBy("doc_id", "part").collect()
    mine = [p for p in parts if p.doc_id == 1]
    assert mine[0].start == 0 and mine[-1].start + len(mine[-1].chunk) == len(text)
    assert all(p.chunk.rstrip().endswith(".") for p in mine)
    assert all(b.start == a.start + len(a.chunk) - 250 for a, b in zip(mine, mine[1:]))
    assert [len(p.chunk) for p in parts if p.doc_id == 4] == [1280, 1280, 940]
    assert not [p for p in parts if p.doc_id in (2, 3)]


def test_within_edits_finds_all_pairs(spark):
    from lexmill.operators.dedup import within_edits

    names = ["", "a", "ab", "ba", "abc", "abcd", "abdc", "kitten", "sitten", "sittin", "mitten", "brand#11", "brand#12", "brand12", "and#11"]
    found = {(r.a, r.b) for r in within_edits(spark.createDataFrame([(n,) for n in names], "name string"), "name", 2).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert found == {(a, b) for a in names for b in names if a < b and edits(a, b) <= 2}
