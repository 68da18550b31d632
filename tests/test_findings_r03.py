"""Faults that the third review found."""

import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

from lexmill.plans import catalogue


def lineitem(folder, rows, files=5):
    """Rows (l_orderkey, l_partkey, l_linenumber, l_discount, l_quantity), dealt in order over several files, later ones larger."""
    (folder / "lineitem.parquet").mkdir(parents=True)
    cuts = [len(rows) * i * i // files**2 for i in range(files + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        keys, parts, lines, discounts, sizes = zip(*rows[a:b])
        table = {"l_orderkey": pa.array(keys, pa.int64()), "l_partkey": pa.array(parts, pa.int64()), "l_linenumber": pa.array(lines, pa.int32()), "l_discount": discounts, "l_quantity": sizes, "l_returnflag": ["N"] * (b - a)}
        pq.write_table(pa.table(table), folder / "lineitem.parquet" / f"part-{i}.parquet")
    return str(folder)


def test_answer_sources_takes_the_first_of_equal_copies(spark, tmp_path):
    rows = [(q, 7, 1, 0.05, float(size)) for size in (20, 5, 30, 3) for q in range(300)]
    found = catalogue.QUERIES["answer_sources"](spark, lineitem(tmp_path, rows)).collect()
    assert len(found) == 300 and not any(r.low_signal for r in found)


def test_merged_lists_adds_scores_in_the_order_of_the_table(spark, tmp_path):
    deal = random.Random(1)
    rows = []
    for q in range(400):
        half = [deal.randrange(1, 10) for _ in range(3)]
        rows += [(q, i, i + 1, d / 100, 20.0) for i, d in enumerate(half + [10 - d for d in half])]
    deal.shuffle(rows)
    sums = defaultdict(float)
    for q, _, _, discount, _ in rows:
        sums[q] += discount * 10
    found = catalogue.QUERIES["merged_lists"](spark, lineitem(tmp_path, rows)).where("doc_id = 0").collect()
    scores = {(q, round(d * 10 * (0.7 if sums[q] / 6 > 0.5 else 0.5), 9)) for q, i, _, d, _ in rows if i == 0}
    assert {(r.query_id, r.score) for r in found} <= scores and len({sums[q] / 6 > 0.5 for q in sums}) == 2


def test_upper_case_sign_by_sign(spark):
    import duckdb
    from pyspark.sql import functions as F

    from lexmill.functions.text import upper

    texts = ["Straße", "ŉ ǰ", "ﬁn", "ᾳ ᾈ ΐ", "és\nß,pf", "", "plain", "ßßaß"]
    found = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(upper("t").alias("u")).collect()
    assert [r.u for r in found] == [duckdb.execute("SELECT upper(?)", [t]).fetchall()[0][0] for t in [*texts, None]]
    every = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
    assert spark.range(1).select(upper(F.lit(every)).alias("u")).first().u == duckdb.execute("SELECT upper(?)", [every]).fetchall()[0][0]


def test_vectors_meet_queries_as_matrices(spark):
    from pyspark.sql import functions as F

    from lexmill.operators import ranking

    deal = random.Random(3)
    rows = [(i, [deal.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], i % 3 or None) for i in range(400)]
    rows[5], rows[6], rows[8], rows[9] = (5, None, 1), (6, [0.0] * 4, 1), (8, [1.0, None, 1.0, 1.0], 1), (9, [1.0, 2.0], 1)
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>, label int").repartition(3, "doc_id")
    queries = vectors.where("doc_id % 40 = 0 OR doc_id IN (5, 6)").select(F.col("doc_id").alias("query_id"), "embedding", F.when(F.col("doc_id") % 80 == 40, F.col("label")).alias("only"))
    found = ranking.cosine_top_k(vectors, queries, 7)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    score = F.round(ranking.cosine(F.col("asked"), F.col("embedding")), 9)
    pairs = vectors.crossJoin(F.broadcast(queries.select("query_id", F.col("embedding").alias("asked"), "only"))).where("doc_id <> query_id AND (only IS NULL OR label = only)")
    want = ranking.top_k(pairs.select("query_id", "doc_id", score.alias("score")), 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "score", "rank").collect()))
    least = ranking.cosine_top_k(vectors, queries.drop("only"), 7, threshold=0.9).collect()
    assert least and all(r.score >= 0.9 for r in least)


def test_jaccard_pairs_are_all_pairs(spark):
    from lexmill.operators.dedup import jaccard_pairs

    deal = random.Random(5)
    texts = []
    for base in range(12):
        words = [f"w{deal.randrange(60)}" for _ in range(deal.choice([3, 9, 25, 40]))]
        for _ in range(5):
            texts.append(" ".join(w if deal.random() > 0.06 else f"x{deal.randrange(500)}" for w in words))
    texts += ["", "- -", texts[0]]
    found = {(r.a, r.b, r.jaccard) for r in jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.8).collect()}
    sets = {i: set(t.split()) for i, t in enumerate(texts) if t not in texts[:i] and t.strip("- ")}
    want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert found == want and len(want) > 20


def test_synonyms_are_looked_up_where_the_text_is(spark):
    from lexmill.operators.dictionary import synonym_expansions

    synonyms = spark.createDataFrame([("aa", 0, "bb"), ("aa", 1, "cc"), ("aa", 2, "dd"), ("bb", 0, "aa"), ("ee", 0, "bb"), ("dd", 0, "ee")], "term string, rank int, synonym string")
    queries = spark.createDataFrame([(1, "aa bb  bb cc"), (2, " dd ee a aa "), (3, None), (4, "bb dd\nbb aa")], "query_id long, text string")
    near, far = (synonym_expansions(queries, synonyms, limit=n) for n in (1 << 20, 0))
    assert near.schema.names == far.schema.names and sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    twice = queries.unionByName(queries)
    assert sorted(map(tuple, synonym_expansions(twice, synonyms).collect())) == sorted(map(tuple, synonym_expansions(twice, synonyms, limit=0).collect()))


def test_hits_are_ranked_once_and_words_read_for_them_alone(spark, sf_dir):
    plan = catalogue.QUERIES["faithfulness_overlap"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "LeftSemi" in plan


def passes(frame):
    """How often the plan scans the column t for all matches of a pattern."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("regexp_extract_all(t#")


def test_paragraphs_are_found_in_one_pass(spark):
    from pyspark.sql import functions as F

    from lexmill.functions import articles as a

    texts = [" pre ① one  ②two\n2 ⑳ x ㉑ y ①", "no marks ", "", "⑫⑬", None]
    before, parts = a.paragraphs(F.col("t"))
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(before.alias("b"), parts.alias("p"))
    found = [(r.b, r.p and [tuple(x) for x in r.p]) for r in frame.collect()]
    assert found == [("pre", [("①", "one"), ("②", "two\n2"), ("⑳", "x ㉑ y"), ("①", "")]), ("no marks", []), ("", []), ("", [("⑫", ""), ("⑬", "")]), (None, None)]
    # a list of signs in place of their range is compared sign by sign
    assert passes(frame) == 1 and "①②" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert catalogue.QUERIES["article_paragraphs"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism



def test_amendments_are_found_in_one_pass(spark):
    import re

    from pyspark.sql import functions as F

    from lexmill.functions import articles as a

    texts = [
        "x (개정 2001. 2. 3.) (신설 2001.2.3) [본조신설 2001.02.03.] (삭제 1999 . 12 . 1 . ) (개정 2001.2.3)", "(개정 (신설 2000.1.1) 2001.1.1)", "[본조신설1998.3.2] (신설 1998.3.2 (삭제 98.1.1)", "", None,
    ]

    def plainly(text):
        every = sorted((f"{y}-{int(m):02}-{int(d):02}", order, kind) for order, (p, kind) in enumerate(a.AMENDMENTS) for y, m, d in re.findall(p, text))
        return [x for i, x in enumerate(every) if (x[0], x[2]) not in {(y[0], y[2]) for y in every[:i]}]

    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(a.amendments(F.col("t")).alias("m"))
    assert [r.m and [tuple(x) for x in r.m] for r in frame.collect()] == [t and plainly(t) if t else ([] if t == "" else None) for t in texts]
    assert passes(frame) == 1



def test_keywords_are_looked_for_in_korean_runs(spark):
    import re

    from pyspark.sql import functions as F

    from lexmill.functions import articles as a

    texts = ["위원장은 대학원 학생의 등록금 심의", "이 사 감x사 교원교수 시행일시행", "plain", "", "가위원힣 直 직원ㄱ강사", None]

    def plainly(text):
        return sorted({(-w, t) for words, w in a.KEYWORDS for t in re.findall(words, text)})

    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(a.keywords(F.col("t")).alias("k"))
    assert [r.k and [(-k.weight, k.term) for k in r.k] for r in frame.collect()] == [plainly(t) if t else ([] if t == "" else None) for t in texts]
    assert passes(frame) == 1


def test_only_long_keys_are_composed_chunk_by_chunk(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lexmill.operators import scan

    deal, written, cut = random.Random(7), [], scan.cut

    def counting(frame):
        written.append(frame.count())
        return cut(frame)

    monkeypatch.setattr(scan, "cut", counting)
    rows = [(k, at, deal.random() < 0.4) for k in [None, *range(50)] for at in range(3 if k else 20)]
    found = scan.counted(spark.createDataFrame(rows, "k int, at long, f boolean"), ["k"], "at", {"n": F.col("f")}, chunk=8).collect()
    sums = defaultdict(int)
    want = {(k, at): sums.__setitem__(k, sums[k] + f) or sums[k] for k, at, f in rows}
    assert {(r.k, r.at): r.n for r in found} == want and len(found) == len(rows)
    # the rows, then three chunks of each of the two long keys
    assert written == [len(rows), 6]


def test_overlaps_are_counted_where_the_text_is(spark, monkeypatch):
    from lexmill.plans import text

    deal = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["a"]
    draw = lambda: " ".join(deal.choices(words, k=deal.randrange(12)))
    # an id that repeats in one language and in two, and null ids
    rows = [(i, deal.choice(["en", None]), draw()) for i in [*range(300), 5, 5, 7, None, None]] + [(400, "en", None)]
    asked = [(i, draw()) for i in range(40)] + [(3, draw()), (None, "w1 w2 w3 w4"), (50, "a")]
    hits = defaultdict(int)
    terms = {(q, w) for q, t in asked for w in t.split() if len(w) > 1}
    for d, _, w in {(d, lang, w) for d, lang, t in rows for w in (t or "").split() if len(w) > 1}:
        for q, x in terms:
            hits[q, d] += x == w
    want = {q: (sum(n >= 3 for (p, _), n in hits.items() if p == q), sum(n > 0 for (p, _), n in hits.items() if p == q)) for q, _ in terms}
    texts = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    queries = spark.createDataFrame(asked, "item_id long, text string")
    for pairs, known in ((1_000_000, 1000), (7, 1000), (7, 3)):
        monkeypatch.setattr(text, "PAIRS", pairs)
        monkeypatch.setattr(text, "KNOWN_TERMS", known)
        assert {r.item_id: (r.relevant, r.touched) for r in text.overlaps(texts, queries).collect()} == want
    monkeypatch.setattr(text, "KNOWN_TERMS", 1000)
    once = text.overlaps(texts.where("doc_id > 10 AND doc_id < 300"), queries)
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()
