import random

import pytest

from lexmill.operators import dictionary as d


def naive(text, phrases):
    return sorted((p, i, i + len(p)) for p in phrases for i in range(len(text) - len(p) + 1) if p and text.startswith(p, i))


def longest(spans):
    kept, last = [], 0
    for p, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            kept.append((p, a, b))
            last = b
    return sorted(kept)


TEXTS = [(1, "she sells sea shells by the sea shore"), (2, ""), (3, None), (4, "ababababab"), (5, "규정 제1조 🙂🙂 규정집"), (4, "ababababab"), (6, "nothing"), (7, "sea " * 3000)]
PHRASES = ["she", "he", "hell", "shells", "sea", "sea sh", "ab", "abab", "bab", "규정", "규정집", "🙂", "", "sea shells by the sea shore and more", "she"]


@pytest.mark.parametrize("limit", [d.LIMIT, 0])
@pytest.mark.parametrize("select", ["all", "first", "longest"])
def test_occurrences_equal_naive_search(spark, limit, select):
    texts = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, phrase string, at int")
    phrases = spark.createDataFrame([(p, i) for i, p in enumerate(PHRASES)], "phrase string, start int")
    want = []
    for i, text in TEXTS:
        spans = naive(text or "", set(PHRASES))
        if select == "first":
            spans = [min((s for s in spans if s[0] == p), key=lambda s: s[1]) for p in {s[0] for s in spans}]
        want += [(i, *s) for s in (longest(spans) if select == "longest" else spans)]
    found = d.occurrences(texts, phrases, select=select, limit=limit)
    assert found.columns == ["doc_id", "phrase", "start", "end"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_no_phrases_and_no_texts(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], "phrase string")
    assert d.occurrences(texts, none).count() == 0
    assert d.occurrences(texts.where("false"), spark.createDataFrame([("a",)], "phrase string")).count() == 0
    with pytest.raises(ValueError):
        d.occurrences(texts, none, select="best")


def test_synonyms_both_ways(spark):
    table = {"복무": ["근무", "재직", "봉직"], "일": ["근무"], "급여": ["월급", "봉급"], "월급": ["급여"], "과제": ["일"]}
    synonyms = spark.createDataFrame([(t, r, s) for t, many in table.items() for r, s in enumerate(many)], "term string, rank int, synonym string")
    queries = [(1, "복무 규정"), (2, "근무  일 월급"), (3, "월급 급여 월급"), (4, ""), (5, None), (6, "일 과제")]

    def slow(text):
        out = []
        for word in (text or "").split():
            if len(word) < 2:
                continue
            out += table.get(word, [])[:2]
            for term in sorted(table):
                if word in table[term] and term not in out:
                    out.append(term)
        return out

    rows = d.synonym_expansions(spark.createDataFrame(queries, "query_id long, text string"), synonyms).collect()
    for query, text in queries:
        assert [r.value for r in sorted(rows, key=lambda r: r.at) if r.query_id == query] == slow(text)


def test_intents(spark):
    triggers = spark.createDataFrame(
        [("leave", "휴학 하고 싶어요"), ("leave", "학교 쉬고 싶어"), ("money", "장학금"), ("money", "장학금 받으려면"), ("legacy_quit", "그만"), ("other", "?"), ("b", "장학금"), ("c", "장학금")],
        "intent_id string, trigger string",
    )
    queries = spark.createDataFrame([(1, "휴학하고 싶은데"), (2, "장학금 신청 방법"), (3, "그만 할까요?"), (4, "몰라"), (5, None), (6, "10년 장학금")], "query_id long, text string")
    found = d.match_intents(queries, triggers, [("number", r"\d+년"), ("legacy_quit", "nothing")])
    assert sorted(map(tuple, found.collect())) == [
        (1, "leave", 4, 1), (2, "b", 2, 2), (2, "c", 2, 3), (2, "money", 4, 1), (3, "legacy_quit", 3, 1), (6, "b", 2, 2), (6, "c", 2, 3), (6, "money", 4, 1),
    ]


def test_entities_rules_and_rewriting(spark):
    words = spark.createDataFrame([("benefit", "장학금", 0.9, ["장학", "성적기준"]), ("procedure", "신청", 0.85, ["제출"]), ("hypernym", "장학금", 0.75, ["재정"]), ("weak", "방법", 0.3, [])], "kind string, keyword string, confidence double, expansions array<string>")
    texts = spark.createDataFrame([(1, "장학금 신청 방법과 장학금"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, d.recognise_entities(texts, words).collect())) == [
        (1, "benefit", "장학금", 0, 3, 0.9, ["장학", "성적기준"]), (1, "hypernym", "장학금", 0, 3, 0.75, ["재정"]), (1, "procedure", "신청", 4, 6, 0.85, ["제출"]),
    ]
    rules = spark.createDataFrame([(0, "first", ["zebra", "장학"], ["a"]), (1, "second", ["신청"], ["b"])], "rule int, intent string, patterns array<string>, keywords array<string>")
    queries = spark.createDataFrame([(1, "신청 장학"), (2, "ZEBRA"), (3, "어떻게 to go 언제 by x bus now and then"), (4, "?"), (5, None)], "query_id long, text string")
    got = {r.query_id: (r.intent, r.keywords, r.confidence, r.method) for r in d.expand_by_rules(queries, rules).collect()}
    assert got == {
        1: ("first", ["a"], 0.7, "pattern"), 2: ("first", ["a"], 0.7, "pattern"), 3: ("unknown", ["to", "go", "by", "bus", "now"], 0.5, "basic"),
        4: ("unknown", ["?"], 0.5, "basic"), 5: ("unknown", [""], 0.5, "basic"),
    }


def test_rewriting_applies_rules_in_order(spark):
    rng = random.Random(9)
    sign = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randint(1, n)))
    rules = [(i, sign(3), sign(4)) for i in range(30)]
    texts = [(i, sign(40)) for i in range(60)] + [(90, None), (91, "  "), (92, "ab Formal ab")]
    first = {}
    for rule in rules:
        first.setdefault(rule[1], rule)

    def slow(text):
        text, used = (text or "").strip(), []
        for _, pattern, made in first.values():
            if "formal" in text.lower():
                break
            if pattern in text:
                text = text.replace(pattern, made)
                used.append(pattern)
        return text, used

    found = d.rewrite_by_dictionary(spark.createDataFrame(texts, "query_id long, text string"), spark.createDataFrame(rules, "rule int, pattern string, formal string"), formal=("formal",))
    assert {r.query_id: (r.rewritten, r.matched) for r in found.collect()} == {i: slow(t) for i, t in texts}
    with pytest.raises(ValueError):
        d.rewrite_by_dictionary(spark.createDataFrame(texts, "query_id long, text string"), spark.createDataFrame(rules, "rule int, pattern string, formal string"), limit=10)
