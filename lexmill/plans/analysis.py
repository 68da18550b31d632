"""Texts of ``documents`` analysed as queries, with dictionaries made of the words of ``benchmark``, whole texts on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import upper
from lexmill.operators import dictionary as d
from lexmill.plans.registry import query
from lexmill.sources.tables import spread, table

WORDS = """WITH w AS (SELECT item_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS e FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)) WHERE w[i] <> ''),
p AS (SELECT item_id, i, a || ' ' || b AS pair, a, b FROM w WHERE b <> '')"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, i from 1, a, b, c, e): each word of the benchmark texts and the three that follow it."""
    split = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    at = split.select("item_id", "w", F.posexplode("w").alias("p", "a")).where("a <> ''")
    return at.select("item_id", (F.col("p") + 1).alias("i"), "a", *(F.get("w", F.col("p") + k).alias(n) for k, n in ((1, "b"), (2, "c"), (3, "e"))))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).where("b <> ''").select("item_id", "i", F.concat_ws(" ", "a", "b").alias("pair"), "a", "b")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(WORDS + """, g AS (SELECT 'pair' AS kind, pair AS keyword, 0.95 AS confidence, min(a) || ',' || min(b) AS expansions FROM p GROUP BY pair
UNION ALL SELECT 'word', a, 0.75, upper(a) FROM w WHERE length(a) >= 8 GROUP BY a)
SELECT doc_id, kind, keyword, CAST(instr(text, keyword) - 1 AS INT) AS start, CAST(instr(text, keyword) - 1 + length(keyword) AS INT) AS "end", CAST(confidence AS DOUBLE) AS confidence, expansions
FROM documents JOIN g ON contains(text, keyword)""")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each word pair and long word of the benchmark in each document; entries of little confidence are left out."""
    p, w = pairs(spark, sf_dir), words(spark, sf_dir).where(F.length("a") >= 8)
    entry = lambda rows, kind, keyword, confidence, *terms: rows.groupBy(F.col(keyword).alias("keyword")).agg(F.array(*(F.min(t) for t in terms)).alias("expansions")).select(F.lit(kind).alias("kind"), "keyword", F.lit(confidence).alias("confidence"), "expansions")
    short = words(spark, sf_dir).where(F.length("a") < 4)
    dictionary = entry(p, "pair", "pair", 0.95, "a", "b").unionByName(entry(w.withColumn("u", upper("a")), "word", "a", 0.75, "u")).unionByName(entry(short, "short", "a", 0.2, "a"))
    return d.recognise_entities(texts(spark, sf_dir), dictionary).withColumn("expansions", F.array_join("expansions", ","))


@query()
def phrase_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the word pairs and long words of the benchmark cover, longest first from left to right."""
    phrases = pairs(spark, sf_dir).select(F.col("pair").alias("phrase")).unionByName(words(spark, sf_dir).where(F.length("a") >= 8).select(F.col("a").alias("phrase")))
    found = d.occurrences(texts(spark, sf_dir), phrases, select="longest")
    return found.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.min("start").alias("first"), F.max("end").alias("last"))


_SYNONYMS = """, f AS (SELECT lower(a) AS term, arg_min([lower(b), lower(c), lower(e)], item_id * 100000 + i) AS s FROM w GROUP BY 1),
s AS (SELECT * FROM (SELECT term, unnest(s) AS synonym, unnest([0, 1, 2]) AS rank FROM f) WHERE synonym <> ''),
t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS q FROM documents), q AS (SELECT doc_id, unnest(q) AS word, generate_subscripts(q, 1) AS pos FROM t),
x AS (SELECT doc_id, pos, 0 AS way, rank, term AS origin, synonym AS value FROM q JOIN s ON word = term WHERE length(word) >= 2 AND rank < 2
UNION ALL SELECT doc_id, pos, 1, 0, term, term FROM q JOIN (SELECT DISTINCT term, synonym FROM s) ON word = synonym WHERE length(word) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY pos, way, rank, origin) AS nth FROM x)"""


@query(WORDS + _SYNONYMS + """SELECT doc_id, count(*) AS expansions, count(*) FILTER (way = 1) AS reversed, md5(string_agg(value, ' ' ORDER BY pos, way, rank, origin)) AS digest FROM k WHERE way = 0 OR nth = 1 GROUP BY doc_id""")
def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansions of the words of each document by a table of synonyms read both ways, in order."""
    named = words(spark, sf_dir).select(F.lower("a").alias("term"), F.array(*(F.lower(n) for n in "bce")).alias("s"), (F.col("item_id") * 100000 + F.col("i")).alias("at"))
    table_ = named.groupBy("term").agg(F.min_by("s", "at").alias("s")).select("term", F.posexplode("s").alias("rank", "synonym")).where("synonym <> ''")
    rows = d.synonym_lists(texts(spark, sf_dir), table_, "doc_id").where(F.size("all") > 0)
    reversed_ = F.size(F.filter("all", lambda x: x["way"] == 1)).cast("long")
    digest = F.md5(F.array_join(F.transform("all", lambda x: x["value"]), " ").cast("binary"))
    return rows.select("doc_id", F.size("all").cast("long").alias("expansions"), reversed_.alias("reversed"), digest.alias("digest"))


#: Regular expressions of three intents, beside those with triggers.
PATTERNS = [("numbers", r"[0-9]{6,}"), ("addresses", r"@[a-z]+"), ("tables", r"\|")]
_READY = f"regexp_replace(regexp_replace(nfc_normalize({{}}), '\\s+', '', 'g'), '{d.ENDINGS}', '')"


@query(WORDS + f""", r AS (SELECT CASE WHEN item_id % 4 = 0 THEN 'legacy_' ELSE 'i' END || item_id AS intent_id, {_READY.format('pair')} AS t FROM p WHERE i % 5 = 1),
q AS (SELECT doc_id, text, {_READY.format('text')} AS n FROM documents),
m AS (SELECT doc_id, intent_id, CASE WHEN t = n THEN 4 ELSE 2 END AS points FROM q JOIN r ON t <> '' AND contains(n, t)
{' '.join(f"UNION ALL SELECT doc_id, '{i}', 2 FROM q WHERE regexp_matches(text, '{p}')" for i, p in PATTERNS)}),
s AS (SELECT doc_id, intent_id, CAST(sum(points) - CASE WHEN intent_id LIKE 'legacy\\_%' ESCAPE '\\' THEN 1 ELSE 0 END AS BIGINT) AS score FROM m GROUP BY doc_id, intent_id),
b AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, intent_id) AS place FROM b WHERE best < 2 OR score >= 2)
SELECT doc_id, intent_id, score, CAST(place AS INT) AS place FROM o WHERE place <= 3""")
def intent_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best intents of each document: triggers from the benchmark and three regular expressions."""
    name = F.concat(F.when(F.col("item_id") % 4 == 0, "legacy_").otherwise("i"), F.col("item_id").cast("string"))
    triggers = pairs(spark, sf_dir).where("i % 5 = 1").select(name.alias("intent_id"), F.col("pair").alias("trigger"))
    return d.match_intents(texts(spark, sf_dir), triggers, PATTERNS, "doc_id")


_STOP = ", ".join(f"'{w}'" for w in d.PARTICLES)


@query(WORDS + f""", u AS (SELECT item_id AS rule, lower(pair) AS pattern FROM p WHERE i % 9 = 3), k AS (SELECT item_id AS rule, string_agg(a, ' ' ORDER BY i) AS keywords FROM w WHERE i <= 3 GROUP BY item_id),
q AS (SELECT doc_id, coalesce(text, '') AS raw, (SELECT min(rule) FROM u WHERE contains(lower(coalesce(text, '')), pattern)) AS rule FROM documents),
o AS (SELECT *, list_filter(regexp_extract_all(raw, '[가-힣A-Za-z0-9]+'), LAMBDA x: length(x) >= 2 AND x NOT IN ({_STOP})) AS own FROM q)
SELECT doc_id, CASE WHEN o.rule IS NULL THEN 'unknown' ELSE 'intent ' || o.rule END AS intent, CASE WHEN o.rule IS NOT NULL THEN keywords WHEN len(own) > 0 THEN array_to_string(own[1:5], ' ') ELSE raw END AS keywords,
CAST(CASE WHEN o.rule IS NULL THEN 0.5 ELSE 0.7 END AS DOUBLE) AS confidence, CASE WHEN o.rule IS NULL THEN 'basic' ELSE 'pattern' END AS method FROM o LEFT JOIN k ON o.rule = k.rule""")
def rule_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each document from the first rule that one of its patterns fits, or from its own words."""
    patterns = pairs(spark, sf_dir).where("i % 9 = 3").groupBy("item_id").agg(F.collect_set(F.lower("pair")).alias("patterns"))
    keywords = words(spark, sf_dir).where("i <= 3").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]).alias("keywords"))
    rules = patterns.join(keywords, "item_id").select(F.col("item_id").cast("int").alias("rule"), F.concat(F.lit("intent "), F.col("item_id").cast("string")).alias("intent"), "patterns", "keywords")
    return d.expand_by_rules(texts(spark, sf_dir), rules, "doc_id").withColumn("keywords", F.array_join("keywords", " "))


@query(WORDS + """, r AS (SELECT pair, min(item_id * 1000 + i) AS rule, min(b) || '_' || min(a) AS formal FROM p WHERE i % 6 = 2 GROUP BY pair),
z AS (SELECT list({'t': '', 'p': pair, 'f': formal, 'n': 0} ORDER BY rule) AS rules FROM r),
o AS (SELECT doc_id, list_reduce(list_prepend({'t': regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), 'p': '', 'f': '', 'n': 0}, rules),
LAMBDA x, y: {'t': replace(x.t, y.p, y.f), 'p': '', 'f': '', 'n': x.n + CAST(contains(x.t, y.p) AS INT)}) AS o, text FROM documents, z)
SELECT doc_id, CASE WHEN contains(lower(text), 'token = ') THEN md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ELSE md5(o.t) END AS digest, CASE WHEN contains(lower(text), 'token = ') THEN 0 ELSE o.n END AS rules FROM o""")
def rewritten_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten by an ordered dictionary, each rule on what the earlier ones made; texts with a formal word stay."""
    order = (F.col("item_id") * 1000 + F.col("i")).alias("rule")
    rules = pairs(spark, sf_dir).where("i % 6 = 2").select(order, "pair", "a", "b").groupBy(F.col("pair").alias("pattern")).agg(F.min("rule").cast("int").alias("rule"), F.concat(F.min("b"), F.lit("_"), F.min("a")).alias("formal"))
    made = d.rewrite_by_dictionary(texts(spark, sf_dir), rules, "doc_id", formal=("token = ",))
    return made.select("doc_id", F.md5(F.col("rewritten").cast("binary")).alias("digest"), F.size("matched").alias("rules"))
