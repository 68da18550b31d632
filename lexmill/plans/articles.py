"""Queries over documents read as regulations: each line that is not blank is an article, framed by its number.

``ARTICLES`` and ``articles`` derive the same rows from ``documents``, one for each such line: doc_id, its number i, title (the whole line), head
(a heading on three lines of four) and body (paragraphs, amendment notes, references and a date from which it is in force).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import articles as a
from lexmill.functions.text import token_count as tokens_of
from lexmill.plans.registry import query
from lexmill.sources.tables import spread, table

ARTICLES = """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, lang, i, trim(line) AS line, trim(line) AS title FROM l WHERE trim(line) <> ''),
n AS (SELECT doc_id, lang, i, title, line,
  CASE i % 4 WHEN 0 THEN '제 ' || i || ' 장  ' || title WHEN 1 THEN '제' || i || '절 ' || title WHEN 2 THEN '제' || i || '관 ' || title ELSE title END AS head,
  title || '의 위원장은 ' || line || ' ① 교원과 학생의 등록금 심의 (개정 ' || (2000 + i % 20) || '. ' || (i % 12 + 1) || '. ' || (i % 28 + 1) || '.) ② 제' || i || '조제' || (i % 3 + 1) || '항의 규정 (신설 '
  || (1990 + doc_id % 9) || '.3.2) [본조신설 ' || (1990 + doc_id % 9) || '.03.02.] ' || CASE WHEN i % 3 = 0 THEN '이 규정은 ' || (2001 + doc_id % 20) || '년 ' || (i % 12 + 1) || '월 ' || (i % 28 + 1) || '일부터 시행한다' ELSE '' END AS body FROM t)
"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = docs.select("doc_id", "lang", (F.col("at") + 1).alias("i"), F.trim("line").alias("line")).where("line <> ''").withColumn("title", F.col("line"))
    i, doc = F.col("i"), F.col("doc_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    head = F.when(i % 4 == 0, text("제 ", i, " 장  ", F.col("title"))).when(i % 4 == 1, text("제", i, "절 ", F.col("title"))).when(i % 4 == 2, text("제", i, "관 ", F.col("title"))).otherwise(F.col("title"))
    force = F.when(i % 3 == 0, text("이 규정은 ", 2001 + doc % 20, "년 ", i % 12 + 1, "월 ", i % 28 + 1, "일부터 시행한다")).otherwise("")
    body = text(
        F.col("title"), "의 위원장은 ", F.col("line"), " ① 교원과 학생의 등록금 심의 (개정 ", 2000 + i % 20, ". ", i % 12 + 1, ". ", i % 28 + 1, ".) ② 제", i, "조제", i % 3 + 1, "항의 규정 (신설 ",
        1990 + doc % 9, ".3.2) [본조신설 ", 1990 + doc % 9, ".03.02.] ", force,
    )
    return rows.select("doc_id", "lang", "i", "title", "line", head.alias("head"), body.alias("body"))


HEAD = "CASE WHEN regexp_matches(head, '^제\\s*\\d+\\s*장\\s+') THEN 'chapter' WHEN regexp_matches(head, '^제\\s*\\d+\\s*절\\s+') THEN 'section' WHEN regexp_matches(head, '^제\\s*\\d+\\s*관\\s+') THEN 'subsection' END"


@query(ARTICLES + f""", k AS (SELECT *, {HEAD} AS type FROM n)
SELECT doc_id, i, type, '제' || i || CASE type WHEN 'chapter' THEN '장' WHEN 'section' THEN '절' ELSE '관' END AS display_no, title FROM k WHERE type IS NOT NULL AND title <> ''""")
def article_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of chapters, sections and subsections."""
    return articles(spark, sf_dir).withColumn("h", a.head(F.col("head"))).where("h IS NOT NULL").select("doc_id", "i", "h.type", "h.display_no", "h.title")


_DATE = "'{y}-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"


@query(ARTICLES + """SELECT doc_id, i, date, type FROM (
SELECT doc_id, i, (2000 + i % 20) || '-' || lpad((i % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((i % 28 + 1)::VARCHAR, 2, '0') AS date, '개정' AS type FROM n
UNION ALL SELECT doc_id, i, (1990 + doc_id % 9) || '-03-02', '신설' FROM n)""")
def amendment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and kinds of the amendment notes of each article; the same date and kind counts once."""
    return articles(spark, sf_dir).select("doc_id", "i", F.explode(a.amendments(F.col("body"))).alias("m")).select("doc_id", "i", "m.date", "m.type")


_GROUPS = " UNION ALL ".join(f"SELECT doc_id, i, unnest(regexp_extract_all(body, '(?:{words})')) AS term, {weight}::DOUBLE AS weight FROM n" for words, weight in a.KEYWORDS)


@query(ARTICLES + f", k AS ({_GROUPS}) SELECT doc_id, i, term, max(weight) AS weight FROM k GROUP BY ALL")
def article_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keywords of each article with their weights."""
    return articles(spark, sf_dir).select("doc_id", "i", F.explode(a.keywords(F.col("body"))).alias("k")).select("doc_id", "i", "k.term", F.col("k.weight").cast("double").alias("weight"))


@query(ARTICLES + """, d AS (SELECT doc_id, (2001 + doc_id % 20) || '-' || lpad((i % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((i % 28 + 1)::VARCHAR, 2, '0') AS d FROM n WHERE i % 3 = 0)
SELECT doc_id, count(*) AS dated, max(d) AS last_revision FROM d GROUP BY doc_id""")
def last_revision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles of a document name a date from which they are in force, and the latest."""
    dated = articles(spark, sf_dir).select("doc_id", a.effective_date(F.col("body")).alias("d")).where("d IS NOT NULL")
    return dated.groupBy("doc_id").agg(F.count("*").alias("dated"), F.max("d").alias("last_revision"))


_LABEL = "coalesce(nullif(trim(regexp_extract(body, '^(.{1,30}?)(?:은|는|이란|란|의)\\s', 1)), ''), trim(regexp_extract(body, '^([^.。\\n]{1,25})', 1)))"


@query(ARTICLES + f"""SELECT doc_id, i, '제' || i || '조 ' || {_LABEL} AS label,
'[' || CASE WHEN i % 4 = 3 THEN title ELSE head || ' > ' || title END || ' > 제' || i || '조 ' || {_LABEL} || '] ' || line AS full_text FROM n""")
def article_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of articles without a title, and their text behind the path of headings; a heading equal to the next one goes."""
    from lexmill.operators.tree import full_text

    label = a.path_label(F.concat(F.lit("제"), F.col("i").cast("string"), F.lit("조")), F.lit(""), F.col("body"))
    return articles(spark, sf_dir).withColumn("label", label).select("doc_id", "i", "label", full_text(F.array("head", "title"), F.col("label"), F.col("line")).alias("full_text"))


@query(ARTICLES + """, p AS (SELECT doc_id, i, unnest(regexp_extract_all(body, '([①-⑳])([^①-⑳]*)', 1)) AS mark, trim(unnest(regexp_extract_all(body, '([①-⑳])([^①-⑳]*)', 2))) AS content, trim(regexp_extract(body, '^([^①-⑳]*)', 1)) AS preamble FROM n)
SELECT doc_id, i, mark, content, length(preamble)::INT AS preamble_chars FROM p""")
def article_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each article by their circled numerals, and how much text stands before the first."""
    before, parts = a.paragraphs(F.col("body"))
    return articles(spark, sf_dir).select("doc_id", "i", F.length(before).alias("preamble_chars"), F.inline(parts)).select("doc_id", "i", "mark", "content", "preamble_chars")


@query(ARTICLES + """SELECT doc_id, i, unnest(['제' || i || '조제' || (i % 3 + 1) || '항']) AS target FROM n WHERE NOT regexp_matches(line, '제\\s*\\d')""")
def article_reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References inside the bodies of articles."""
    return articles(spark, sf_dir).where(~F.col("line").rlike(r"제\s*\d")).select("doc_id", "i", F.explode(a.references(F.col("body"))).alias("target"))


@query(ARTICLES + """, g AS (SELECT doc_id, i, title, count(*) FILTER (i % 3 = 1) OVER (PARTITION BY doc_id ORDER BY i) AS item, i % 3 = 1 AS is_item FROM n)
SELECT doc_id, item, max(title) FILTER (is_item) AS title, count(*) FILTER (NOT is_item) AS subitems FROM g WHERE item > 0 GROUP BY doc_id, item""")
def items_with_subitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items of each document with the lettered ones below them; letters before the first number belong to none."""
    lines = articles(spark, sf_dir).select("doc_id", "i", "title", F.when(F.col("i") % 3 == 1, F.concat(F.col("i").cast("string"), F.lit(". "), "title")).otherwise(F.concat(F.lit("가. "), "title")).alias("line"))
    numbered = F.col("line").rlike(r"^\d+\.")
    carried = lines.withColumn("is_item", numbered).withColumn("item", F.count_if("is_item").over(Window.partitionBy("doc_id").orderBy("i"))).where("item > 0")
    return carried.groupBy("doc_id", "item").agg(F.max(F.when(F.col("is_item"), F.col("title"))).alias("title"), F.count_if(~F.col("is_item")).alias("subitems"))


@query(ARTICLES + """, c AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN i END AS own FROM n), f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS carried, min(own) OVER (PARTITION BY doc_id) AS earliest FROM c)
SELECT doc_id, coalesce(carried, CASE WHEN earliest >= 2 THEN 1 END) AS chapter, count(*) AS articles, min(i) AS first_article, max(i) AS last_article FROM f WHERE own IS NULL GROUP BY ALL""")
def chapters_of_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles under the chapter heading before them; those before a first heading from 2 on belong to chapter 1."""
    own = F.when(F.col("h.type") == "chapter", F.regexp_extract("h.display_no", r"(\d+)", 1).cast("int"))
    rows = articles(spark, sf_dir).withColumn("h", a.head(F.col("head"))).select("doc_id", "i", own.alias("own"))
    w = Window.partitionBy("doc_id")
    carried = rows.withColumn("carried", F.last("own", True).over(w.orderBy("i"))).withColumn("earliest", F.min("own").over(w)).where("own IS NULL")
    chapter = F.coalesce("carried", F.when(F.col("earliest") >= 2, 1))
    return carried.groupBy("doc_id", chapter.alias("chapter")).agg(F.count("*").alias("articles"), F.min("i").alias("first_article"), F.max("i").alias("last_article"))


@query(ARTICLES + """SELECT doc_id, trim(regexp_replace(title, '^[|]+|[|]+$', '', 'g')) AS title, max(i) AS last_line, arg_max((i % 5 + 1) || '-' || (doc_id % 9 + 1) || '-' || i, i) AS code FROM n WHERE title NOT LIKE '%|%' GROUP BY doc_id, 2""")
def contents_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a table of contents with their codes; of repeated titles the last line counts."""
    line = F.concat(F.lit("| "), "title", F.lit(" "), (F.col("i") % 5 + 1).cast("string"), F.lit("—"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("–"), F.col("i").cast("string"), F.lit("～12 |"))
    rows = articles(spark, sf_dir).where(~F.col("title").contains("|")).select("doc_id", "i", a.contents_line(line).alias("c")).where("c IS NOT NULL")
    return rows.groupBy("doc_id", "c.title").agg(F.max("i").alias("last_line"), F.max_by("c.code", "i").alias("code"))


_TITLED = "CASE doc_id % 6 WHEN 0 THEN ' 차례 ' WHEN 1 THEN '찾아보기' WHEN 2 THEN '규정 ' || (doc_id % 4 + 1) || '—1–' || doc_id WHEN 3 THEN source || ' 1-2' WHEN 4 THEN '' ELSE NULL END"


@query(f"""WITH t AS (SELECT doc_id, {_TITLED} AS title, CASE WHEN doc_id % 12 = 1 THEN '<가나다순>' WHEN doc_id % 12 = 7 THEN '소관부서별' END AS preamble, n_chars > 300 AS has FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 2 THEN (doc_id % 4 + 1) || '-1-' || doc_id END AS code, CASE WHEN trim(title) = '차례' THEN 'toc' WHEN preamble = '<가나다순>' THEN 'index_alpha' WHEN preamble IS NOT NULL THEN 'index_dept'
WHEN doc_id % 6 = 2 THEN 'regulation' WHEN has THEN 'note' ELSE 'unknown' END AS doc_type FROM t""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and code of documents, from their title and preamble."""
    doc = F.col("doc_id")
    code = F.concat(F.lit("규정 "), (doc % 4 + 1).cast("string"), F.lit("—1–"), doc.cast("string"))
    title = F.when(doc % 6 == 0, " 차례 ").when(doc % 6 == 1, "찾아보기").when(doc % 6 == 2, code).when(doc % 6 == 3, F.concat("source", F.lit(" 1-2"))).when(doc % 6 == 4, "")
    preamble = F.when(doc % 12 == 1, "<가나다순>").when(doc % 12 == 7, "소관부서별")
    known, kind = a.document_type(title, preamble, F.lit(None).cast("string"), F.col("n_chars") > 300)
    return table(spark, sf_dir, "documents").select("doc_id", known.alias("code"), kind.alias("doc_type"))


@query(ARTICLES + """, s AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN i || '. ' || title WHEN 1 THEN '가. ' || title WHEN 2 THEN '① ' || title WHEN 3 THEN i || ') ' || title ELSE '- ' || title END AS line FROM n),
c AS (SELECT doc_id, count(*) FILTER (i % 5 = 0) AS numbers, count(*) FILTER (i % 5 = 1) AS letters, count(*) FILTER (i % 5 = 2) AS circles, count(*) FILTER (i % 5 = 3) AS brackets FROM s GROUP BY doc_id)
SELECT *, CASE WHEN (numbers > 0)::INT + (letters > 0)::INT + (circles > 0)::INT > 1 THEN 'mixed' WHEN numbers > 0 THEN 'numeric' WHEN letters > 0 THEN 'korean' WHEN circles > 0 THEN 'circled' WHEN brackets > 0 THEN 'bracket' ELSE 'none' END AS pattern FROM c""")
def list_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which marks the lists of a document use: counts by mark over all of its lines, and the pattern."""
    i, title = F.col("i"), F.col("title")
    mark = F.when(i % 5 == 0, F.concat(i.cast("string"), F.lit(". "))).when(i % 5 == 1, "가. ").when(i % 5 == 2, "① ").when(i % 5 == 3, F.concat(i.cast("string"), F.lit(") "))).otherwise("- ")
    texts = articles(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.collect_list(F.concat(mark, title)), "\n").alias("text"))
    counts, kind = a.list_pattern(F.col("text"))
    return texts.select("doc_id", *(c.cast("long").alias(n) for c, n in zip(counts, ("numbers", "letters", "circles", "brackets"))), kind.alias("pattern"))


@query(ARTICLES + """SELECT doc_id, i, left(md5('R' || doc_id || ':article:제' || i || '조:' || title), 16) AS chunk_id, '제' || i || '조' AS article_number, 'R' || doc_id || ' > ' || title AS parent_path,
CASE WHEN length(body) = 0 THEN 0 ELSE greatest(1, floor(length(body) / 2.5)) END::BIGINT AS token_count, CASE WHEN i % 7 = 0 THEN 'abolished' ELSE 'active' END AS status, len(regexp_extract_all(body, '위원장|위원')) > 0 AS has_keywords FROM n""")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of articles through their flat form and back: id, path, keywords as JSON, status from the title, token count."""
    doc = F.concat(F.lit("R"), F.col("doc_id").cast("string"))
    number = F.concat(F.lit("제"), F.col("i").cast("string"), F.lit("조"))
    named = F.when(F.col("i") % 7 == 0, F.concat("title", F.lit("【폐지】"))).otherwise(F.col("title"))
    flat = articles(spark, sf_dir).select(
        "doc_id", "i", a.chunk_id(doc, F.lit("article"), number, F.col("title")).alias("chunk_id"), number.alias("article_number"), F.array_join(F.array(doc, "title"), " > ").alias("path"),
        F.to_json(a.keywords(F.col("body"))).alias("keywords"), F.when(named.contains("폐지"), "abolished").otherwise("active").alias("status"), tokens_of(F.col("body")).alias("token_count"),
    )
    back = F.from_json("keywords", "array<struct<term string, weight double>>")
    return flat.select("doc_id", "i", "chunk_id", "article_number", F.array_join(F.split("path", " > "), " > ").alias("parent_path"), "token_count", "status", F.coalesce(F.size(back) > 0, F.lit(False)).alias("has_keywords"))


@query(ARTICLES + """, o AS (SELECT doc_id, i, CASE i % 4 WHEN 0 THEN 'chapter' WHEN 1 THEN 'section' WHEN 2 THEN 'subsection' ELSE 'article' END AS level FROM n WHERE title <> '')
SELECT doc_id, level, count(*) AS markers, min(i) AS first_at, max(i) AS last_at FROM o GROUP BY doc_id, level""")
def structure_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that the headings of a document reach, with the first and last line of each."""
    level = F.coalesce(a.head(F.col("head"))["type"], F.lit("article"))
    return articles(spark, sf_dir).groupBy("doc_id", level.alias("level")).agg(F.count("*").alias("markers"), F.min("i").alias("first_at"), F.max("i").alias("last_at"))
