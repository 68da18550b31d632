"""Structure of ``documents`` read line by line: every line is whole and gets the mark of a regulation's line before or behind it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import lines as m
from lexmill.plans.registry import query
from lexmill.sources.tables import spread, table



def named(sql: str) -> str:
    """The column ``at`` in quotes, which the other engine asks for."""
    return re.sub(r"\bat\b", '"at"', sql)


#: What stands before a line, by (at + doc_id) % 16; # is at % 4 + 1.
MARKS = ("제#장 ", "제#조(목적) ", "", "① ", "1. ", "가. ", "", "제#조 ① ", "제#절 ", "2. ", "", "부 칙 ", "② ", "제1조 ", "| ", "제#관 ")

_MARK = "CASE (at + doc_id) % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(MARKS) if x) + " ELSE '' END"
LINES = f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS at FROM documents),
l AS MATERIALIZED (SELECT doc_id, at, regexp_replace(replace({_MARK}, '#', CAST(at % 4 + 1 AS VARCHAR)) || raw || CASE WHEN (at + doc_id) % 16 = 10 THEN ' 규정' ELSE '' END, '^\\s+|\\s+$', '', 'g') AS line FROM s)"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    place = (F.col("at") + F.col("doc_id")) % 16
    mark = F.get(F.array(*(F.lit(x) for x in MARKS)), place.cast("int"))
    line = F.concat(F.replace(mark, F.lit("#"), (F.col("at") % 4 + 1).cast("string")), "raw", F.when(place == 10, " 규정").otherwise(""))
    return split.select("doc_id", "at", F.regexp_replace(line, r"^\s+|\s+$", "").alias("line"))


@query(named(LINES + f""", k AS MATERIALIZED (SELECT *, line = '' OR regexp_matches(line, '{m.HEADER}') OR regexp_matches(line, '{m.LIST_ITEM}') AS alone, regexp_matches(line, '[.?!]$') AS ends, line LIKE '|%' AS bar FROM l),
r AS (SELECT doc_id, at, line, 1 AS n, NOT alone AND NOT ends AND NOT bar AS waits FROM k WHERE at = 0
UNION ALL SELECT k.doc_id, k.at, k.line, r.n + CAST(k.alone OR NOT r.waits AS INT), NOT k.alone AND NOT k.ends AND NOT (k.bar AND NOT r.waits) FROM r JOIN k ON k.doc_id = r.doc_id AND k.at = r.at + 1),
j AS (SELECT doc_id, n, min(at) AS first_at, string_agg(line, ' ' ORDER BY at) AS line FROM r GROUP BY doc_id, n)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(first_at AS INT) AS first_at, length(line) AS chars, md5(line) AS digest FROM j"""))
def joined_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document, with those joined that were broken inside a sentence."""
    found = m.joined_lines(marked_lines(spark, sf_dir))
    return found.select("doc_id", "n", "first_at", F.length("line").cast("long").alias("chars"), F.md5(F.col("line").cast("binary")).alias("digest"))


_KINDS = f"""CASE WHEN regexp_matches(trim(replace(line, '|', '')), '{m.PART}') THEN 'part' WHEN regexp_matches(line, '{m.CHAPTER}') THEN 'chapter' WHEN regexp_matches(line, '{m.SECTION}') THEN 'section'
WHEN regexp_matches(line, '{m.SUBSECTION}') THEN 'subsection' WHEN regexp_matches(line, '{m.CONTENTS}') THEN 'contents' WHEN regexp_matches(line, '{m.INDEX}') AND length(line) < 20 THEN 'index'
WHEN regexp_matches(line, '{m.ARTICLE}') THEN 'article' WHEN regexp_matches(line, '{m.APPENDIX}') THEN 'appendix' WHEN regexp_matches(line, '{m.PARAGRAPH}') THEN 'paragraph'
WHEN regexp_matches(line, '{m.ITEM}') THEN 'item' WHEN regexp_matches(line, '{m.SUBITEM}') THEN 'subitem' ELSE 'text' END"""
#: One line after the other with all that is remembered: mode, regulation, headings, article, paragraph, item.
PARSED = LINES + f""", k AS MATERIALIZED (SELECT doc_id, at, line, row_number() OVER (PARTITION BY doc_id ORDER BY at) AS nth, {_KINDS} AS kind,
regexp_matches(line, '^제\\s*1\\s*조') AND NOT regexp_matches(line, '^제\\s*1\\s*조\\s*의') AS first, regexp_matches(regexp_extract(line, '{m.ARTICLE}', 5), '^[①-⑮]') AS with_p,
regexp_matches(line, '({'|'.join(m.TITLE_ENDS)})$') OR (contains(line, '규정') AND NOT contains(line, '시행한다') AND NOT regexp_matches(line, '^\\d+\\.') AND NOT line LIKE '부%') AS title FROM l WHERE line <> ''),
b AS (SELECT doc_id, 0 AS nth, -1 AS at, '' AS line, '' AS kind, FALSE AS title, 'preamble' AS mode, '' AS old_mode, FALSE AS held, 0 AS regulation, FALSE AS split, NULL::VARCHAR AS chapter, NULL::VARCHAR AS section, NULL::BIGINT AS article, NULL::BIGINT AS paragraph, NULL::BIGINT AS item FROM k WHERE nth = 1),
r AS (SELECT * FROM b UNION ALL SELECT doc_id, nth, at, line, kind, title,
CASE WHEN stop THEN 'preamble' WHEN kind = 'article' THEN 'article' WHEN kind = 'appendix' THEN 'appendix' ELSE mode END, mode, kind = 'article' OR held AND NOT stop, regulation + CAST(stop OR split AS INT), split,
CASE WHEN kind = 'chapter' THEN trim(regexp_extract(line, '{m.CHAPTER}', 1)) || rtrim(' ' || trim(regexp_extract(line, '{m.CHAPTER}', 2))) WHEN stop OR split OR kind = 'appendix' THEN NULL ELSE chapter END,
CASE WHEN kind = 'section' THEN line WHEN stop OR split OR kind IN ('appendix', 'chapter') THEN NULL ELSE section END,
CASE WHEN kind = 'article' THEN at * 4 WHEN stop OR kind = 'appendix' THEN NULL ELSE article END,
CASE WHEN kind = 'article' THEN CASE WHEN with_p THEN at * 4 + 1 END WHEN stop OR kind = 'appendix' THEN NULL WHEN mode = 'article' AND (kind = 'paragraph' OR kind = 'item' AND paragraph IS NULL) THEN at * 4 + 1 ELSE paragraph END,
CASE WHEN kind = 'article' OR stop OR kind = 'appendix' THEN NULL WHEN mode = 'article' AND kind = 'item' THEN at * 4 + 2 WHEN mode = 'article' AND kind = 'paragraph' THEN NULL ELSE item END
FROM (SELECT k.*, k.kind IN ('part', 'contents', 'index') AS stop, k.kind = 'article' AND k.first AND r.held AS split, r.mode, r.held, r.regulation, r.chapter, r.section, r.article, r.paragraph, r.item FROM r JOIN k ON k.doc_id = r.doc_id AND k.nth = r.nth + 1)),
p AS (SELECT *, CASE WHEN kind IN ('part', 'chapter', 'section', 'subsection') THEN 'heading' ELSE mode END AS stands FROM r WHERE nth > 0),
c AS (SELECT doc_id, regulation, max(at) FILTER (stands = 'appendix' AND title AND length(line) < 100) AS title FROM p GROUP BY doc_id, regulation),
v AS (SELECT c.doc_id, c.regulation, c.title FROM c JOIN p ON p.doc_id = c.doc_id AND p.regulation = c.regulation + 1 AND p.split AND p.old_mode = 'appendix' WHERE c.title IS NOT NULL),
o AS (SELECT p.doc_id, p.at, p.line, p.kind, CASE WHEN stands = 'appendix' AND p.at >= v.title THEN 'preamble' ELSE stands END AS place, p.regulation + CAST(coalesce(stands = 'appendix' AND p.at >= v.title, FALSE) AS INT) AS regulation,
chapter, section, CASE WHEN stands = 'article' THEN article END AS article, CASE WHEN stands = 'article' THEN paragraph END AS paragraph, CASE WHEN stands = 'article' THEN item END AS item FROM p LEFT JOIN v ON p.doc_id = v.doc_id AND p.regulation = v.regulation)
"""


@query(named(PARSED + """SELECT doc_id, CAST(at AS BIGINT) AS at, kind, place, CAST(regulation AS BIGINT) AS regulation, chapter, section, article, paragraph, item FROM o"""))
def regulation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every line of each document is, and the regulation, headings and nodes that it belongs to."""
    return m.parsed_lines(marked_lines(spark, sf_dir)).drop("line", "part", "subsection")


@query(named(PARSED + f""", q AS (SELECT *, ltrim(regexp_extract(line, '{m.ARTICLE}', 5)) AS content, kind = 'subitem' AND item IS NOT NULL AS sub FROM o WHERE article IS NOT NULL),
n AS (SELECT doc_id, at * 4 AS node, NULL::BIGINT AS parent, 'article' AS kind, regexp_extract(line, '{m.ARTICLE}', 1) AS display_no, at, CASE WHEN regexp_matches(content, '{m.PARAGRAPH}') THEN '' ELSE content END AS text FROM q WHERE kind = 'article'
UNION ALL SELECT doc_id, at * 4 + 1, article, 'paragraph', regexp_extract(content, '{m.PARAGRAPH}', 1), at, regexp_extract(content, '{m.PARAGRAPH}', 2) FROM q WHERE kind = 'article' AND regexp_matches(content, '{m.PARAGRAPH}')
UNION ALL SELECT doc_id, at * 4 + 1, article, 'paragraph', regexp_extract(line, '{m.PARAGRAPH}', 1), at, regexp_extract(line, '{m.PARAGRAPH}', 2) FROM q WHERE kind = 'paragraph'
UNION ALL SELECT doc_id, at * 4 + 1, article, 'paragraph', '', at, '' FROM q WHERE kind = 'item' AND paragraph = at * 4 + 1
UNION ALL SELECT doc_id, at * 4 + 2, paragraph, 'item', regexp_extract(line, '{m.ITEM}', 1), at, regexp_extract(line, '{m.ITEM}', 2) FROM q WHERE kind = 'item'
UNION ALL SELECT doc_id, at * 4 + 3, item, 'subitem', regexp_extract(line, '{m.SUBITEM}', 1), at, regexp_extract(line, '{m.SUBITEM}', 2) FROM q WHERE sub),
x AS (SELECT doc_id, coalesce(paragraph, article) AS node, string_agg(CASE WHEN paragraph IS NULL THEN chr(10) WHEN line LIKE '|%' THEN chr(10) ELSE ' ' END || line, '' ORDER BY at) AS more FROM q WHERE kind NOT IN ('article', 'paragraph', 'item') AND NOT sub GROUP BY ALL),
y AS (SELECT n.doc_id, n.node, parent, kind, display_no, CASE WHEN kind = 'article' THEN CASE WHEN text = '' THEN coalesce(substr(more, 2), '') ELSE text || coalesce(more, '') END WHEN kind = 'paragraph' THEN trim(text || coalesce(more, '')) ELSE text END AS text FROM n LEFT JOIN x ON n.doc_id = x.doc_id AND n.node = x.node),
h AS (SELECT doc_id, node, parent FROM y WHERE kind = 'paragraph' AND display_no = '' AND text = '')
SELECT y.doc_id, y.node, coalesce(h.parent, y.parent) AS parent, kind, display_no, md5(text) AS digest FROM y LEFT JOIN h ON y.doc_id = h.doc_id AND y.parent = h.node WHERE NOT (kind = 'paragraph' AND display_no = '' AND text = '')"""))
def article_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, paragraphs, items and subitems of each document as nodes with their parents and texts."""
    nodes = m.article_nodes(m.parsed_lines(marked_lines(spark, sf_dir)))
    return nodes.select("doc_id", "node", "parent", "kind", "display_no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, sections, subsections and articles of each document by their edges, chapters that only later ones imply included."""
    edges = m.heading_edges(m.parsed_lines(marked_lines(spark, sf_dir)))
    return edges.groupBy("doc_id", "kind").agg(F.count("*").alias("nodes"), F.count("parent").alias("below"), F.countDistinct("parent").alias("parents"))


_INDENT = "repeat(' ', CAST(2 * ((at * 7 + doc_id) % 6) AS INT)) || CASE (at + doc_id) % 5 WHEN 0 THEN '1. ' WHEN 1 THEN '가) ' WHEN 2 THEN '③ ' WHEN 3 THEN '2) ' ELSE '' END || ltrim(raw)"
_ITEMS = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in m.MARKS)


@query(named(f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS at FROM documents),
t AS (SELECT doc_id, at, {_INDENT} AS raw FROM s), u AS (SELECT *, regexp_replace(raw, '^\\s+', '') AS line FROM t),
i AS MATERIALIZED (SELECT doc_id, at, pattern, (length(raw) - length(line)) // 2 AS level FROM (SELECT *, CASE {_ITEMS} END AS pattern FROM u) WHERE pattern IS NOT NULL),
q AS MATERIALIZED (SELECT a.doc_id, a.at, a.pattern, a.level, (SELECT max(b.at) FROM i b WHERE b.doc_id = a.doc_id AND b.at < a.at AND b.level < a.level) AS parent_at FROM i a),
d AS (SELECT doc_id, at, 1 AS depth FROM q WHERE parent_at IS NULL UNION ALL SELECT q.doc_id, q.at, d.depth + 1 FROM d JOIN q ON q.doc_id = d.doc_id AND q.parent_at = d.at)
SELECT q.doc_id, CAST(q.at AS BIGINT) AS at, pattern, CAST(level AS BIGINT) AS level, CAST(parent_at AS BIGINT) AS parent_at, d.depth FROM q JOIN d ON d.doc_id = q.doc_id AND d.at = q.at"""))
def list_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items of each document with their parents by indent and mark."""
    split = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    texts = split.withColumn("line", F.expr(_INDENT.replace("CAST(2 *", "CAST(2L *"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return m.list_items(texts).select("doc_id", "at", "pattern", "level", "parent_at", "depth")


@query(named(LINES + f""", k AS MATERIALIZED (SELECT doc_id, at, line, row_number() OVER (PARTITION BY doc_id ORDER BY at) AS nth,
CASE WHEN regexp_matches(line, '{m.ADDENDUM}') THEN 'article' WHEN regexp_matches(line, '{m.NUMBERED}') THEN 'number' WHEN regexp_matches(line, '{m.PARAGRAPH}') THEN 'paragraph' ELSE 'text' END AS kind FROM l WHERE line <> ''),
r AS (SELECT doc_id, 0 AS nth, -1 AS at, '' AS line, '' AS kind, NULL::BIGINT AS node FROM k WHERE nth = 1
UNION ALL SELECT k.doc_id, k.nth, k.at, k.line, k.kind, CASE WHEN k.kind IN ('article', 'number') OR k.kind = 'text' AND r.node IS NULL THEN k.at ELSE r.node END FROM r JOIN k ON k.doc_id = r.doc_id AND k.nth = r.nth + 1),
n AS (SELECT doc_id, at, CASE WHEN kind = 'paragraph' THEN node END AS parent, CASE WHEN kind = 'paragraph' AND node IS NOT NULL THEN 'paragraph' WHEN kind = 'text' THEN 'text' ELSE 'addendum_item' END AS kind,
CASE kind WHEN 'article' THEN regexp_extract(line, '{m.ADDENDUM}', 1) WHEN 'number' THEN regexp_extract(line, '{m.NUMBERED}', 1) WHEN 'paragraph' THEN regexp_extract(line, '{m.PARAGRAPH}', 1) ELSE '' END AS display_no,
CASE kind WHEN 'article' THEN regexp_extract(line, '{m.ADDENDUM}', 3) WHEN 'number' THEN regexp_extract(line, '{m.NUMBERED}', 3) WHEN 'paragraph' THEN regexp_extract(line, '{m.PARAGRAPH}', 2) ELSE line END AS text FROM r WHERE nth > 0 AND NOT (kind = 'text' AND node <> at)),
x AS (SELECT doc_id, node, string_agg(CASE WHEN line LIKE '|%' THEN chr(10) ELSE ' ' END || line, '' ORDER BY at) AS rest FROM r WHERE kind = 'text' AND node <> at GROUP BY doc_id, node)
SELECT n.doc_id, CAST(n.at AS BIGINT) AS node, parent, kind, display_no, md5(CASE WHEN text = '' THEN coalesce(substr(rest, 2), '') ELSE text || coalesce(rest, '') END) AS digest FROM n LEFT JOIN x ON n.doc_id = x.doc_id AND n.at = x.node"""))
def addenda_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document read as addenda: items, paragraphs below them, and the texts that they go on with."""
    nodes = m.addenda_nodes(marked_lines(spark, sf_dir))
    return nodes.select("doc_id", "node", "parent", "kind", "display_no", F.md5(F.col("text").cast("binary")).alias("digest"))
