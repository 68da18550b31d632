"""Text queries: chunks, duplicates, filters, extraction, set likeness, names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import dedup, sync, tree
from lexmill.plans.registry import query
from lexmill.sources.tables import spread, table

TOK = "regexp_extract_all(lower(text), '[가-힣]+|[a-z0-9]+')"
COUNT = "CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 2.5))::BIGINT END"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query("""WITH c AS (SELECT doc_id, unnest(generate_series(0, greatest(n_chars - 1, 0), 450)) AS start, text, n_chars FROM documents)
SELECT doc_id, start, length(trim(substr(text, CAST(start + 1 AS BIGINT), 500), ' ')) AS chars, md5(trim(substr(text, CAST(start + 1 AS BIGINT), 500), ' ')) AS chunk_md5 FROM c
WHERE length(trim(substr(text, CAST(start + 1 AS BIGINT), 500), ' ')) >= 100""")
def chunk_fixed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 500 characters that overlap by 50, of 100 characters at least."""
    starts = docs(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_chars") - 1, F.lit(0)), F.lit(450).cast("long"))).alias("start"))
    piece = F.trim(F.substring("text", (F.col("start") + 1).cast("int"), F.lit(500)))
    return starts.select("doc_id", "start", piece.alias("piece")).where("length(piece) >= 100").select(
        "doc_id", "start", F.length("piece").cast("long").alias("chars"), F.md5(F.col("piece").cast("binary")).alias("chunk_md5")
    )


@query()
def chunk_sentence_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1280 characters cut at the last sentence end of their last 200, overlapping by 250."""
    return dedup.sentence_chunks(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "part", "start", F.length("chunk").cast("long").alias("chars"))


@query(f"SELECT doc_id, {COUNT} AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query(f"SELECT lang, source, count(*) AS n_docs, sum({COUNT})::BIGINT AS n_tokens FROM documents GROUP BY ROLLUP (lang, source)")
def chunk_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = docs(spark, sf_dir).select("lang", "source", X.token_count(F.col("text")).alias("n"))
    return counted.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{3,}')) AS term, 1.0::DOUBLE AS w FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')), 0.8 FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')), 0.6 FROM documents),
g AS (SELECT doc_id, term, max(w) AS weight FROM m GROUP BY ALL) SELECT doc_id, term, weight FROM g""")
def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weighted terms of each document; a term has the weight of its best pattern."""
    groups = (("[A-Z]{3,}", 1.0), ("[0-9]{2,}", 0.8), ("[A-Z][a-z]{5,}", 0.6))

    def weighed(pattern: str, weight: float) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    found = F.concat(*(weighed(p, w) for p, w in groups))
    return docs(spark, sf_dir).select("doc_id", F.inline(found)).groupBy("doc_id", "term").agg(F.max("w").alias("weight"))


@query(r"""SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]'))) AS found FROM documents""")
def amendment_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ISO dates in each document."""
    return docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]"), F.lit(0)))).alias("found"))


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM c GROUP BY target""")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.groupBy("target").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query(f"SELECT doc_id, {COUNT} < 30 OR trim(coalesce(text, ''), ' ') = '' AS low_signal FROM documents")
def low_signal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (X.token_count(F.col("text")) < 30) | (F.trim(F.coalesce("text", F.lit(""))) == "")
    return docs(spark, sf_dir).select("doc_id", low.alias("low_signal"))


@query(f"""WITH q AS (SELECT item_id, list_filter({TOK}, lambda x: length(x) >= 2) AS t FROM benchmark),
w AS (SELECT DISTINCT item_id, unnest(t) AS term FROM q), d AS (SELECT DISTINCT doc_id, lang, unnest({TOK}) AS term FROM documents),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM w JOIN d USING (term) GROUP BY ALL)
SELECT item_id, count(*) FILTER (hits >= 3) AS relevant, count(*) AS touched FROM h GROUP BY item_id""")
def topic_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query: documents that share a term of two letters or more with it, and those that share three or more."""
    found = docs(spark, sf_dir).select("doc_id", "lang", "text")
    return overlaps(found, table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: Pairs of word and query that a task holds at once, about, and words of queries that every task knows.
PAIRS, KNOWN_TERMS = 1_000_000, 100_000


def overlaps(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, relevant, touched) of ``queries`` (item_id, text) over ``texts`` (doc_id, lang, text).

    A text of its own id is compared with each query where it is, and a task holds two sums for each query: no pair of query and
    document is grouped. Only the words of ids that repeat meet in a shuffle, so that a word counts once for an id and language;
    those of all ids do where queries have more words than ``KNOWN_TERMS``.
    """
    long = lambda t: F.filter(X.tokens(t), lambda x: F.length(x) >= 2)
    asked = queries.select("item_id", F.explode(long("text")).alias("term")).distinct()
    known, same = asked.count() <= KNOWN_TERMS, F.col("doc_id").eqNullSafe(F.col("id"))
    repeated = texts.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    some = known and not repeated.isEmpty()
    parts = []
    if some or not known:
        rows = texts.join(repeated, same, "left_semi") if some else texts
        terms = rows.select("doc_id", "lang", F.explode(F.array_distinct(long("text"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").distinct()
        hits = terms.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
        parts.append(hits.groupBy("item_id").agg(F.count_if(F.col("hits") >= 3).alias("relevant"), F.count("*").alias("touched")))
    if known:
        alone = texts.join(repeated, same, "left_anti") if some else texts
        parts.append(_counted(alone.select(long("text").alias("words")), asked))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("item_id").agg(F.sum("relevant").alias("relevant"), F.sum("touched").alias("touched"))


def _counted(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, relevant, touched) for each task over ``texts`` (words): how many share three words, or any, of ``asked`` (item_id, term)."""
    rows = asked.toArrow()
    items = rows.column("item_id").combine_chunks().dictionary_encode()
    terms = rows.column("term").combine_chunks().dictionary_encode()
    code, of = (np.asarray(x.indices.fill_null(len(x.dictionary)), dtype=np.int64) for x in (terms, items))
    names = items.dictionary if not items.null_count else pa.concat_arrays([items.dictionary, pa.nulls(1, items.dictionary.type)])
    order = np.argsort(code, kind="stable")
    shared = asked.sparkSession.sparkContext.broadcast((terms.dictionary, of[order], np.bincount(code, minlength=len(terms.dictionary)), names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, of, width, names = shared.value
        begins, n = np.cumsum(width) - width, len(names)
        relevant, touched = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            words = batch.column(0)
            row = np.repeat(np.arange(len(words)), np.asarray(pc.fill_null(pc.list_value_length(words), 0)))
            found = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=vocabulary), -1), dtype=np.int64)
            key = np.unique((row * len(vocabulary) + found)[found >= 0])
            row, found = key // max(1, len(vocabulary)), key % max(1, len(vocabulary))
            # texts are taken together as long as their pairs, and their sums by query, are few
            pairs, start = np.r_[0, np.cumsum(width[found])], 0
            while start < len(row):
                stop = min(np.searchsorted(pairs, pairs[start] + PAIRS, "right") - 1, np.searchsorted(row, row[start] + max(1, 4 * PAIRS // n)))
                # a text is never parted
                stop = np.searchsorted(row, row[stop], "left") if stop < len(row) else stop
                stop = stop if stop > start else np.searchsorted(row, row[start], "right")
                some = width[found[start:stop]]
                item = of[np.repeat(begins[found[start:stop]] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
                place = np.repeat(row[start:stop] - row[start], some)
                hits = np.bincount(place * n + item, minlength=(row[stop - 1] - row[start] + 1) * n).reshape(-1, n)
                relevant += (hits >= 3).sum(0)
                touched += (hits > 0).sum(0)
                start = stop
        full = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(full)), pa.array(relevant[full]), pa.array(touched[full])], ["item_id", "relevant", "touched"])

    return texts.mapInArrow(count, f"item_id {asked.schema['item_id'].dataType.simpleString()}, relevant long, touched long")


@query("""WITH o AS (SELECT doc_id AS key, substr(sha256(concat_ws('::', coalesce(text, ''), coalesce(lang, ''))), 1, 16) AS h FROM documents WHERE n_chars % 7 <> 0),
n AS (SELECT doc_id AS key, substr(sha256(concat_ws('::', CASE WHEN doc_id % 5 = 0 THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END, coalesce(lang, ''))), 1, 16) AS h FROM documents WHERE n_chars % 11 <> 0 OR n_chars % 7 = 0)
SELECT key, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS action FROM o FULL JOIN n USING (key)""")
def content_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived snapshots: one lacks texts of a length divided by seven, the other those divided by eleven alone and has changed every fifth; each is in one."""
    whole = docs(spark, sf_dir)
    old = sync.state(whole.where("n_chars % 7 <> 0"), "doc_id", "text", "lang")
    changed = whole.where("n_chars % 11 <> 0 OR n_chars % 7 = 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    return sync.diff(old, sync.state(changed, "doc_id", "text", "lang"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by digest: the text itself is not shuffled."""
    return dedup.group_copies(docs(spark, sf_dir), F.sha2(F.col("text").cast("binary"), 256))


@query(r"SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_id, count(*) OVER (PARTITION BY k) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS k FROM documents)")
def normalized_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    return dedup.group_copies(docs(spark, sf_dir), F.sha2(key.cast("binary"), 256))


@query(f"""WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), s AS (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM d),
f AS (SELECT term, count(*) AS df FROM s GROUP BY term), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
o AS (SELECT s.doc_id, s.term, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.term) AS r FROM s JOIN f USING (term)),
p AS (SELECT doc_id, term FROM o JOIN n USING (doc_id) WHERE r <= size - ceil(0.8::DOUBLE * size) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.term = b.term AND a.doc_id < b.doc_id),
i AS (SELECT c.a, c.b, count(*) AS common FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.term = x.term GROUP BY ALL)
SELECT a, b, round(common::DOUBLE / (x.size + y.size - common), 6) AS jaccard FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common::DOUBLE / (x.size + y.size - common) >= 0.8""")
def near_duplicate_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts whose token sets have a Jaccard likeness of 0.8 or more; copies are grouped before."""
    return dedup.jaccard_pairs(docs(spark, sf_dir).select("doc_id", "text"), 0.8)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT line, count(*) AS n, count(DISTINCT doc_id) AS in_docs FROM l WHERE length(line) >= 10 GROUP BY line)
SELECT md5(line) AS line_md5, n, in_docs FROM c WHERE in_docs >= 3""")
def repeated_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more: what a cleaner removes."""
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 10").select("doc_id", F.md5(F.col("line").cast("binary")).alias("line_md5"))
    per_doc = lines.groupBy("line_md5", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("line_md5").agg(F.sum("n").alias("n"), F.count("*").alias("in_docs")).where("in_docs >= 3")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT *, length(line) >= 80 AS long FROM l), g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, long ORDER BY pos) AS island FROM f)
SELECT doc_id, long, min(pos)::BIGINT AS first_line, count(*) AS n_lines FROM g GROUP BY doc_id, long, island""")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of long and of short lines."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("pos"), (F.length("line") >= 80).alias("long"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "long").orderBy("pos"))
    return lines.withColumn("island", island).groupBy("doc_id", "long", "island").agg(F.min("pos").cast("long").alias("first_line"), F.count("*").alias("n_lines")).drop("island")


def _redaction_sql() -> str:
    inner = "text"
    for pattern, tag in X.REDACTIONS:
        inner = f"regexp_replace({inner}, '{pattern}', '{tag}', 'g')"
    return f"SELECT doc_id, md5({inner}) AS clean_md5, {inner} <> text AS changed FROM documents"


@query(_redaction_sql())
def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = X.redact(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), (clean != F.col("text")).alias("changed"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS is_{n}" for n, p in X.ATTACKS.items()) + " FROM documents")
def malicious_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = X.attack_flags(F.col("text"))
    return docs(spark, sf_dir).withColumn("flags", flags).select("doc_id", *(F.array_contains("flags", n).alias(f"is_{n}") for n in X.ATTACKS))


@query(r"""SELECT lang, count(*) AS n_docs, round(avg(coalesce(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0)), 9) AS ascii_share,
round(avg(CASE WHEN length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ가-힣]', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ가-힣]', '', 'g')) END), 9) AS latin_share FROM documents GROUP BY lang""")
def language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.round(F.avg(X.ascii_share(F.col("text"))), 9).alias("ascii_share"), F.round(F.avg(X.latin_share(F.col("text"))), 9).alias("latin_share")
    )


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')) AS text_md5 FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("html", "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(bare, "[ \t\r\n]+", " ")).cast("binary")).alias("text_md5"))


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS cell, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) AS row FROM pages)
SELECT page_id, row::BIGINT AS row, regexp_replace(cell, '<[^>]*>', '', 'g') AS text FROM c""")
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the lists of each page, in order."""
    items = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1))).alias("pos", "cell"))
    return items.select("page_id", (F.col("pos") + 1).cast("long").alias("row"), F.regexp_replace("cell", "<[^>]*>", "").alias("text"))


@query(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT host, count(*) AS pages, count(DISTINCT path) AS paths, max(length(path)) AS longest FROM h GROUP BY host""")
def link_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and paths of each host."""
    parts = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return parts.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("path").alias("paths"), F.max(F.length("path")).cast("long").alias("longest"))


@query(r"""WITH s AS (SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[.!?]')))::DOUBLE AS sents, len(regexp_extract_all(text, '[^ \t\r\n]+'))::DOUBLE AS words, len(regexp_extract_all(text, '\n'))::DOUBLE AS breaks FROM documents)
SELECT doc_id, round(0.4 * least(1.0, breaks / 5) + 0.3 * least(1.0, words / 200) + 0.3 * (CASE WHEN words / sents <= 25 THEN 1.0 ELSE 25 / (words / sents) END), 6) AS readability FROM s""")
def readability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, length and sentence length, weighed .4, .3 and .3."""
    counted = docs(spark, sf_dir).select(
        "doc_id", F.greatest(F.lit(1), F.regexp_count("text", F.lit("[.!?]"))).cast("double").alias("sents"),
        F.regexp_count("text", F.lit(r"[^ \t\r\n]+")).cast("double").alias("words"), F.regexp_count("text", F.lit("\n")).cast("double").alias("breaks"),
    )
    length = F.col("words") / F.col("sents")
    flow = F.when(length <= 25, 1.0).otherwise(25 / length)
    return counted.select("doc_id", F.round(0.4 * F.least(F.lit(1.0), F.col("breaks") / 5) + 0.3 * F.least(F.lit(1.0), F.col("words") / 200) + 0.3 * flow, 6).alias("readability"))


@query("""WITH s AS (SELECT DISTINCT split_part(s_name, '#', 1) AS base FROM supplier), b AS (SELECT DISTINCT p_brand AS brand FROM part),
x AS (SELECT a.brand AS a, b.brand AS b, levenshtein(a.brand, b.brand) AS d FROM b a JOIN b ON a.brand < b.brand)
SELECT a, b, d::BIGINT AS d FROM x WHERE d <= 2""")
def edit_distance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of brands within two edits. Candidates share a piece: two edits leave one of three pieces in place, so no cross join."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return dedup.within_edits(brands, "name", 2).select("a", "b", F.col("d").cast("long").alias("d"))


@query()
def fuzzy_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and their likeness by longest matching blocks, among names that share their first word."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return dedup.matching_block_pairs(names, 0.7)


@query("""WITH t AS (SELECT n_nationkey + 100 AS node, n_regionkey AS parent, n_name AS label FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region)
SELECT c.node, CASE WHEN c.parent IS NULL THEN c.label ELSE p.label || ' > ' || c.label END AS path, CASE WHEN c.parent IS NULL THEN 1 ELSE 2 END AS level FROM t c LEFT JOIN t p ON c.parent = p.node""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the tree of regions and nations."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("node_id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("label"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("label"))
    nodes = nations.unionByName(regions).withColumn("doc_id", F.lit("world"))
    return tree.paths(nodes, 3).select(F.col("node_id").alias("node"), F.array_join("path", " > ").alias("path"), "level")
