"""Quality and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import stats
from lexmill.functions.text import ratio
from lexmill.operators import evaluate
from lexmill.plans.registry import query
from lexmill.sources.tables import table


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


L = "documents JOIN labels USING (doc_id)"


@query(f"""SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 4) AS deviation, min(n_chars) AS low, max(n_chars) AS high,
round(count(*) FILTER (quality = 1)::DOUBLE / count(*), 9) AS pass_rate FROM {L} GROUP BY lang""")
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evaluate.summary(labelled(spark, sf_dir).withColumn("ok", F.col("quality") == 1), ["lang"], "n_chars", "ok")
    return told.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 4).alias("deviation"), "low", "high", F.round("pass_rate", 9).alias("pass_rate"))


@query(f"SELECT source, count(*) AS n, round(avg(quality), 9) AS pass_rate, round(avg(toxic), 9) AS toxic_rate FROM {L} GROUP BY source")
def pass_rate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("pass_rate"), F.round(F.avg("toxic"), 9).alias("toxic_rate"))


@query(f"SELECT source, round(avg(quality), 9) AS pass_rate FROM {L} GROUP BY source HAVING avg(quality) < 0.65")
def weak_sources_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("source").agg(F.avg("quality").alias("q")).where("q < 0.65").select("source", F.round("q", 9).alias("pass_rate"))


@query(f"SELECT lang, source, quality, count(*) AS n FROM {L} GROUP BY GROUPING SETS ((lang, quality), (source, quality), (quality))")
def grouping_sets_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.groupingSets([["lang", "quality"], ["source", "quality"], ["quality"]], "lang", "source", "quality").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)")
def cube_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("""WITH u AS (SELECT doc_id, quality, 0 AS part FROM labels UNION ALL SELECT doc_id, 1 - toxic, 1 FROM labels)
SELECT doc_id, quality, part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, part) AS r FROM u) WHERE r = 1""")
def merge_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the labelled documents; the second replaces the first only where it is strictly better."""
    labels = table(spark, sf_dir, "labels")
    both = labels.select("doc_id", "quality", F.lit(0).alias("part")).unionByName(labels.select("doc_id", (1 - F.col("toxic")).alias("quality"), F.lit(1).alias("part")))
    return evaluate.keep_best(both, ["doc_id"], "quality", [F.col("part")])


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70, 15 and 15 per cent of each language in a fixed order by hash."""
    w = Window.partitionBy("lang")
    r = F.row_number().over(w.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")).cast("binary")), "doc_id"))
    n = F.count("*").over(w)
    split = F.when(r <= F.floor(n * 0.7), "train").when(r <= F.floor(n * 0.7) + F.floor(n * 0.15), "val").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", split.alias("split"))


KIND = "CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 500 THEN 'length' WHEN lang <> 'en' THEN 'language' ELSE 'unknown' END"


def _kind():
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") < 500, "length").when(F.col("lang") != "en", "language").otherwise("unknown")


@query(f"""WITH f AS (SELECT doc_id, n_chars, {KIND} AS kind FROM {L} WHERE quality = 0),
e AS (SELECT kind, list(doc_id ORDER BY doc_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS r FROM f) WHERE r <= 5 GROUP BY kind)
SELECT kind, count(*) AS n, round(avg(n_chars), 6) AS mean, array_to_string(any_value(examples), ',') AS examples FROM f JOIN e USING (kind) GROUP BY kind ORDER BY n DESC, kind LIMIT 5""")
def failure_classify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of rejected documents with up to five examples each."""
    found = evaluate.failures(labelled(spark, sf_dir).where("quality = 0"), _kind(), "n_chars")
    return found.select("kind", "n", F.round("mean", 6).alias("mean"), F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query(f"""WITH f AS (SELECT {KIND} AS kind, source, quality FROM {L}), g AS (SELECT kind, count(*) FILTER (quality = 0) AS n, avg(quality) AS mean FROM f GROUP BY kind)
SELECT kind, n, round(n * least(1.0, greatest(0.0, 1 - mean)) * CASE kind WHEN 'length' THEN 0.6 WHEN 'language' THEN 0.4 ELSE 0.2 END, 6) AS priority FROM g""")
def roadmap_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = labelled(spark, sf_dir).groupBy(_kind().alias("kind")).agg(F.count_if(F.col("quality") == 0).alias("n"), F.avg("quality").alias("mean"))
    fix = F.coalesce(F.create_map(*(F.lit(x) for kv in evaluate.FIXABILITY.items() for x in kv))[F.col("kind")], F.lit(0.2))
    gap = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("mean")))
    return grouped.select("kind", "n", F.round(F.col("n") * gap * fix, 6).alias("priority"))


@query(f"""WITH i AS (SELECT doc_id, source, unnest(list_filter([CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL)) AS issue FROM {L})
SELECT source, issue, count(*) AS n FROM i GROUP BY ALL HAVING count(*) > 1""")
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document can have several issues; issues that occur once are left out."""
    issues = F.array_compact(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "short")))
    return labelled(spark, sf_dir).select("source", F.explode(issues).alias("issue")).groupBy("source", "issue").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT count(*) AS categories, min(n) AS low, max(n) AS high, round(min(n)::DOUBLE / max(n), 9) AS balance FROM c""")
def category_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("categories"), F.min("n").alias("low"), F.max("n").alias("high"), F.round(ratio(F.min("n"), F.max("n")), 9).alias("balance"))


@query("""SELECT count(*) AS n, count(DISTINCT text) AS distinct_texts, round(1 - count(DISTINCT text)::DOUBLE / count(*), 9) AS duplicate_ratio, count(*) FILTER (n_chars < 200) AS short,
count(*) FILTER (n_chars >= 200 AND n_chars < 2000) AS middle, count(*) FILTER (n_chars >= 2000) AS long FROM documents""")
def diversity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are compared by digest; copies are summed per group before the totals."""
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(
        F.count("*").alias("n"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.col("n_chars").between(200, 1999)).alias("middle"), F.count_if(F.col("n_chars") >= 2000).alias("long")
    )
    total = F.sum("n")
    return groups.agg(total.alias("n"), F.count("*").alias("distinct_texts"), F.round(1 - F.count("*").cast("double") / total, 9).alias("duplicate_ratio"), *(F.sum(c).alias(c) for c in ("short", "middle", "long")))


@query(f"""WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM {L} GROUP BY source)
SELECT source, n, good, round((good::DOUBLE / n + 1.96::DOUBLE * 1.96 / (2 * n) - 1.96::DOUBLE * sqrt((good::DOUBLE / n * (1 - good::DOUBLE / n) + 1.96::DOUBLE * 1.96 / (4 * n)) / n)) / (1 + 1.96::DOUBLE * 1.96 / n), 9) AS low FROM c""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower Wilson bound of the share of good documents of each source."""
    counts = labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    return counts.select("source", "n", "good", F.round(stats.wilson(F.col("good"), F.col("n"))["low"], 9).alias("low"))
