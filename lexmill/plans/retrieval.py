"""Filters and re-ranking of retrieved rows: orders are queries, their lines the results, the discount their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import ratio
from lexmill.operators import ranking as R
from lexmill.plans.registry import query
from lexmill.sources.tables import table

#: Weights of results by kind, and those that an intent sets instead.
TYPE_WEIGHTS, INTENT_WEIGHTS = {"N": 1.5, "R": 0.5, "A": 0.5}, {"A": 1.2}

#: The place of a row in its table: file, and row in it.
PLACE = (("file_path", "file"), ("row_index", "row"))

HITS = "h AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, l_linenumber AS rank, l_discount * 10 AS score, l_returnflag AS kind, l_quantity AS size FROM lineitem)"


def hits(spark: SparkSession, sf_dir: str, *more: tuple[str, str]) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"), (F.col("l_discount") * 10).alias("score"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("size"), *(F.col(f"_metadata.{c}").alias(n) for c, n in more)
    )


def again(rows: DataFrame, score: Column, digits: int = 9) -> DataFrame:
    """Ranks rows anew by a score rounded to ``digits``; the old rank, then the id decide ties."""
    scored = rows.withColumn("score", F.round(score, digits))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_id")))


@query(f"""WITH {HITS}, m AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM h WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, rank, round(CASE WHEN high = low THEN 1 ELSE (score - low) / (high - low) END, 6) AS relevance FROM m WHERE CASE WHEN high = low THEN 1 ELSE (score - low) / (high - low) END >= 0.1""")
def relevant_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose score, scaled among those of their query, reaches a tenth."""
    return hits(spark, sf_dir).withColumn("relevance", R.min_max()).where("relevance >= 0.1").select("query_id", "doc_id", "rank", F.round("relevance", 6).alias("relevance"))


@query(f"""WITH {HITS}, w AS (SELECT *, least(1.0::DOUBLE, score * CASE kind WHEN 'N' THEN 1.5 WHEN 'R' THEN 0.5 WHEN 'A' THEN CASE WHEN query_id % 3 = 0 THEN 1.2 ELSE 0.5 END ELSE 1.0 END::DOUBLE) AS s FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank, doc_id) AS place FROM w) SELECT query_id, doc_id, place, round(s, 9) AS score FROM p WHERE place <= 5""")
def type_weighted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores weighted by kind, other weights where the intent says so, one at most; the five best."""
    weight, other = F.lit(1.0), F.lit(1.0)
    for kind, w in TYPE_WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    other = weight
    for kind, w in INTENT_WEIGHTS.items():
        other = F.when(F.col("kind") == kind, w).otherwise(other)
    score = F.least(F.lit(1.0), F.col("score") * F.when(F.col("query_id") % 3 == 0, other).otherwise(weight))
    return again(hits(spark, sf_dir), score).where("place <= 5").select("query_id", "doc_id", F.col("place").cast("long").alias("place"), "score")


@query(f"""WITH {HITS}, w AS (SELECT *, CASE WHEN query_id % 2 = 0 AND kind = 'R' THEN 0.4 ELSE 1 END::DOUBLE * (0.7::DOUBLE * score + 0.3::DOUBLE * least(1.0::DOUBLE, size / 50)) AS s FROM h)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank, doc_id) AS place, round(s, 9) AS score FROM w""")
def blended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven parts of one score and three of another, less where audience and kind do not fit, ranked anew."""
    fits = F.when((F.col("query_id") % 2 == 0) & (F.col("kind") == "R"), 0.4).otherwise(1.0)
    found = again(hits(spark, sf_dir), fits * (0.7 * F.col("score") + 0.3 * F.least(F.lit(1.0), F.col("size") / 50)))
    return found.select("query_id", "doc_id", F.col("place").cast("long").alias("place"), "score")


@query(f"""WITH {HITS}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS copy FROM h),
p AS (SELECT query_id, doc_id, rank, size < 10 AS low_signal, row_number() OVER (PARTITION BY query_id ORDER BY size < 10, rank, doc_id) AS place FROM d WHERE copy = 1) SELECT query_id, doc_id, low_signal, place FROM p WHERE place <= 3""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources for each answer, each once: informative ones by rank, filled up with those of little signal.

    Of copies of a source with one rank the first in the table counts, so that reruns agree.
    """
    once = R.first_of_group(hits(spark, sf_dir, *PLACE), ["query_id", "doc_id"], [F.col("rank"), F.col("file"), F.col("row")]).withColumn("low_signal", F.col("size") < 10)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("low_signal", "rank", "doc_id"))
    return once.withColumn("place", place.cast("long")).where("place <= 3").select("query_id", "doc_id", "low_signal", "place")


@query(f"""WITH {HITS}, w AS (SELECT *, least(1.0::DOUBLE, 0.7::DOUBLE * score + 0.2::DOUBLE * least(1.0::DOUBLE, 2 * size / 100) + 0.1::DOUBLE / (1 + 0.1::DOUBLE * rank)) AS s FROM h)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank, doc_id) AS place, round(s, 9) AS score FROM w""")
def corrective_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, overlap and old rank in one score, one at most."""
    s = 0.7 * F.col("score") + 0.2 * F.least(F.lit(1.0), 2 * F.col("size") / 100) + 0.1 / (1 + 0.1 * F.col("rank"))
    return again(hits(spark, sf_dir), F.least(F.lit(1.0), s)).select("query_id", "doc_id", F.col("place").cast("long").alias("place"), "score")


@query(f"""WITH {HITS}, q AS (SELECT query_id, CASE WHEN avg(score) > 0.5 THEN 0.7 ELSE 0.5 END::DOUBLE AS w FROM h GROUP BY query_id),
u AS (SELECT query_id, doc_id, rank, 0 AS list, score * w AS s FROM h JOIN q USING (query_id) WHERE rank % 2 = 1 UNION ALL SELECT query_id, doc_id, rank, 1, score * (1 - w) FROM h JOIN q USING (query_id) WHERE rank % 2 = 0 OR rank = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list, rank, s DESC) AS n FROM u), p AS (SELECT query_id, doc_id, list, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS place FROM f WHERE n = 1)
SELECT query_id, doc_id, list, score, place FROM p WHERE place <= 5""")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of results with weights by the quality of the first; a result of both counts in the first.

    Many averages lie at the limit but for the rounding of their sums, so scores are added up in the order of the table's rows.
    """
    rows = hits(spark, sf_dir, *PLACE)
    all_ = Window.partitionBy("query_id").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("w", F.when(F.avg("score").over(all_) > 0.5, 0.7).otherwise(0.5))
    one = rows.where("rank % 2 = 1").select("query_id", "doc_id", "rank", F.lit(0).alias("list"), (F.col("score") * F.col("w")).alias("s"))
    two = rows.where("rank % 2 = 0 OR rank = 1").select("query_id", "doc_id", "rank", F.lit(1).alias("list"), (F.col("score") * (1 - F.col("w"))).alias("s"))
    once = R.first_of_group(one.unionByName(two), ["query_id", "doc_id"], [F.col("list"), F.col("rank"), F.desc("s")]).withColumn("score", F.round("s", 9))
    return R.top_k(once, 5).select("query_id", "doc_id", "list", "score", F.col("rank").cast("long").alias("place"))


@query(f"""WITH {HITS}, q AS (SELECT query_id, count(*) AS n, avg(size) AS latency FROM h GROUP BY query_id),
k AS (SELECT query_id, CASE WHEN latency > 30 THEN greatest((CASE WHEN n <= 2 THEN 5 WHEN n <= 4 THEN 10 ELSE 15 END) // 2, 5) ELSE CASE WHEN n <= 2 THEN 5 WHEN n <= 4 THEN 10 ELSE 15 END END AS k FROM q) SELECT k, count(*) AS queries FROM k GROUP BY k""")
def guarded_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results a query gets: by its complexity, half of it, five at least, where answers were slow."""
    q = hits(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"), F.avg("size").alias("latency"))
    k = R.choose_k(F.when(F.col("n") <= 2, "simple").when(F.col("n") <= 4, "medium").otherwise("complex"))
    guarded = F.when(F.col("latency") > 30, F.greatest(F.floor(k / 2), F.lit(5))).otherwise(k).cast("int")
    return q.groupBy(guarded.alias("k")).agg(F.count("*").alias("queries"))


@query(f"""WITH {HITS}, s AS (SELECT query_id, max(score) AS top, avg((size > 20)::INT) FILTER (rank <= 3) AS keyword, count(DISTINCT kind) FILTER (rank <= 5)::DOUBLE / nullif(count(*) FILTER (rank <= 5), 0) AS diversity FROM h GROUP BY query_id),
v AS (SELECT query_id, round(0.5::DOUBLE * top + 0.3::DOUBLE * coalesce(keyword, 0) + 0.2::DOUBLE * coalesce(diversity, 0), 9) AS quality FROM s)
SELECT query_id, round(quality, 6) AS quality, CASE WHEN quality >= 0.6 THEN 'good' WHEN quality >= 0.45 THEN 'adequate' ELSE 'poor' END AS verdict, quality < 0.6 AS try_again FROM v""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each query's results from the best score, keywords among the first three and kinds among the first five."""
    first5 = F.col("rank") <= 5
    s = hits(spark, sf_dir).groupBy("query_id").agg(
        F.max("score").alias("top"), F.avg(F.when(F.col("rank") <= 3, (F.col("size") > 20).cast("int"))).alias("keyword"), ratio(F.count_distinct(F.when(first5, F.col("kind"))), F.count_if(first5)).alias("diversity")
    )
    s = s.withColumn("quality", F.round(0.5 * F.col("top") + 0.3 * F.coalesce("keyword", F.lit(0.0)) + 0.2 * F.col("diversity"), 9))
    verdict = F.when(F.col("quality") >= 0.6, "good").when(F.col("quality") >= 0.45, "adequate").otherwise("poor")
    return s.select("query_id", F.round("quality", 6).alias("quality"), verdict.alias("verdict"), (F.col("quality") < 0.6).alias("try_again"))


@query(f"""WITH {HITS}, u AS (SELECT query_id // 4 AS query_id, doc_id % 50 AS doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM h),
s AS (SELECT query_id, doc_id, round(sum(part), 12) AS score, count(*) AS lists FROM u GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) SELECT query_id, doc_id, lists, score, place FROM p WHERE place <= 10""")
def expanded_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of four variants of a query together: the sum of 1 / (60 + rank) over the lists that name a result."""
    rows = hits(spark, sf_dir).select(F.floor(F.col("query_id") / 4).alias("query_id"), (F.col("doc_id") % 50).alias("doc_id"), (1 / (R.RRF_K + F.col("rank"))).alias("part"))
    summed = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"), F.count("*").alias("lists"))
    return R.top_k(summed, 10).select("query_id", "doc_id", "lists", "score", F.col("rank").cast("long").alias("place"))


@query(f"""WITH {HITS} SELECT query_id, string_agg('[' || rank || '] ' || doc_id || ' (' || kind || ')', chr(10) ORDER BY rank, doc_id, kind) AS context FROM h WHERE rank <= 5 GROUP BY query_id""")
def context_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five results of each query as a numbered text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("doc_id").cast("string"), F.lit(" ("), "kind", F.lit(")"))
    rows = hits(spark, sf_dir).where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", line.alias("line")))).alias("lines"))
    return rows.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


@query("""WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN 'abolished' ELSE 'active' END AS status, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label, round(least(1.0, greatest(0.0, list_cosine_similarity(q.v, d.v))), 9) AS score FROM e q JOIN e d ON q.vec_id <> d.vec_id AND d.status = 'active' AND (q.vec_id % 200 <> 0 OR d.label = q.label) WHERE q.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) SELECT query_id, doc_id, score, place FROM p WHERE place <= 5""")
def filtered_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest active vectors of each query, filtered before they are ranked; every second query asks for its own label."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("status", F.when(F.col("vec_id") % 7 == 0, "abolished").otherwise("active"))
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 200 == 0, F.col("label")).alias("only"))
    active = vectors.where("status = 'active'").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return R.cosine_top_k(active, asked, 5, clip=(0.0, 1.0)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("place"))


@query("""WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS q FROM part), t AS (SELECT DISTINCT p_name AS title FROM part),
m AS (SELECT q, title, CASE WHEN title = q THEN 4 ELSE 3 END AS score FROM q JOIN t ON list_contains(string_split(title, ' '), q)) SELECT q, title, score FROM m""")
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that a name stands in, exact ones above the others; names and titles meet over the words that both hold."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("q")).distinct()
    titles = parts.select(F.col("p_name").alias("title")).distinct().select("title", F.explode(F.array_distinct(F.split("title", " "))).alias("q"))
    return names.join(titles, "q").select("q", "title", F.when(F.col("title") == F.col("q"), 4).otherwise(3).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM orders) AS b FROM orders), w AS (SELECT o_orderkey AS start, o_orderkey AS node, 0 AS hop FROM orders WHERE o_orderkey % 100 = 0
UNION SELECT w.start, e.b, w.hop + 1 FROM w JOIN e ON e.a = w.node WHERE w.hop < 3) SELECT start, node, min(hop) AS hop FROM w GROUP BY ALL""")
def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query reaches over up to three links, each node with the fewest; visited ones are not followed again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = orders.count()
    links = orders.select(F.col("o_orderkey").alias("a"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % n).alias("b"))
    seen = new = orders.where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("node"), F.lit(0).alias("hop"))
    for hop in range(1, 4):
        step = new.join(links, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        new = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(new)
    return seen


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), f AS (SELECT c.*, p.p_partkey IS NOT NULL AS known, s.s_suppkey IS NOT NULL AND p.p_size > 10 AS grounded FROM c LEFT JOIN part p ON p.p_partkey = l_partkey LEFT JOIN supplier s ON s.s_suppkey = l_suppkey)
SELECT l_orderkey AS answer_id, count(*) AS citations, count(*) FILTER (known) AS valid, count(*) FILTER (NOT known OR NOT grounded) AS unfounded FROM f GROUP BY 1""")
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each answer whose source is known, and those that no source bears out; copies count once."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), "l_partkey", "l_suppkey").distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", F.lit(True).alias("known"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("there"))
    checked = cited.join(parts, "l_partkey", "left").join(sources, "l_suppkey", "left")
    known, grounded = F.coalesce("known", F.lit(False)), F.coalesce(F.col("there") & (F.col("p_size") > 10), F.lit(False))
    return checked.groupBy("answer_id").agg(F.count("*").alias("citations"), F.count_if(known).alias("valid"), F.count_if(~known | ~grounded).alias("unfounded"))


@query("""SELECT o_orderkey, CAST(regexp_extract(f, '(\\d{4})학년도', 1) AS INT) AS year, CASE WHEN contains(f, '1학기') THEN 1 WHEN contains(f, '2학기') THEN 2 END AS semester, strptime(regexp_extract(f, '_(\\d{8}_\\d{6})', 1), '%Y%m%d_%H%M%S')::VARCHAR AS stamp
FROM (SELECT o_orderkey, date_part('year', o_orderdate) || '학년도 ' || (o_orderkey % 3) || '학기 eval_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.json' AS f FROM orders)""")
def names_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Academic year, semester and time stamp that a file name holds."""
    name = F.concat(F.year("o_orderdate").cast("string"), F.lit("학년도 "), (F.col("o_orderkey") % 3).cast("string"), F.lit("학기 eval_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit(".json"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("f"))
    stamp = F.to_timestamp(F.regexp_extract("f", r"_(\d{8}_\d{6})", 1), "yyyyMMdd_HHmmss")
    return rows.select("o_orderkey", F.regexp_extract("f", r"(\d{4})학년도", 1).cast("int").alias("year"), F.when(F.col("f").contains("1학기"), 1).when(F.col("f").contains("2학기"), 2).alias("semester"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("stamp"))
