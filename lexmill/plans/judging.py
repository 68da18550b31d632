"""Evaluation reports: gates, baselines, tiers, experiments, costs, coverage, score bands, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import clipped, keyword_tokens, ratio
from lexmill.plans.registry import query
from lexmill.sources.tables import table

#: The least value that passes a gate.
GATES = {"pass_rate": 0.6, "clean_rate": 0.9}
#: Prices for 1000 tokens read and written, by model; an unknown model costs nothing.
PRICES = {"en": ("0.0100", "0.0300"), "de": ("0.0005", "0.0015")}
#: Score bands, best first.
BANDS = (("excellent", 4.5), ("good", 4.0), ("fair", 3.0))
#: Bounds of answer relevancy, thresholds by stage.
RELEVANCY, STAGES = (0.5, 0.92), {1: 0.60, 2: 0.75, 3: 0.80}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def r6(value: Column) -> Column:
    return F.round(value, 6)


L = "documents JOIN labels USING (doc_id)"


@query("SELECT user_id, count(*) AS total, sum((event_type = 'view')::INT)::BIGINT AS views, sum((event_type = 'click')::INT)::BIGINT AS clicks, round(sum(coalesce(value, 0)), 4) AS value FROM events GROUP BY user_id")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each user, missing values counted as 0."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"), kind("view").alias("views"), kind("click").alias("clicks"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("value"))


@query("""WITH s AS (SELECT user_id, count(*) AS total, round(avg(value), 6) AS mean, round(count(*) FILTER (event_type = 'click')::DOUBLE / count(*), 6) AS rate FROM events GROUP BY user_id)
SELECT 'rate' AS measure, arg_max(user_id, (rate, -user_id)) AS best, arg_min(user_id, (rate, user_id)) AS worst FROM s
UNION ALL SELECT 'mean', arg_max(user_id, (mean, -user_id)), arg_min(user_id, (mean, user_id)) FROM s UNION ALL SELECT 'total', arg_max(user_id, (total, -user_id)), arg_min(user_id, (total, user_id)) FROM s""")
def session_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the highest and the lowest rate, mean and total; the lower id wins ties."""
    told = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").cast("double").alias("total"), r6(F.avg("value")).alias("mean"), r6(ratio(F.count_if(F.col("event_type") == "click"), F.count("*"))).alias("rate"))
    long = told.select("user_id", F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("rate", "mean", "total"))))).where("x IS NOT NULL")
    return long.groupBy("measure").agg(F.max_by("user_id", F.struct("x", -F.col("user_id"))).alias("best"), F.min_by("user_id", F.struct("x", F.col("user_id"))).alias("worst"))


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS applied, count(*) FILTER (event_type = 'view') AS skipped, coalesce(avg(value) FILTER (event_type = 'click'), 0) AS mean FROM events GROUP BY user_id)
SELECT user_id, coalesce(round(applied::DOUBLE / nullif(applied + skipped, 0), 6), 0) AS apply_rate, coalesce(round(skipped::DOUBLE / nullif(applied + skipped, 0), 6), 0) AS skip_rate, round(mean, 6) AS mean, round(skipped * mean, 4) AS saved FROM s""")
def skip_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of applied and skipped work, and the time that skipping saved at the mean of the applied."""
    s = events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("applied"), F.count_if(F.col("event_type") == "view").alias("skipped"), F.coalesce(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)).alias("mean")
    )
    both = F.col("applied") + F.col("skipped")
    return s.select("user_id", r6(ratio(F.col("applied"), both)).alias("apply_rate"), r6(ratio(F.col("skipped"), both)).alias("skip_rate"), r6(F.col("mean")).alias("mean"), F.round(F.col("skipped") * F.col("mean"), 4).alias("saved"))


@query("""SELECT user_id, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta, round(arg_min(value, (ts, event_id)), 6) AS baseline FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user against the oldest."""
    at = F.struct("ts", "event_id")
    told = events(spark, sf_dir).where("value IS NOT NULL").groupBy("user_id").agg(F.max_by("value", at).alias("last"), F.min_by("value", at).alias("first"))
    return told.select("user_id", r6(F.col("last") - F.col("first")).alias("delta"), r6(F.col("first")).alias("baseline"))


@query(f"""WITH s AS (SELECT source, count(*) AS n, avg(quality) AS pass_rate, avg(1 - toxic) AS clean_rate FROM {L} GROUP BY source)
SELECT source, n, pass_rate >= 0.6 AS pass_rate_gate, clean_rate >= 0.9 AS clean_rate_gate, pass_rate >= 0.6 AND clean_rate >= 0.9 AS passed, round(1 - pass_rate, 3) AS failure_rate FROM s""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named gates of each source, whether all are passed, and the failure rate."""
    s = labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("pass_rate"), F.avg(1 - F.col("toxic")).alias("clean_rate"))
    gates = {f"{name}_gate": F.col(name) >= least for name, least in GATES.items()}
    passed = gates["pass_rate_gate"] & gates["clean_rate_gate"]
    return s.select("source", "n", *(g.alias(n) for n, g in gates.items()), passed.alias("passed"), F.round(1 - F.col("pass_rate"), 3).alias("failure_rate"))


@query(f"""SELECT CASE WHEN n_chars < 800 THEN 'easy' WHEN n_chars < 3000 THEN 'medium' ELSE 'hard' END AS tier, count(*) AS total, sum(quality)::BIGINT AS passed, round(avg(quality), 6) AS pass_rate, avg(quality) >= 0.7 AS escalate FROM {L} GROUP BY 1""")
def tier_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, passed and pass rate of each difficulty, and whether to go on to the next."""
    tier = F.when(F.col("n_chars") < 800, "easy").when(F.col("n_chars") < 3000, "medium").otherwise("hard")
    return labelled(spark, sf_dir).groupBy(tier.alias("tier")).agg(F.count("*").alias("total"), F.sum("quality").alias("passed"), r6(F.avg("quality")).alias("pass_rate"), (F.avg("quality") >= 0.7).alias("escalate"))


@query("""WITH t AS (SELECT lang, sum(greatest(1, floor(n_chars / 2.5)))::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY lang)
SELECT lang AS model, n, CASE lang WHEN 'en' THEN (tokens * 0.0100::DECIMAL(12,4) + n * 500 * 0.0300::DECIMAL(12,4)) / 1000 WHEN 'de' THEN (tokens * 0.0005::DECIMAL(12,4) + n * 500 * 0.0015::DECIMAL(12,4)) / 1000 ELSE 0 END::DOUBLE AS cost FROM t""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of reading each language's texts and writing 500 tokens for each, in exact decimals; each language is a model."""
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.greatest(F.lit(1), F.floor(F.col("n_chars") / 2.5))).alias("tokens"), F.count("*").alias("n"))
    cost = F.lit(0).cast("decimal(38,8)")
    for model, (read, written) in PRICES.items():
        price = lambda p: F.lit(p).cast("decimal(8,4)")
        total = F.col("tokens").cast("decimal(18,0)") * price(read) + (F.col("n") * 500).cast("decimal(18,0)") * price(written)
        cost = F.when(F.col("lang") == model, (total / 1000).cast("decimal(38,8)")).otherwise(cost)
    return t.select(F.col("lang").alias("model"), "n", cost.cast("double").alias("cost"))


@query(f"""WITH s AS (SELECT source, avg(quality) AS p FROM {L} GROUP BY source), b AS (SELECT source, p, p * 1.1::DOUBLE AS q, (p + p * 1.1::DOUBLE) / 2 AS m FROM s WHERE p > 0 AND p * 1.1 < 1)
SELECT source, ceil(pow(1.96::DOUBLE * sqrt(2 * m * (1 - m)) + 0.84::DOUBLE * sqrt(p * (1 - p) + q * (1 - q)), 2) / pow(q - p, 2))::BIGINT AS needed FROM b""")
def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases a variant needs to show a rate a tenth above the source's own; z of 1.96 and 0.84 are fixed."""
    s = labelled(spark, sf_dir).groupBy("source").agg(F.avg("quality").alias("p")).withColumn("q", F.col("p") * 1.1).where("p > 0 AND q < 1")
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    size = F.pow(1.96 * F.sqrt(2 * m * (1 - m)) + 0.84 * F.sqrt(p * (1 - p) + q * (1 - q)), F.lit(2)) / F.pow(q - p, F.lit(2))
    return s.select("source", F.ceil(size).cast("long").alias("needed"))


@query("""WITH v AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant FROM events)
SELECT variant, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS conversions, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / count(DISTINCT user_id), 6) AS rate, round(avg(value), 6) AS mean,
count(*) FILTER (event_type = 'click') AS successes, round(coalesce(sum(value) FILTER (value > 10) / nullif(count(*) FILTER (event_type = 'click'), 0), 0), 4) AS relevance FROM v GROUP BY variant""")
def variant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions over distinct users (repeats count), means, and the sum of relevant values over the successes of each variant."""
    rows = events(spark, sf_dir).withColumn("variant", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment"))
    bought, clicked = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "click")
    return rows.groupBy("variant").agg(
        F.count_distinct("user_id").alias("users"), bought.alias("conversions"), r6(ratio(bought, F.count_distinct("user_id"))).alias("rate"), r6(F.avg("value")).alias("mean"),
        clicked.alias("successes"), F.round(ratio(F.sum(F.when(F.col("value") > 10, F.col("value"))), clicked), 4).alias("relevance"),
    )


@query("""WITH m AS (SELECT event_type AS model, avg(value) AS mean FROM events GROUP BY 1), c AS (SELECT mean FROM m WHERE model = 'view')
SELECT model, round(m.mean, 6) AS mean, round((c.mean - m.mean) / c.mean * 100, 4) AS faster_by, CASE WHEN (c.mean - m.mean) / c.mean > 0.05 THEN 'better' WHEN (c.mean - m.mean) / c.mean < -0.05 THEN 'worse' ELSE 'same' END AS verdict FROM m, c WHERE model <> 'view'""")
def improvement_over_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the mean of each kind of event lies below that of the control kind, in per cent, and a verdict."""
    means = events(spark, sf_dir).groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("mean"))
    control = means.where("model = 'view'").select(F.col("mean").alias("control"))
    share = (F.col("control") - F.col("mean")) / F.col("control")
    verdict = F.when(share > 0.05, "better").when(share < -0.05, "worse").otherwise("same")
    return means.where("model <> 'view'").join(F.broadcast(control)).select("model", r6(F.col("mean")).alias("mean"), F.round(share * 100, 4).alias("faster_by"), verdict.alias("verdict"))


@query("""WITH p AS (SELECT l_suppkey, l_partkey % 40 AS pair, round(avg(l_discount * 10) FILTER (l_linenumber % 2 = 1), 9) AS a, round(avg(l_discount * 10) FILTER (l_linenumber % 2 = 0), 9) AS b,
avg(l_quantity) FILTER (l_linenumber % 2 = 1) AS qa, avg(l_quantity) FILTER (l_linenumber % 2 = 0) AS qb FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (a > b) AS a_wins, count(*) FILTER (b > a) AS b_wins, count(*) FILTER (a = b) AS ties, avg(a) AS ma, avg(b) AS mb, avg(qa) AS la, avg(qb) AS lb FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT l_suppkey, total, a_wins, b_wins, ties, round(ma, 4) AS score_a, round(mb, 4) AS score_b, round(la, 2) AS cost_a, round(lb, 2) AS cost_b,
CASE WHEN mb > ma + 0.03 THEN 'B' WHEN ma > mb + 0.03 THEN 'A' WHEN lb < la * 0.9 THEN 'B' ELSE 'A' END AS choice FROM s""")
def paired_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and ties of odd lines (A) against even ones (B) in the pairs of each supplier, and which to choose.

    The one whose mean score is higher by 0.03, else B if it costs less than nine tenths, else A, the one in use.
    """
    part = lambda odd, value: F.avg(F.when(F.col("l_linenumber") % 2 == odd, value))
    score = F.col("l_discount") * 10
    halves = {"a": F.round(part(1, score), 9), "b": F.round(part(0, score), 9), "qa": part(1, F.col("l_quantity")), "qb": part(0, F.col("l_quantity"))}
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 40).alias("pair")).agg(*(c.alias(n) for n, c in halves.items())).where("a IS NOT NULL AND b IS NOT NULL")
    wins = (F.count_if(F.expr(rule)).alias(n) for n, rule in (("a_wins", "a > b"), ("b_wins", "b > a"), ("ties", "a = b")))
    s = pairs.groupBy("l_suppkey").agg(F.count("*").alias("total"), *wins, *(F.avg(c).alias(n) for n, c in (("ma", "a"), ("mb", "b"), ("la", "qa"), ("lb", "qb"))))
    higher = lambda x, y: F.col(x) > F.col(y) + 0.03
    choice = F.when(higher("mb", "ma"), "B").when(higher("ma", "mb"), "A").when(F.col("lb") < F.col("la") * 0.9, "B").otherwise("A")
    return s.select("l_suppkey", "total", "a_wins", "b_wins", "ties", *(F.round(c, d).alias(n) for n, c, d in (("score_a", "ma", 4), ("score_b", "mb", 4), ("cost_a", "la", 2), ("cost_b", "lb", 2))), choice.alias("choice"))


@query("""SELECT source, count(*) AS total, count(*) FILTER (n_chars > 0) AS with_content, round(count(*) FILTER (n_chars > 0)::DOUBLE / count(*), 6) AS covered, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (n_chars < 200) AS low FROM documents GROUP BY ROLLUP (source)""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with content by source and over all, mean length, and documents of little content."""
    some = F.count_if(F.col("n_chars") > 0)
    return table(spark, sf_dir, "documents").rollup("source").agg(
        F.count("*").alias("total"), some.alias("with_content"), r6(ratio(some, F.count("*"))).alias("covered"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("n_chars") < 200).alias("low")
    )


@query("""SELECT coalesce(lang, 'medium') AS difficulty, count(*) AS n, count(DISTINCT source) AS kinds, round(count(DISTINCT source)::DOUBLE / count(*), 6) AS diversity, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS empty,
count(*) FILTER (length(coalesce(text, '')) < 50) AS short, count(*) FILTER (text LIKE '%the %') AS templated FROM documents GROUP BY 1""")
def completeness_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram with a default, distinct kinds, and answers that are empty, short or follow a template."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("medium")).alias("difficulty")).agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("kinds"), r6(ratio(F.count_distinct("source"), F.count("*"))).alias("diversity"),
        F.count_if(F.length(F.trim(text)) == 0).alias("empty"), F.count_if(F.length(text) < 50).alias("short"), F.count_if(text.contains("the ")).alias("templated"),
    )


@query("""WITH s AS (SELECT source, lang, least(5.0::DOUBLE, n_chars / 1000.0::DOUBLE) AS score FROM documents)
SELECT source, CASE WHEN score >= 4.5 THEN 'excellent' WHEN score >= 4.0 THEN 'good' WHEN score >= 3.0 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM s GROUP BY ALL""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, band = F.least(F.lit(5.0), F.col("n_chars") / 1000), None
    for name, least in BANDS:
        band = F.when(F.col("score") >= least, name) if band is None else band.when(F.col("score") >= least, name)
    rows = table(spark, sf_dir, "documents").select("source", score.alias("score"))
    return rows.groupBy("source", band.otherwise("poor").alias("band")).agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean"), r6(F.min("score")).alias("low"), r6(F.max("score")).alias("high"))


@query("""SELECT split_part(p_type, ' ', 1) AS persona, p_brand AS kind, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY GROUPING SETS ((split_part(p_type, ' ', 1)), (p_brand))""")
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of a chart by the prefix of a name and by kind, in one pass."""
    rows = table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("persona"), F.col("p_brand").alias("kind"), "p_retailprice")
    return rows.groupingSets([["persona"], ["kind"]], "persona", "kind").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("""WITH t AS (SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
j AS (SELECT conv_id, list_has_any(regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+|[a-z0-9]+'), regexp_extract_all(lower(coalesce(before, '')), '[가-힣]+|[a-z0-9]+')) AS kept FROM t WHERE before IS NOT NULL)
SELECT conv_id, count(*) AS followups, round(avg(kept::INT), 6) AS preserved FROM j GROUP BY conv_id""")
def context_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a conversation's turns that take up a word of the turn before."""
    from lexmill.functions.text import tokens

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).where("before IS NOT NULL")
    kept = F.arrays_overlap(tokens(F.coalesce("text", F.lit(""))), tokens(F.col("before")))
    return rows.select("conv_id", F.coalesce(kept, F.lit(False)).alias("kept")).groupBy("conv_id").agg(F.count("*").alias("followups"), r6(F.avg(F.col("kept").cast("int"))).alias("preserved"))


@query(f"""WITH s AS (SELECT lang, source, avg(quality) AS q FROM {L} GROUP BY ALL) SELECT lang, arg_max(source, (round(q, 9), source)) AS best, arg_min(source, (round(q, 9), source)) AS worst FROM s GROUP BY lang""")
def best_and_worst_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labelled(spark, sf_dir).groupBy("lang", "source").agg(F.round(F.avg("quality"), 9).alias("q"))
    return s.groupBy("lang").agg(F.max_by("source", F.struct("q", "source")).alias("best"), F.min_by("source", F.struct("q", "source")).alias("worst"))


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(DISTINCT event_type)::DOUBLE AS covered FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, covered, covered - lag(covered) OVER (PARTITION BY user_id ORDER BY day) AS delta FROM d""")
def coverage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each user and day against the day before."""
    d = events(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("event_type").cast("double").alias("covered"))
    return d.withColumn("delta", F.col("covered") - F.lag("covered").over(Window.partitionBy("user_id").orderBy("day")))


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[가-힣]+|[a-z0-9]+')), lambda x: length(x) >= 2)"


@query(f"""WITH p AS (SELECT conv_id, turn, {_WORDS.format('text')} AS q, {_WORDS.format('lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text)')} AS a, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role FROM conversations),
s AS (SELECT conv_id, turn, least(0.92::DOUBLE, greatest(0.5::DOUBLE, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a))::DOUBLE / len(q) END)) AS relevancy, least(0.95::DOUBLE, greatest(0.5::DOUBLE, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(q, a))::DOUBLE / len(a) END)) AS faithfulness FROM p WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, round(relevancy, 6) AS relevancy, round((relevancy + faithfulness) / 2, 6) AS overall, relevancy >= 0.6 AND faithfulness >= 0.6 AS passed, concat_ws(',', CASE WHEN relevancy < 0.6 THEN 'relevancy' END, CASE WHEN faithfulness < 0.6 THEN 'faithfulness' END) AS reasons FROM s""")
def answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each question in its answer, clipped; an answer passes if every measure reaches the threshold of its stage."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(order)).withColumn("next_role", F.lead("role").over(order)).where("role = 'user' AND next_role = 'assistant'")
    words = lambda c: F.array_distinct(keyword_tokens(F.coalesce(F.col(c), F.lit(""))))
    both = rows.select("conv_id", "turn", words("text").alias("q"), words("answer").alias("a")).withColumn("shared", F.size(F.array_intersect("q", "a")))
    s = both.withColumn("relevancy", clipped(ratio(F.col("shared"), F.size("q")), *RELEVANCY)).withColumn("faithfulness", clipped(ratio(F.col("shared"), F.size("a")), 0.5, 0.95))
    low = [F.when(F.col(m) < STAGES[1], F.lit(m)) for m in ("relevancy", "faithfulness")]
    return s.select("conv_id", "turn", r6(F.col("relevancy")).alias("relevancy"), r6((F.col("relevancy") + F.col("faithfulness")) / 2).alias("overall"), (F.least("relevancy", "faithfulness") >= STAGES[1]).alias("passed"), F.concat_ws(",", *low).alias("reasons"))


@query("""SELECT user_id, event_type, count(*) AS n, left(sha256('search::' || lower(trim(event_type)) || '::user=' || user_id), 32) AS cache_key, left(sha256(user_id || ':' || event_type), 16) AS short_key, count(DISTINCT md5(regexp_replace(props, '"k": *\\d+', ''))) AS without_volatile FROM events GROUP BY ALL""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which answers to a query are kept, and how many different properties are left without the volatile one."""
    user = F.col("user_id").cast("string")
    sha = lambda *parts: F.sha2(F.concat(*parts).cast("binary"), 256)
    told = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct(F.md5(F.regexp_replace("props", r'"k": *\d+', "").cast("binary"))).alias("without_volatile"))
    key = F.left(sha(F.lit("search::"), F.lower(F.trim("event_type")), F.lit("::user="), user), F.lit(32))
    return told.select("user_id", "event_type", "n", key.alias("cache_key"), F.left(sha(user, F.lit(":"), F.col("event_type")), F.lit(16)).alias("short_key"), "without_volatile")


@query("""SELECT event_id, CAST(regexp_extract('Answer: ' || props || ' end', '"k": *(\\d+)', 1) AS INT) AS k FROM events WHERE regexp_matches(props, '"k": *\\d+')""")
def json_inside_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON object inside a free text, read by its schema; texts without one have no row."""
    text = F.concat(F.lit("Answer: "), "props", F.lit(" end"))
    found = F.from_json(F.regexp_extract(text, r"(\{[^{}]*\})", 1), "k int")
    return events(spark, sf_dir).select("event_id", found["k"].alias("k")).where("k IS NOT NULL")
