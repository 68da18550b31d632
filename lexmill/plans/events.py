"""Event and conversation queries: experiments, percentiles, trends, sessions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import stats
from lexmill.functions.text import jaccard, ratio, tokens
from lexmill.operators import evaluate
from lexmill.plans.registry import query
from lexmill.sources.tables import table
from lexmill.streaming.windows import sessions, tumbling


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
h AS (SELECT event_type, avg(value) FILTER (r <= floor(n / 2)) AS early, avg(value) FILTER (r > floor(n / 2)) AS late FROM r GROUP BY event_type)
SELECT event_type, round(early, 6) AS early, round(late, 6) AS late, CASE WHEN late - early > 0.02 THEN 'improving' WHEN late - early < -0.02 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def trend_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evaluate.halves_trend(events(spark, sf_dir), "event_type", ["ts", "event_id"], "value")
    return told.select("event_type", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), "trend")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL)
SELECT event_type, day, round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM d""")
def moving_average_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-2, 0)
    return daily.select("event_type", "day", F.round(F.avg("v").over(w), 6).alias("moving"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS top FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    found = events(spark, sf_dir).groupBy("event_type").agg(p.alias("p"), F.max("value").alias("top"))
    return found.select("event_type", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), "top")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS at FROM r WHERE i = least(floor(n * 0.95::DOUBLE), n - 1)""")
def nearest_index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_index_percentile(events(spark, sf_dir).select("event_type", "value"), "event_type", "value", 0.95)


BUCKET = "('0x' || substr(sha256(user_id::VARCHAR || ':ranker'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"SELECT DISTINCT user_id, round({BUCKET}, 9) AS bucket, CASE WHEN {BUCKET} <= 0.5 THEN 'control' ELSE 'treatment' END AS variant FROM events")
def ab_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = stats.bucket(F.col("user_id"), "ranker")
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", F.round(place, 9).alias("bucket"), F.when(place <= 0.5, "control").otherwise("treatment").alias("variant"))


@query(f"""WITH u AS (SELECT user_id, CASE WHEN {BUCKET} <= 0.5 THEN 0 ELSE 1 END AS t, count(*) FILTER (event_type = 'purchase') > 10 AS c FROM events GROUP BY user_id),
g AS (SELECT count(*) FILTER (t = 0)::DOUBLE AS n0, count(*) FILTER (t = 0 AND c)::DOUBLE AS c0, count(*) FILTER (t = 1)::DOUBLE AS n1, count(*) FILTER (t = 1 AND c)::DOUBLE AS c1 FROM u),
z AS (SELECT *, (c0 + c1) / (n0 + n1) AS pool FROM g), y AS (SELECT *, sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1)) AS se FROM z),
x AS (SELECT *, CASE WHEN n0 = 0 OR n1 = 0 OR se = 0 THEN 0 ELSE (c1 / n1 - c0 / n0) / se END AS z FROM y), e AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS w, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM x)
SELECT n0, c0, n1, c1, round(z, 9) AS z, round(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-w * w), 9) AS p FROM e""")
def ab_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than ten purchases, control against treatment."""
    users = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("bought"))
    variant = F.when(stats.bucket(F.col("user_id"), "ranker") <= 0.5, "control").otherwise("treatment")
    told = evaluate.experiment(users.withColumn("variant", variant), F.col("bought") > 10)
    return told.select("n0", "c0", "n1", "c1", F.round("z", 9).alias("z"), F.round("p", 9).alias("p"))


@query("""SELECT user_id, count(*) AS errors, min(event_id) AS first_event FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY errors DESC, first_event LIMIT 5""")
def feedback_top_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five users with most errors; ties go to the earlier first error."""
    counts = events(spark, sf_dir).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"), F.min("event_id").alias("first_event"))
    return counts.orderBy(F.desc("errors"), "first_event").limit(5)


@query("""SELECT event_type, count(*) FILTER (value >= 50) AS hits, count(*) AS total, round(coalesce(count(*) FILTER (value >= 50)::DOUBLE / nullif(count(*), 0), 0), 9) AS hit_rate FROM events GROUP BY event_type""")
def hit_rate_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, total = F.count_if(F.col("value") >= 50), F.count("*")
    return events(spark, sf_dir).groupBy("event_type").agg(hits.alias("hits"), total.alias("total"), F.round(ratio(hits, total), 9).alias("hit_rate"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS events, date_diff('second', min(ts), max(ts)) AS seconds, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY user_id, n""")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sessions(events(spark, sf_dir), "user_id", "6 hours")
    seconds = F.unix_seconds(F.date_trunc("second", "last").cast("timestamp")) - F.unix_seconds(F.date_trunc("second", "first").cast("timestamp"))
    return told.select("user_id", "events", seconds.alias("seconds"), F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS events, round(sum(value), 4) AS total, count(*) > 15 AS limited FROM events GROUP BY 1""")
def tumbling_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = tumbling(events(spark, sf_dir), "1 hour")
    return told.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "events", F.round("total", 4).alias("total"), (F.col("events") > 15).alias("limited"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def ring_buffer_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events(spark, sf_dir).withColumn("r", place).where("r <= 10").select("user_id", "event_id")


@query("""WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id)
SELECT user_id, now - last > INTERVAL 24 HOURS AS expired FROM l, m""")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users idle for more than a day at the time of the last event."""
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"))
    now = last.agg(F.max("last").alias("now"))
    return last.join(F.broadcast(now)).select("user_id", (F.col("now") - F.col("last") > F.expr("INTERVAL 24 HOURS")).alias("expired"))


@query("""SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, max((props->>'k')::BIGINT) AS top FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@query("""WITH u AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id AS vu, ts AS vt FROM events WHERE event_type = 'view')
SELECT event_id, (SELECT max(vt) FROM v WHERE vu = u.user_id AND vt <= u.ts) IS NOT NULL AS seen, date_diff('second', date_trunc('second', (SELECT max(vt) FROM v WHERE vu = u.user_id AND vt <= u.ts)), date_trunc('second', ts)) AS waited FROM u""")
def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last view before: one window over the union of both sides, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events(spark, sf_dir).where("event_type IN ('purchase', 'view')").withColumn("kind", F.when(F.col("event_type") == "view", 0).otherwise(1))
    found = both.withColumn("last", F.max(F.when(F.col("kind") == 0, F.col("ts"))).over(w)).where("kind = 1")
    second = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    return found.select("event_id", F.col("last").isNotNull().alias("seen"), (second("ts") - second("last")).alias("waited"))


TOK = "regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+|[a-z0-9]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOK}) AS t FROM conversations WHERE role = 'user'),
p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, turn, CASE WHEN len(t) = 0 AND len(before) = 0 THEN false ELSE coalesce(len(list_intersect(t, before))::DOUBLE / nullif(len(list_distinct(t || before)), 0), 0) < 0.1 END AS changed FROM p WHERE before IS NOT NULL""")
def topic_change_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that share less than a tenth of their words with the user turn before."""
    words = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("t"))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return words.withColumn("before", before).where("before IS NOT NULL").select("conv_id", "turn", (jaccard(F.col("t"), F.col("before")) < 0.1).alias("changed"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("r", place).where("r <= 3").select("conv_id", "turn", "role")


@query("""WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(CASE WHEN before IS NOT NULL AND length(text) < 60 THEN before || ' ' || text ELSE text END) AS expanded_md5 FROM u""")
def followup_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short user turns are read with the user turn before them."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    before = users.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    expanded = F.when(F.col("before").isNotNull() & (F.length("text") < 60), F.concat_ws(" ", "before", "text")).otherwise(F.col("text"))
    return before.select("conv_id", "turn", F.md5(expanded.cast("binary")).alias("expanded_md5"))


@query("""WITH p AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
SELECT role, next_role, count(*) AS n FROM p GROUP BY ALL""")
def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("role", after.alias("next_role")).groupBy("role", "next_role").agg(F.count("*").alias("n"))
