"""Evaluation statistics: summaries, gates, failures, trends, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import stats
from lexmill.functions.text import ratio

#: How fixable a class of failures is.
FIXABILITY = {"retrieval": 0.8, "length": 0.6, "language": 0.4, "unknown": 0.2}


def summary(scored: DataFrame, by: list[str], score: str, passed: str) -> DataFrame:
    """Count, mean, population deviation, bounds and pass rate of each group."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("deviation"), F.min(score).alias("low"), F.max(score).alias("high"),
        ratio(F.count_if(F.col(passed)), F.count("*")).alias("pass_rate"),
    )


def halves_trend(points: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Mean of the first and the second half of each series (an odd middle counts as second) and the trend."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(by))
    split = points.withColumn("early", place <= F.floor(n / 2))
    means = split.groupBy(by).agg(F.avg(F.when(F.col("early"), F.col(value))).alias("early"), F.avg(F.when(~F.col("early"), F.col(value))).alias("late"))
    return means.withColumn("trend", stats.trend(F.col("early"), F.col("late")))


def experiment(assigned: DataFrame, converted: Column) -> DataFrame:
    """One row: users and conversions of both variants, z, two-tailed p and the Wilson interval of the treatment."""
    one = assigned.agg(
        F.count_if(F.col("variant") == "control").cast("double").alias("n0"), F.count_if((F.col("variant") == "control") & converted).cast("double").alias("c0"),
        F.count_if(F.col("variant") == "treatment").cast("double").alias("n1"), F.count_if((F.col("variant") == "treatment") & converted).cast("double").alias("c1"),
    )
    z = one.withColumn("z", stats.z_score(F.col("c0"), F.col("n0"), F.col("c1"), F.col("n1")))
    return z.withColumn("p", stats.two_tailed_p(F.col("z"))).withColumn("wilson", stats.wilson(F.col("c1"), F.col("n1")))


def failures(rows: DataFrame, kind: Column, score: str, k: int = 5) -> DataFrame:
    """Top classes of failures: count, mean score and up to k examples with the smallest ids."""
    classed = rows.withColumn("kind", kind)
    example = F.row_number().over(Window.partitionBy("kind").orderBy("doc_id"))
    counts = classed.groupBy("kind").agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    shown = classed.withColumn("r", example).where(F.col("r") <= k).groupBy("kind").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    return counts.join(shown, "kind").orderBy(F.desc("n"), "kind").limit(k)


def keep_best(parts: DataFrame, key: list[str], score: str, order: list[Column]) -> DataFrame:
    """Of the rows of each key the one with the best score; earlier rows win ties."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), *order))
    return parts.withColumn("place", place).where("place = 1").drop("place")


def nearest_index_percentile(values: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """The value at index floor(n * share) of each sorted group, counted from 0 and kept inside it."""
    w = Window.partitionBy(by)
    place = F.row_number().over(w.orderBy(value)) - 1
    n = F.count("*").over(w)
    at = F.least(F.floor(n * F.lit(share)), n - 1)
    return values.withColumn("keep", place == at).where("keep").select(by, F.col(value).alias("at"))
