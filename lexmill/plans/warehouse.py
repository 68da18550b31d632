"""Relational queries over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.plans.registry import query
from lexmill.sources.tables import table


@query("""SELECT r_name, n_name, date_part('year', o_orderdate)::INT AS year, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region, nation and year."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return joined.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("lines"), F.round(revenue, 2).alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 9) AS avg_discount, count(*) AS lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 9).alias("avg_discount"), F.count("*").alias("lines")
    )


@query("""SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 10""")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("r", place).where("r <= 10").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS f, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS o, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS p FROM orders GROUP BY 1""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return told.select("o_orderpriority", *(F.round(F.coalesce(F.col(s), F.lit(0.0)), 2).alias(s.lower()) for s in ("F", "O", "P")))
