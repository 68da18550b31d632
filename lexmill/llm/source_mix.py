"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. A source that should give ``target`` words takes each of its documents
``floor(target / size)`` times and once more those documents whose hash lies below a threshold. The threshold is found
without sorting: sizes are summed by source and hash bucket, the bucket in which the running sum passes the budget is
the boundary, and only that bucket's documents are summed again over the next, nested digits of the hash. Then the
documents are filtered by comparing hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, cut_lineage

#: Buckets of a histogram, and how many nested ones there are: 10 bits each.
BITS, LEVELS = 10, 3


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """A fixed hash of ``BITS * LEVELS`` bits: the first digits of the md5 of the id as text."""
    text = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.shiftright(F.conv(text, 16, 10).cast("long"), 32 - BITS * LEVELS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target double) from one row per source (source, source_size).

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share ``share`` times all words;
    none gets over ``cap`` times its own words, and what that leaves over is shared again by weight. In closed form: in
    the order of source_size / weight, the first k sources are capped, with the smallest k whose share caps no other.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", cycle)
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    told = weighed.select(
        "source", "source_size", "weight",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
        F.sum("source_size").over(whole).alias("all_size"),
    ).withColumn("rate", (F.lit(share) * F.col("all_size") - F.lit(cap) * F.col("capped")) / F.col("open_weight"))
    fits = F.col("rate") * F.col("weight") <= F.lit(cap) * F.col("source_size")
    rate = F.min(F.when(fits, F.struct("capped", "rate")).otherwise(None)).over(whole)["rate"]
    told = told.withColumn("shared", rate)
    share_of = F.col("shared") * F.col("weight")
    top = F.lit(cap) * F.col("source_size")
    return told.select("source", "source_size", F.when(share_of <= top, share_of).otherwise(top).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size long, target double, copies int, taken long): one row for each row of ``docs``.

    ``taken`` is ``copies`` times the document's size. A null source is a source of its own. Rows that repeat a doc_id share
    its hash, so they are taken alike. Documents without words are never taken, nor is anything from an empty table. A
    source misses its target by at most half of the documents that share the boundary hash, so usually half a document.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = cut_lineage(read.withColumn("hash", document_hash(F.col("doc_id"))))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap))))
    plan = cut_lineage(
        wanted.withColumn("full", F.coalesce(full, F.lit(0)).cast("int"))
        .withColumn("left", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("edge", F.lit(0).cast("long"))
    )
    for level in range(1, LEVELS + 1):
        plan = cut_lineage(narrowed(rows, plan, level))
    extra = F.when(F.col("hash") < F.col("edge"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(F.col("full") + extra, F.lit(int(cap)))).otherwise(0).cast("int")
    joined = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def narrowed(rows: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """``plan`` with ``edge`` (the lowest hash of the boundary bucket) one histogram finer and ``left`` less what lies below.

    At the last level the edge moves past the boundary bucket if that comes nearer to the budget.
    """
    shift = BITS * (LEVELS - level)
    digit = F.shiftright(F.col("hash"), shift)
    inside = rows.where("size > 0").join(plan.select(F.col("source").alias("of"), "edge"), F.col("source").eqNullSafe(F.col("of")))
    if level > 1:
        inside = inside.where(F.shiftright(F.col("hash"), shift + BITS) == F.shiftright(F.col("edge"), shift + BITS))
    histogram = inside.groupBy("of", digit.alias("digit")).agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("of").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumn("upto", F.sum("words").over(so_far))
    with_budget = summed.join(plan.select(F.col("source").alias("to"), "left"), F.col("of").eqNullSafe(F.col("to")))
    passing = F.col("upto") > F.col("left")
    found = with_budget.groupBy("of").agg(
        F.min(F.when(passing, F.struct("digit", "words", "upto"))).alias("at"),
        F.max("digit").alias("last"), F.max("upto").alias("total"),
    )
    if level < LEVELS:
        edge, below = F.shiftleft(F.col("at.digit"), shift), F.col("at.upto") - F.col("at.words")
    else:
        nearer = F.col("at.upto") - F.col("left") <= F.col("left") - (F.col("at.upto") - F.col("at.words"))
        edge, below = F.col("at.digit") + F.when(nearer, 1).otherwise(0), F.col("at.upto") - F.col("at.words")
    past = F.shiftleft(F.col("last") + 1, shift)
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select(
        "source", "source_size", "target", "full",
        F.coalesce(F.when(F.col("at").isNotNull(), F.col("left") - below), F.col("left") - F.col("total"), F.col("left")).alias("left"),
        F.coalesce(F.when(F.col("at").isNotNull(), edge), past, F.col("edge")).alias("edge"),
    )


def _oracle() -> str:
    last = (1 << BITS * LEVELS) - 1
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT >> {32 - BITS * LEVELS}) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, coalesce(sum(source_size) OVER o, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight,
      sum(source_size) OVER () AS all_size FROM w
      WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * capped) / open_weight AS rate FROM r),
z AS (SELECT *, (SELECT rate FROM q WHERE rate * weight <= 2.0::DOUBLE * source_size ORDER BY capped, rate LIMIT 1) AS shared FROM q),
t AS (SELECT source, source_size, CASE WHEN shared * weight <= 2.0::DOUBLE * source_size THEN shared * weight ELSE 2.0::DOUBLE * source_size END AS target FROM z),
p AS (SELECT *, CAST(coalesce(least(floor(target / nullif(source_size, 0)), 2), 0) AS INT) AS full_times FROM t),
b AS (SELECT *, target - full_times * source_size AS budget FROM p),
h AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT h.source, h.h, words, sum(words) OVER (PARTITION BY h.source ORDER BY h.h) AS upto, budget
      FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
k AS (SELECT source, h FROM c WHERE upto <= budget OR (upto - words <= budget AND upto - budget <= budget - (upto - words)))
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(CASE WHEN d.size = 0 THEN 0 ELSE least(full_times + CASE WHEN k.h IS NULL THEN 0 ELSE 1 END, 2) * d.size END AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h AND d.h <= {last}"""


#: DuckDB SQL for the mix of the table ``documents`` with the default parameters.
ORACLE_SQL = _oracle()
