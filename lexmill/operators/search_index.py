"""A search index on disk: postings in blocks, greatest part first, and an exact top k that scores few of them.

``build`` writes three tables below a folder: ``corpus`` (one row), ``terms`` (term, df, idf, best) and ``blocks``, partitioned by a
hash of the term and sorted by it. A block holds up to ``BLOCK`` postings of a term, by their part of a score, and ``best``, the
greatest. A part is what BM25 multiplies the term's weight with, so a search needs no lengths.

``search`` first sums the first blocks of a query's terms; the k-th best sum is a score that k documents reach at least. The terms
of least weight which together stay below it cannot bring a document in by themselves. Candidates come from the other terms alone;
those that cannot reach the score any more go, and only for the rest the postings of the light terms are looked up. Hits are
those of `ranking.bm25`, ties included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN, tokens
from lexmill.operators.ranking import B, BROADCAST_TERMS, K1, top_k
from lexmill.sources.tables import cut

#: Postings of a block, folders of blocks, and postings of a part of the table, about.
BLOCK, BUCKETS, POSTINGS = 128, 64, 4_000_000


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, block: int = BLOCK, mode: str = "errorifexists") -> None:
    """Write the index of ``docs`` below ``path``, a folder that all executors reach.

    Null texts count as documents without tokens. Ids name documents: rows that repeat one are documents of their own that a
    search adds up, as `ranking.bm25` does. The postings of a frequent term are sorted by many tasks, split by their parts.
    """
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lengths = F.coalesce(F.regexp_count(F.lower("text"), F.lit(TOKEN)), F.lit(-1))
    corpus = texts.agg(F.count("*").alias("n"), F.avg(lengths).alias("avg_len"), F.sum(lengths).alias("tokens")).first()
    average = corpus.avg_len or 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = re.compile(TOKEN)
        for batch in batches:
            term, tf, sizes, lengths = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = form.findall(text or "")
                counted = Counter(found)
                term.extend(counted)
                tf.extend(counted.values())
                sizes.append(len(counted))
                lengths.append(len(found))
            row, tf = np.repeat(np.arange(len(sizes)), sizes), np.array(tf, float)
            part = tf * (k1 + 1) / (tf + (k1 * (1 - b + b * np.array(lengths, float) / average))[row])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(term, pa.string()), pa.array(part, pa.float64())], ["doc_id", "term", "part"])

    postings = texts.select("doc_id", F.lower("text").alias("text")).mapInArrow(count, f"doc_id {kind.simpleString()}, term string, part double").withColumn("bucket", bucket_of("term"))
    parts = max(1, (corpus.tokens or 0) // POSTINGS + 1)
    ordered = postings.repartitionByRange(parts, "bucket", "term", F.desc("part")).sortWithinPartitions("bucket", "term", F.desc("part"), "doc_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "best", "docs", "parts", "bucket"]

        def packed(rows: pa.Table, starts: np.ndarray, stop: int) -> pa.RecordBatch:
            docs, term, part, bucket = (rows.column(c).combine_chunks() for c in ("doc_id", "term", "part", "bucket"))
            ends, at = pa.array(np.r_[starts, stop].astype(np.int32)), pa.array(starts)
            return pa.RecordBatch.from_arrays([term.take(at), part.take(at), pa.ListArray.from_arrays(ends, docs.slice(0, stop)), pa.ListArray.from_arrays(ends, part.slice(0, stop)), bucket.take(at)], names)

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            term = rows.column("term").combine_chunks()
            first = np.flatnonzero(np.r_[True, np.asarray(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)))])
            count = -(-np.diff(np.r_[first, len(term)]) // block)
            starts = np.repeat(first, count) + block * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            # the last block may go on in the next batch
            if len(starts) > 1:
                yield packed(rows, starts[:-1], int(starts[-1]))
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield packed(held, np.zeros(1, int), held.num_rows)

    schema = f"term string, best double, docs array<{kind.simpleString()}>, parts array<double>, bucket int"
    ordered.mapInArrow(blocks, schema).write.mode(mode).partitionBy("bucket").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    written = spark.read.parquet(f"{path}/blocks") if (corpus.tokens or 0) > 0 else spark.createDataFrame([], schema)
    df = written.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max("best").alias("best"))
    n = F.lit(corpus.n)
    df.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "best").write.mode(mode).parquet(f"{path}/terms")
    spark.createDataFrame([(corpus.n, corpus.avg_len, k1, b)], "n long, avg_len double, k1 double, b double").write.mode(mode).parquet(f"{path}/corpus")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the top k documents of each query (query_id, text). Terms that the index lacks count nothing."""
    hits, _ = _search(spark, path, queries, k, digits)
    return hits


def _search(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    terms = spark.read.parquet(f"{path}/terms")
    words = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    small = words.count() <= BROADCAST_TERMS
    near = F.broadcast if small else (lambda frame: frame)
    asked = terms.join(near(words), "term").select("query_id", "term", "idf", (F.col("idf") * F.col("best")).alias("most"), bucket_of("term").alias("bucket"), "best")
    if terms.isEmpty():
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, score double, rank int"), {}
    blocks = spark.read.parquet(f"{path}/blocks")

    def parts(of: DataFrame, which=None) -> DataFrame:
        """(query_id, doc_id, part of the score) of all postings of asked terms, or of the blocks that ``which`` chooses."""
        read = blocks if which is None else blocks.withColumnRenamed("best", "top")
        met = read.drop("best").join(near(of), ["bucket", "term"]) if which is None else read.join(near(of), ["bucket", "term"]).where(which)
        return met.select("query_id", "idf", F.explode(F.arrays_zip("docs", "parts")).alias("p")).select("query_id", F.col("p.docs").alias("doc_id"), (F.col("idf") * F.col("p.parts")).alias("part"))

    first = parts(asked, F.col("top") == F.col("best")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    floor = top_k(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    light = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a rounded score may be as much above the sum as half a unit of its last digit, and sums of another order differ in their last bits
    slack = 10.0 ** -digits
    # the terms of the queries are few; without the cuts each use would sum the first blocks again
    ranked = cut(asked.join(near(floor), "query_id", "left").withColumn("light", light < F.coalesce("floor", F.lit(0.0)) - slack).drop("best"))
    heavy = cut(parts(ranked.where("NOT light").select("query_id", "term", "idf", "bucket")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("part")))
    # sums over all postings of the heavy terms are a better floor than those over first blocks
    higher = top_k(heavy, k, score="part").where(F.col("rank") == k).select("query_id", F.col("part").alias("higher"))
    reach = ranked.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("light"), F.col("most"))), F.lit(0.0)).alias("rest")).join(higher, "query_id", "left")
    kept = F.col("part") + F.col("rest") >= F.coalesce("higher", F.lit(0.0)) - slack
    candidates = cut(heavy.join(near(reach), "query_id").where(kept).select("query_id", "doc_id", "part"))
    looked = parts(ranked.where("light").select("query_id", "term", "idf", "bucket"))
    if candidates.count() <= BROADCAST_TERMS:
        looked = looked.join(F.broadcast(candidates.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")
    # sums that hold no candidate go once they are added up: many candidates meet their light postings in one exchange, without a join
    # exchanged before they are summed, or tasks would hold sums of all documents of their postings
    both = candidates.withColumn("candidate", F.lit(True)).unionByName(looked.withColumn("candidate", F.lit(False))).repartition("query_id", "doc_id")
    summed = both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"), F.max("candidate").alias("candidate"))
    scores = summed.where("candidate").select("query_id", "doc_id", F.round("part", digits).alias("score"))
    return top_k(scores, k), {"heavy": heavy, "candidates": candidates, "looked": looked, "ranked": ranked}
