"""Retrieval and ranking for batches of queries.

Results are rows (query_id, doc_id, score, rank); equal scores are ordered by doc_id, so every rank is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.functions.text import TOKEN, ratio, tokens

#: BM25 parameters and the rank constant of reciprocal rank fusion.
K1, B, RRF_K = 1.5, 0.75, 60


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf): the inverted index as a table."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(text_col)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term): a row for each document and distinct term in it, so that counting exchanges terms alone, summed by task."""
    return docs.select(F.explode(F.array_distinct(tokens(text_col))).alias("term"))


def term_statistics(index: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) from postings, or rows of distinct terms by document, and a one-row table (n)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(text_col)).cast("long").alias("doc_len"))


def top_k(scored: DataFrame, k: int, partition: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query, with their rank from 1. Spark keeps k rows per task before it shuffles."""
    order = Window.partitionBy(partition).orderBy(F.desc(score), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: So many terms of queries are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """Top k documents of each query (query_id, text), by the score at ``digits`` decimals, so that the order of sums is no tie-break.

    Postings are counted with the length of their document beside them, and only those of query terms: the semi-join on the
    distinct terms comes before the one exchange of postings, so a large corpus sends on what the queries touch.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    wanted = asked.select("term").distinct()
    small = asked.count() <= BROADCAST_TERMS
    told = docs.select("doc_id", tokens("text").alias("t")).select("doc_id", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    # postings of a document stay together until its scores are summed
    exploded = told.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").repartition("doc_id")
    index = exploded.groupBy("term", "doc_id", "doc_len").agg(F.count("*").alias("tf"))
    corpus = docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.regexp_count(F.lower("text"), F.lit(TOKEN)), F.lit(-1))).alias("avg_len"))
    terms = term_statistics(index, corpus.select("n"))
    weighed = index.join(F.broadcast(terms) if small else terms, "term").join(F.broadcast(corpus.select("avg_len")))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    hits = weighed.select("term", "doc_id", (F.col("idf") * tf).alias("part")).join(F.broadcast(asked) if small else asked, "term")
    return top_k(hits.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if one vector is zero."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Query vectors that are broadcast at once (more are asked in blocks), and scores that a task holds at once.
QUERY_BLOCK, SCORES = 10_000, 4_000_000


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in rows, of length one, and how many components each has. Null and zero vectors and those with a null are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat, row = pc.list_flatten(column), np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows, inside = np.zeros((len(lengths), width)), at < width
    rows[row[inside], at[inside]] = np.asarray(pc.fill_null(flat, 0).cast(pa.float64()))[inside]
    if flat.null_count:
        rows[row[np.asarray(flat.is_null())]] = 0
    norm = np.sqrt((rows * rows).sum(1))
    with np.errstate(invalid="ignore"):
        return rows / np.where(norm == 0, 1, norm)[:, None], lengths


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, digits: int = 9, clip: tuple[float, float] | None = None) -> DataFrame:
    """Exact top k vectors for a stated set of queries (query_id, embedding), in blocks of about ``QUERY_BLOCK`` that are broadcast.

    Every vector is compared with every query, as products of matrices; a task keeps the k best of each query and passes on those
    alone. A query is no result of its own. If queries have a column ``only``, results have that ``label`` where it is not null.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    labelled = "only" in queries.columns
    kind = vectors.schema["doc_id"].dataType
    asked_kind = queries.schema["query_id"].dataType
    rows = vectors.where("doc_id IS NOT NULL").select("doc_id", "embedding", *(["label"] if labelled else []))
    found = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        asked = mine.where("query_id IS NOT NULL").select("query_id", "embedding", *(["only"] if labelled else [])).toArrow()
        names = asked.column("query_id").to_pylist()
        width = max([len(v) for v in asked.column("embedding").to_pylist() if v] or [0])
        shared = vectors.sparkSession.sparkContext.broadcast((names, *_matrix(asked.column("embedding"), width), asked.column("only").to_pylist() if labelled else None))

        def best(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            names, q, sizes, only = shared.value
            place = {}
            for i, name in enumerate(names):
                place.setdefault(name, []).append(i)
            codes = {v: i for i, v in enumerate(sorted({v for v in only or () if v is not None}))}
            wants = np.array([-1 if v is None else codes[v] for v in only], dtype=int) if labelled else None
            if not names:
                return
            floor = np.full(len(names), -np.inf if threshold is None else float(threshold))
            plain = pa.types.is_integer(to_arrow_type(kind))
            # the best so far: place of the query, order, score, id
            top = [np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, np.int64 if plain else object)]
            step, even = max(1, SCORES // len(names)), bool((sizes == sizes[0]).all())
            for batch in batches:
                start = 0
                while start < batch.num_rows:
                    # few rows fill the lists, so that the others meet a floor
                    part = batch.slice(start, step if len(top[0]) else min(step, 16 * k))
                    start += part.num_rows
                    x, lengths = _matrix(part.column(1), width)
                    scores = x @ q.T
                    if not even or (lengths != sizes[0]).any():
                        scores[lengths[:, None] != sizes] = 0
                    if clip:
                        scores = np.where(np.isnan(scores), clip[1], np.clip(scores, *clip))
                    hit = ~(scores < floor - 10.0**-digits)
                    if labelled:
                        own = np.array([codes.get(v, -2) for v in part.column(2).to_pylist()], dtype=int)
                        hit &= (wants < 0) | (own[:, None] == wants)
                    ids = part.column(0).to_numpy(zero_copy_only=False) if plain else np.array([*part.column(0).to_pylist(), None], object)[:-1]
                    for i, name in enumerate(ids.tolist()):
                        if name in place:
                            hit[i, place[name]] = False
                    row, col = np.nonzero(hit)
                    score = scores[row, col]
                    order = np.where(np.isnan(score), np.inf, np.round(score, digits))
                    if threshold is not None:
                        row, col, score, order = (v[order >= threshold] for v in (row, col, score, order))
                    if not len(row):
                        continue
                    top = [np.concatenate(p) for p in zip(top, (col, order, score, ids[row]))]
                    names_at = top[3] if plain else np.unique(top[3], return_inverse=True)[1]
                    at = np.lexsort((names_at, -top[1], top[0]))
                    nth = np.arange(len(at)) - np.searchsorted(top[0][at], top[0][at])
                    at, last = at[nth < k], at[nth == k - 1]
                    floor[top[0][last]] = top[1][last]
                    top = [p[at] for p in top]
            ids_of = [names[i] for i in top[0]]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of, to_arrow_type(asked_kind)), pa.array(list(top[3]), to_arrow_type(kind)), pa.array(top[2], pa.float64())], ["query_id", "doc_id", "score"])

        told = rows.mapInArrow(best, f"query_id {asked_kind.simpleString()}, doc_id {kind.simpleString()}, score double").withColumn("score", F.round("score", digits))
        one = top_k(told, k)
        found = one if found is None else found.unionByName(one)
    return found


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], k: int = 10, rrf_k: int = RRF_K, digits: int = 12) -> DataFrame:
    """Fuse ranked lists (query_id, doc_id, rank) with weights: the sum of weight / (rrf_k + rank)."""
    union = None
    for ranked, weight in lists:
        part = ranked.select("query_id", "doc_id", (F.lit(weight) / (rrf_k + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    return top_k(union.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score")), k)


def min_max(score: str = "score", partition: str = "query_id") -> Column:
    """Score scaled to [0, 1] among the rows of a query; 1 if all are equal."""
    w = Window.partitionBy(partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def calibrated(score: str = "score", partition: str = "query_id") -> Column:
    """Sigmoid of score / 0.5, scaled to [0.1, 0.95] among the rows of a query; .5 for no range; a single row is not scaled."""
    w = Window.partitionBy(partition)
    s = 1 / (1 + F.exp(-F.col(score) / 0.5))
    low, high, n = F.min(s).over(w), F.max(s).over(w), F.count("*").over(w)
    return F.when(n == 1, s).when(high - low < 1e-6, 0.5).otherwise(0.1 + 0.85 * (s - low) / (high - low))


def adaptive_filter(ranked: DataFrame, threshold: float) -> DataFrame:
    """Rows of at least the threshold; the best row of a query where none reaches it."""
    none = F.max(F.col("score") >= threshold).over(Window.partitionBy("query_id")) == F.lit(False)
    return ranked.withColumn("none", none).where((F.col("score") >= threshold) | F.col("none") & (F.col("rank") == 1)).drop("none")


def first_of_group(ranked: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("place = 1").drop("place")


def dynamic_rrf_k(query: Column) -> Column:
    """35 for article references, 45 for names, 70 for questions, otherwise 60."""
    return F.when(query.rlike("제\\d+조"), 35).when(query.rlike("(규정|학칙|세칙|지침)$"), 45).when(query.rlike("[?？]|어떻게|무엇|how|what"), 70).otherwise(60)


def hybrid_weights(query: Column) -> Column:
    """struct<sparse, dense> by the kind of query; fixed values."""
    english = F.length(F.regexp_replace(query, r"[^\x00-\x7F]", "")) > 0.7 * F.length(query)
    pair = lambda s, d: F.struct(F.lit(s).alias("sparse"), F.lit(d).alias("dense"))
    return F.when(query.rlike("제\\d+조"), pair(0.9, 0.1)).when(english, pair(0.2, 0.8)).when(query.rlike("[?？]"), pair(0.65, 0.35)).otherwise(pair(0.75, 0.25))


def choose_k(complexity: Column) -> Column:
    """How many results a query of a complexity gets."""
    return F.when(complexity == "simple", 5).when(complexity == "medium", 10).when(complexity == "complex", 15).otherwise(20)
