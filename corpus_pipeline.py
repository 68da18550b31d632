"""A corpus pipeline of four stages: language ID, near-duplicates, mixing to target weights, byte-pair encoding.

``run`` applies STAGES to the table ``documents``; each stage's result is written as Parquet to the shared folder and read
again as the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bpe_forced import encode
from lexmill.llm.common import shared_folder, small_batches
from lexmill.llm.language_mixture import UNDETERMINED, identify, train
from lexmill.llm.near_copies import near_copies
from lexmill.llm.source_mix import mix, word_count

#: A document whose best language has a smaller share than this is rejected: it is no text in a language that was learned.
LEAST_SHARE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text in a language; learns from the documents that have a label. ``lang`` stays as it is given.

    Rejected: null texts, texts without a letter, and mixtures in which no language has a share of ``LEAST_SHARE``. If no
    document has a label, there is no language to know, and none is rejected but those without letters.
    """
    small_batches(spark)
    model = train(docs.select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = identify(docs.select(F.struct(*docs.columns).alias("document")), model, ("document",), inside="document")
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("document.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike to 0.8 in shingles of five words: the smallest by id, null ids last, then digest of the text."""
    small_batches(spark)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    firsts = near_copies(docs, width=5, least=0.8).groupBy("component").agg(F.min(order).alias("first"))
    # both sides name a row alike, without nulls, so that the join and the removal of repeated rows share one shuffle
    named = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__of": F.xxhash64("text")}
    wanted = firsts.select(F.col("first.none").alias("__none"), F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("__id"), F.col("first.of").alias("__of"))
    rows = docs.withColumns(named).join(wanted, [*named], "left_semi")
    return rows.dropDuplicates([*named]).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them; those without words go."""
    copies = mix(docs).where("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "copies").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of"))
    repeated = docs.where(word_count(F.col("text")) > 0).join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies["copies"])))
    return repeated.select(*(docs[c] for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the token ids of every document, and the digest of what they decode to; a null text has none.

    One row for each row of ``docs``, repeated and null ids too; whole texts of any length; no other column is read.
    """
    small_batches(spark)
    made = encode(docs, "word_bpe_49k.json", keep=("source",), outputs=("n_tokens", "ids", "decoded"))
    return made.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("source_mix", mixed),
    ("bpe_encode", encoded),
]

#: Language mixtures, SimHash and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
