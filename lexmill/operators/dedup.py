"""Duplicates, likeness of sets, chunks and names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.sources.tables import cut


#: Slots of the table by whose counts tokens are ordered, and of a part of it; bits of a signature; ids of texts that are broadcast.
SLOTS, SLOT_PART, BITS, KNOWN_IDS = 1 << 20, 1 << 16, 1024, 1_000_000


def group_copies(docs: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, first_id, copies) by a key. Groups are summed before the join, so a hot key is one row on that side."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"))
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return keyed.join(groups.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of"))).select("doc_id", "first_id", "copies")


def jaccard_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) for pairs of different texts by their token sets, through prefix filtering.

    Sets that reach the threshold share a token among their rarest ones, so candidates come from those alone and frequent tokens
    join nothing. Any one order of all tokens will do: it is by a table of counts with ``SLOTS`` slots, then by hash, so that only
    prefixes of hashes are exchanged. Pairs that cannot reach the threshold go by the places of the tokens that they share, then by
    signatures: the parity of the tokens in each of ``BITS`` slots, which differ in no more bits than sets differ in tokens. Texts
    of what is left alone are read again, and their tokens compared. Texts that are equal are one text, with the smallest id.
    """
    known = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), F.array_distinct(tokens("text")).alias("t")).where(F.size("t") > 0)
    hashed = known.select("doc_id", "h", F.transform("t", lambda t: F.xxhash64(t)).alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int32)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS).astype(np.int32)
        parts = total.reshape(-1, SLOT_PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    table, columns = np.zeros((SLOTS // SLOT_PART, SLOT_PART), np.int32), "part int, counts binary"
    for part, counts in hashed.select("t").mapInArrow(count, columns).repartition("part").mapInArrow(add, columns).collect():
        table[part] = np.frombuffer(bytes(counts), np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(table.ravel())

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes, signs = [], [], []
            for terms in batch.column(2):
                terms = terms.values.to_numpy()
                order = np.lexsort((terms, shared.value[terms & (SLOTS - 1)]))
                sizes.append(len(terms))
                prefixes.append(terms[order[: len(terms) - math.ceil(threshold * len(terms)) + 1]])
                signs.append(np.packbits((np.bincount(terms >> 40 & (BITS - 1), minlength=BITS) & 1).astype(np.uint8)).view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x or [np.zeros(0, np.int64)]))) for x in (prefixes, signs)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(sizes, pa.int32()), *lists], ["h", "doc_id", "size", "prefix", "sign"])

    rows = hashed.mapInArrow(rarest, f"h binary, doc_id {kind}, size int, prefix array<long>, sign array<long>")
    first = F.min_by(F.struct("doc_id", "size", "prefix", "sign"), "doc_id")
    texts = cut(rows.where("doc_id IS NOT NULL").groupBy("h").agg(first.alias("x")).select("x.*"))
    prefix = texts.select("doc_id", "size", F.posexplode("prefix").alias("r", "term"))
    left = prefix.select("term", F.col("doc_id").alias("a"), F.col("size").alias("m"), (F.col("r") + 1).alias("i"))
    right = prefix.select("term", F.col("doc_id").alias("b"), F.col("size").alias("n"), (F.col("r") + 1).alias("j"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("m") + F.col("n")) - 1e-6
    # what both sets share stands up to this token in both, or behind it in both
    fits = (F.col("a") < F.col("b")) & (F.least("m", "n") >= F.lit(threshold) * F.greatest("m", "n")) & (F.least("i", "j") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= needed)
    # both share at least 2t / (1 + t) of the smaller set, so the first token that they share stands earlier in it than in a prefix
    early = lambda size, rank: rank <= size - F.ceil(F.lit(2 * threshold / (1 + threshold)) * size - 1e-6) + 1
    fits &= F.when(F.col("m") <= F.col("n"), early(F.col("m"), F.col("i"))).otherwise(early(F.col("n"), F.col("j")))
    met = left.join(right, "term").where(fits).groupBy("a", "b", "m", "n").agg(F.count("*").alias("k"), F.max("i").alias("i"), F.max("j").alias("j"))
    # what both sets share besides stands behind the last prefix token that they share
    met = met.where(F.col("k") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= needed).select("a", "b", (F.col("m") + F.col("n") - 2 * needed).alias("most"))
    signed = met.join(texts.select(F.col("doc_id").alias("a"), F.col("sign").alias("sa")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("sign").alias("sb")), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = cut(signed.where(apart <= F.col("most")).select("a", "b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if ids.count() <= KNOWN_IDS:
        ids = F.broadcast(ids)
    words = docs.join(ids, "doc_id", "left_semi").select("doc_id", F.array_distinct(tokens("text")).alias("t"))
    both = pairs.join(words.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), "a").join(words.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    likeness = common.cast("double") / (F.size("ta") + F.size("tb") - common)
    return both.select("a", "b", likeness.alias("j")).where(F.col("j") >= threshold).select("a", "b", F.round("j", 6).alias("jaccard"))


def sentence_chunks(docs: DataFrame, size: int = 1280, tail: int = 200, overlap: int = 250) -> DataFrame:
    """(doc_id, part, start, chunk): windows that end at the last sentence end of their last ``tail`` characters, if there is one.

    The next window starts ``overlap`` characters before the end of the last, so starts depend on the text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                text, start, part = text or "", 0, 0
                while start < len(text):
                    end = min(start + size, len(text))
                    if end < len(text):
                        found = max(text.rfind(sign, end - tail, end) for sign in ".!?")
                        if found > start + size // 2:
                            end = found + 1
                    out.append((doc_id, part, start, text[start:end]))
                    if end == len(text):
                        break
                    start, part = end - overlap, part + 1
            yield pd.DataFrame(out, columns=["doc_id", "part", "start", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, part int, start long, chunk string")


def shortened(text: Column) -> Column:
    """All strings that lack one character of a text."""
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))


def within_edits(names: DataFrame, column: str, most: int) -> DataFrame:
    """(a, b, d): pairs of different names within ``most`` edits.

    A name is cut into most + 1 pieces, of which one survives unchanged, shifted by at most ``most`` places, in any name within
    that distance; candidates are joined on a piece and its rough place. Names too
    short to cut are joined on what is left after deleting up to ``most`` characters, which is a bounded number of strings.
    """
    pieces = most + 1
    name, length = F.col(column), F.length(column)
    width = F.floor(length / pieces).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), length.alias("n"), F.substr(name, i * width + 1, F.when(i == most, length).otherwise(width)).alias("piece")))
    asks = names.select(name.alias("a"), F.inline(own)).where(width > 0)
    # the other side offers all substrings that such a piece could be, for each length within the bound
    lengths = F.sequence(F.greatest(length - most, F.lit(pieces)), length + most)
    spots = F.transform(lengths, lambda n: F.struct(n.alias("n"), F.floor(n / pieces).cast("int").alias("w")))
    place = F.sequence(F.lit(-most), F.lit(most))
    spread = names.select(name.alias("b"), length.alias("lb"), F.explode(spots).alias("s")).select("b", "lb", "s", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i")).select("b", "lb", "s", "i", F.explode(place).alias("move"))
    start = F.col("i") * F.col("s.w") + F.col("move") + 1
    wide = F.when(F.col("i") == most, F.col("s.n") - F.col("i") * F.col("s.w")).otherwise(F.col("s.w"))
    offers = spread.where(start >= 1).select("b", "i", F.col("s.n").alias("n"), F.substr(F.col("b"), start.cast("int"), wide.cast("int")).alias("piece"))
    pairs = asks.join(offers, ["i", "n", "piece"]).where("a < b").select("a", "b").distinct()
    brief = names.where(length < pieces + most).select(name.alias("n"), F.array(name).alias("left"))
    for _ in range(most):
        brief = brief.select("n", F.array_distinct(F.concat("left", F.flatten(F.transform("left", shortened)))).alias("left"))
    brief = brief.select("n", F.explode("left").alias("left"))
    rest = brief.withColumnRenamed("n", "a").join(brief.withColumnRenamed("n", "b"), "left").where("a < b").select("a", "b")
    return pairs.unionByName(rest).distinct().withColumn("d", F.levenshtein("a", "b")).where(F.col("d") <= most)


def matching_block_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio): names that share their first word, by twice the matching blocks over both lengths."""
    keyed = names.select("name", F.split("name", " ")[0].alias("word"))
    pairs = keyed.select("word", F.col("name").alias("a")).join(keyed.select("word", F.col("name").alias("b")), "word").where("a < b").select("a", "b")

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn("ratio", likeness("a", "b")).where(F.col("ratio") >= threshold)
