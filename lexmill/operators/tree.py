"""Document trees as edge lists: flattening, paths, depth, references, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import FULL_REF, no_space, token_count

#: Levels that a tree may have; more are taken for a cycle.
MAX_DEPTH = 1000


def paths(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, node_id, level, path array<string>, label) from nodes (doc_id, node_id, parent_id, label): roots have no parent.

    Walks one level a step, a join each, until a level is empty. Nodes below no root have no row. A walk of over ``max_depth``
    levels raises: then nodes are their own ancestors.
    """
    level = nodes.where("parent_id IS NULL").select("doc_id", "node_id", "label", F.lit(1).alias("level"), F.array("label").alias("path"))
    out = level
    children = nodes.where("parent_id IS NOT NULL").select(F.col("doc_id").alias("d"), F.col("node_id").alias("child"), "parent_id", F.col("label").alias("name"))
    for depth in range(2, max_depth + 2):
        on = (F.col("d") == F.col("doc_id")) & (F.col("parent_id") == F.col("node_id"))
        level = level.join(children, on).select("doc_id", F.col("child").alias("node_id"), F.col("name").alias("label"), F.lit(depth).alias("level"), F.concat("path", F.array("name")).alias("path"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a tree has over {max_depth} levels")


def depth(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, depth): levels of each tree."""
    return paths(nodes, max_depth).groupBy("doc_id").agg(F.max("level").alias("depth"))


def deduped_path(path: Column) -> Column:
    """A path without segments that repeat the one before, white space aside."""
    keep = lambda acc, s: F.when((F.size(acc) > 0) & (no_space(F.element_at(acc, -1)) == no_space(s)), acc).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(path, F.array().cast("array<string>"), keep)


def full_text(path: Column, label: Column, text: Column) -> Column:
    """"[a > b > label] text"; the label is left out where it repeats the last segment."""
    inside = deduped_path(F.concat(path, F.array(label)))
    return F.concat(F.lit("["), F.array_join(inside, " > "), F.lit("] "), text)


def embedding_text(path: Column, label: Column, text: Column) -> Column:
    """First and last three segments, then the label and the text."""
    head = F.concat(F.slice(path, 1, 1), F.slice(path, F.greatest(F.size(path) - 2, F.lit(2)), 3))
    return F.concat(F.array_join(deduped_path(head), " > "), F.lit(" > "), label, F.lit(": "), text)


def chunks(nodes: DataFrame) -> DataFrame:
    """Derived columns of a chunk: token_count, is_searchable, status, from (text, title, n_children)."""
    return nodes.select(
        "*", token_count(F.col("text")).alias("token_count"),
        ((F.length(F.coalesce("text", F.lit(""))) > 0) | (F.col("n_children") == 0)).alias("is_searchable"),
        F.when(F.contains(F.coalesce("title", F.lit("")), F.lit("폐지")), "abolished").otherwise("active").alias("status"),
    )


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, pos, target_text): references in the order in which they stand."""
    found = F.regexp_extract_all("text", F.lit(FULL_REF), F.lit(0))
    return nodes.select("doc_id", "node_id", F.posexplode(found).alias("pos", "target")).select("doc_id", "node_id", "pos", no_space(F.col("target")).alias("target_text"))


def resolve_references(nodes: DataFrame) -> DataFrame:
    """References joined to the node of the same document whose label names them; null where there is none."""
    refs = references(nodes)
    labels = nodes.select("doc_id", no_space(F.col("label")).alias("target_text"), F.col("node_id").alias("target_node"))
    first = labels.groupBy("doc_id", "target_text").agg(F.min("target_node").alias("target_node"))
    return refs.join(first, ["doc_id", "target_text"], "left")


def stable_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` with stable_id: a digest of the path of sibling keys, numbered among equal siblings."""
    key = F.concat_ws("|", "type", "label")
    same = Window.partitionBy("doc_id", "parent_id", key).orderBy("node_id")
    keyed = nodes.withColumn("sibling_key", F.concat_ws("#", key, F.row_number().over(same).cast("string")))
    walked = paths(keyed.select("doc_id", "node_id", "parent_id", F.col("sibling_key").alias("label")))
    ids = walked.select("doc_id", "node_id", F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.array_join("path", "/")).cast("binary"), 256).alias("stable_id"))
    return nodes.join(ids, ["doc_id", "node_id"])


def first_per(nodes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return nodes.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n = 1").drop("n")
