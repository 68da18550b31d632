"""Keeping a collection in step with its source by content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(docs: DataFrame, key: str, *content: str) -> DataFrame:
    """(key, hash): the first 16 digits of the SHA-256 of the content columns."""
    text = F.concat_ws("::", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content))
    return docs.select(F.col(key).alias("key"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, action): added, modified, removed or unchanged, from two states (key, hash)."""
    joined = old.withColumnRenamed("hash", "old_hash").join(new.withColumnRenamed("hash", "new_hash"), "key", "full_outer")
    action = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    )
    return joined.select("key", action.alias("action"))


def apply_changes(store: DataFrame, changed: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """The store without removed and modified keys, and with the changed rows of added and modified ones."""
    touched = actions.where("action <> 'unchanged'").select(F.col("key").alias(key))
    fresh = actions.where("action IN ('added', 'modified')").select(F.col("key").alias(key))
    return store.join(touched, key, "left_anti").unionByName(changed.join(fresh, key, "left_semi"))
