"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.tables import spread

#: Bytes of an Arrow batch of whole texts, about: JVM and Python hold a few of them for each core, whatever the length of texts.
BATCH = "4m"

#: Java pattern of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores where it has fewer splits than that."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A cluster must name one; a local session without it gets a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have about ``BATCH`` bytes, unless it says itself how many."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a frame that reads it back.

    The folder comes from ``spark.checkpoint.dir``; only a local session that names none (tests, a laptop) gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `cut_lineage`, but as Parquet, which takes less room than checkpointed rows.

    What is small is read back by a few tasks, where a checkpoint has a task, and each shuffle behind it files, for every partition.
    """
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def joined_by_key(rows: DataFrame, keys: DataFrame, on: list[str], many: int = 100_000, least: int = 500) -> DataFrame:
    """``rows`` joined with ``keys``, one row a key with the number ``__n`` of its rows, without a hot task for a frequent key.

    Keys with more rows than ``least`` and a ``many``-th of all are ``many`` at most, since their rows add up: those are broadcast.
    """
    shared = F.col("__n") > max(least, (keys.agg(F.sum("__n")).first()[0] or 0) // many)
    large = F.broadcast(keys.where(shared))
    rest = rows.join(large.select(*on), on, "left_anti").join(keys.where(~shared), on)
    return rows.join(large, on).unionByName(rest).drop("__n")


def remainder_of_id(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the stated split into folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two that is at least ``n``, within the bounds."""
    size = least
    while size < n and size < most:
        size *= 2
    return size
