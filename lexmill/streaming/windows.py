"""Sessions and tumbling windows, and stateful operators, for streams and batch tables.

The input has ts, value and the key. In a stream, call ``late_after`` first; rows later than that are dropped and counted by
Spark's progress reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def late_after(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """An event-time watermark; streams need ts as a timestamp."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, events, first, last): runs of events with less than ``gap`` between them."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    """(start, keys, events, total) of fixed windows."""
    told = events.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return told.select(F.col("w.start").alias("start"), *keys, "events", "total")


def sliding(events: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    told = events.groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return told.select(F.col("w.start").alias("start"), *keys, "events", "total")


def ring_buffers(events: DataFrame, size: int = 100) -> DataFrame:
    """For each user the ids of the last ``size`` events after each batch of a stream: a bounded state for each key."""

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        fresh = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        held = (held + fresh.event_id.tolist())[-size:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "event_ids": [held]})

    return events.groupBy("user_id").applyInPandasWithState(keep, "user_id long, event_ids array<long>", "held array<long>", "update", GroupStateTimeout.NoTimeout)


def circuit_breakers(events: DataFrame, failures: int = 5) -> DataFrame:
    """For each user whether a run of ``failures`` errors has opened its breaker; any other event closes it."""

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        for kind in pd.concat(list(parts)).sort_values(["ts", "event_id"]).event_type:
            run = run + 1 if kind == "error" else 0
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [run], "open": [run >= failures]})

    return events.groupBy("user_id").applyInPandasWithState(watch, "user_id long, failures long, open boolean", "run long", "update", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Drops repeats of a key within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])
