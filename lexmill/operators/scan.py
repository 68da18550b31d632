"""A running fold over ordered rows whose steps compose, so that one long sequence is no long task.

Each row has an element; elements compose associatively. Rows are grouped in chunks, a chunk's elements are composed into one, and
the composed elements are scanned in the same way, chunk by chunk of chunks, until one is left for each sequence. On the way back
each chunk starts with the composition of all before it. Three kinds of elements are given here: functions between the states of a
machine, values that are set or kept, and stacks of the nearest smaller predecessors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import cut

#: Rows of a chunk.
CHUNK = 256


def running(rows: DataFrame, key: list[str], at: str, element: Column, compose: Callable[[Column, Column], Column], empty: Column, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with a column ``before``: the elements of all earlier rows of the key composed, ``empty`` for the first.

    ``at`` orders the rows of a key: whole numbers from 0 on, without repeats; gaps do no harm. Null keys are a key of their own.
    Chunks of up to ``chunk`` rows are the only groups that a task holds; the result does not depend on their size. The rows are
    written once, since each level reads them twice: give it narrow rows and join wide columns afterwards.
    """
    rows = cut(rows)
    last = rows.agg(F.max(at)).first()[0] or 0
    return _scan(rows, key, at, element, compose, empty, chunk, last)


def _scan(rows: DataFrame, key: list[str], at: str, element: Column, compose, empty: Column, chunk: int, last: int) -> DataFrame:
    item = F.struct(F.col(at).alias("__at"), element.alias("e"), F.struct(*(c for c in rows.columns if c not in key)).alias("row"))
    names = {c: f"__k{i}" for i, c in enumerate(key)}

    def grouped(part: DataFrame) -> DataFrame:
        return part.groupBy(*(F.col(c).alias(n) for c, n in names.items()), F.floor(F.col(at) / chunk).alias("__chunk")).agg(F.sort_array(F.collect_list(item)).alias("items"))

    if last < chunk:
        started = grouped(rows).withColumn("start", empty)
    else:
        # nothing stands before a first chunk: only keys with later ones are composed chunk by chunk and joined with what comes of it
        later = rows.where(F.col(at) >= chunk)
        long = later.select(*(F.col(c).alias(f"{n}_") for c, n in names.items())).distinct()
        same = lambda sides: reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in sides))
        whole = F.aggregate("items", empty, lambda a, x: compose(a, x["e"]))
        sums = cut(grouped(rows.join(long, same((c, f"{n}_") for c, n in names.items()), "left_semi")).select(*names.values(), "__chunk", whole.alias("sum")))
        starts = _scan(sums, list(names.values()), "__chunk", F.col("sum"), compose, empty, chunk, last // chunk).where(F.col("__chunk") > 0)
        side = starts.select(*(F.col(n).alias(f"{n}_") for n in names.values()), F.col("__chunk").alias("__chunk_"), F.col("before").alias("start"))
        rest = grouped(later).join(side, same([("__chunk", "__chunk_"), *((n, f"{n}_") for n in names.values())])).drop("__chunk_", *(f"{n}_" for n in names.values()))
        started = grouped(rows.where(F.col(at) < chunk)).withColumn("start", empty).unionByName(rest)
    first = F.struct(F.col("start").alias("now"), F.slice(F.array("start"), 1, 0).alias("out"))
    steps = F.aggregate("items", first, lambda s, x: F.struct(compose(s["now"], x["e"]).alias("now"), F.array_append(s["out"], s["now"]).alias("out")), lambda s: s["out"])
    pairs = F.arrays_zip(F.transform("items", lambda x: x["row"]).alias("row"), steps.alias("before"))
    out = started.select(*(F.col(n).alias(c) for c, n in names.items()), F.explode(pairs).alias("p"))
    return out.select(*(F.col(c) if c in key else F.col("p.row")[c].alias(c) for c in rows.columns), F.col("p.before").alias("before"))


def states(rows: DataFrame, key: list[str], at: str, symbol: Column, table: list[list[int]], start: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``state``, the state before the row, of a machine with ``table[state][symbol]`` as the next state."""
    many = len(table)
    functions = F.array(*(F.array(*(F.lit(table[s][x]) for s in range(many))) for x in range(len(table[0]))))
    same = F.array(*(F.lit(s) for s in range(many)))
    found = running(rows, key, at, F.get(functions, symbol), lambda f, g: F.transform(f, lambda s: F.get(g, s)), same, chunk)
    return found.withColumn("state", F.get("before", F.lit(start))).drop("before")


def carried(rows: DataFrame, key: list[str], at: str, fields: dict[str, tuple[Column, Column]], chunk: int = CHUNK, after: bool = True) -> DataFrame:
    """``rows`` with a column for each field: its value after the row, or before it. A field is (whether the row sets it, the value, which may be null)."""
    own = F.struct(*(F.struct(sets.alias("sets"), F.when(sets, value).alias("value")).alias(name) for name, (sets, value) in fields.items()))
    marked = rows.withColumn("__own", own)
    kind = marked.schema["__own"].dataType.simpleString()
    nothing = F.struct(*(F.struct(F.lit(False).alias("sets"), F.lit(None).alias("value")).alias(name) for name in fields)).cast(kind)

    def compose(a: Column, b: Column) -> Column:
        return F.struct(*(F.when(b[name]["sets"], b[name]).otherwise(a[name]).alias(name) for name in fields)).cast(kind)

    found = running(marked, key, at, F.col("__own"), compose, nothing, chunk)
    old = {n: F.col("before")[n]["value"] for n in fields}
    return found.select(*rows.columns, *((F.when(F.col("__own")[n]["sets"], F.col("__own")[n]["value"]).otherwise(old[n]) if after else old[n]).alias(n) for n in fields))


def counted(rows: DataFrame, key: list[str], at: str, flags: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """``rows`` with a column for each flag: how many rows up to this one have it."""
    own = F.struct(*(F.when(flag, 1).otherwise(0).cast("long").alias(name) for name, flag in flags.items()))
    marked = rows.withColumn("__own", own)
    nothing = F.struct(*(F.lit(0).cast("long").alias(name) for name in flags))
    found = running(marked, key, at, F.col("__own"), lambda a, b: F.struct(*((a[n] + b[n]).alias(n) for n in flags)), nothing, chunk)
    return found.select(*rows.columns, *((F.col("before")[n] + F.col("__own")[n]).alias(n) for n in flags))


def parents(rows: DataFrame, key: list[str], at: str, level: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``parent_at``: the last earlier row of the key with a smaller ``level``, null for a root; and ``depth`` from 1.

    An element is the stack that a run of rows leaves: levels that grow, each with its place. A run pops what is not below its own
    bottom from the stack before it. Stacks are as high as a key has levels, however long it is.
    """
    own = F.array(F.struct(F.col(level).cast("long").alias("level"), F.col(at).cast("long").alias("at")))
    nothing = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("at"))), 1, 0)

    def compose(a: Column, b: Column) -> Column:
        return F.when(F.size(b) == 0, a).otherwise(F.concat(F.filter(a, lambda x: x["level"] < F.get(b, F.lit(0))["level"]), b))

    found = running(rows, key, at, own, compose, nothing, chunk)
    above = F.filter("before", lambda x: x["level"] < F.col(level))
    return found.withColumn("__above", above).select(*rows.columns, F.try_element_at("__above", F.lit(-1))["at"].alias("parent_at"), (F.size("__above") + 1).alias("depth"))
