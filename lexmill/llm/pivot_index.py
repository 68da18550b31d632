"""Near-duplicate vectors found through a pivot-permutation index.

Every vector is described by its nearest reference vectors, in order. Inverted lists by (label, pivot) bring together the
vectors that name the same pivot; inside a list the number of shared pivots picks the pairs, and their cosine in double
precision decides. A pair that meets in several lists counts in that of its lowest shared pivot only. Lists longer than a
block are compared block against block, so no list ends up whole in one task.

Equal vectors of a label are one class with a weight, so copies are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut_lineage
from lexmill.llm.components import LocalForest, components

#: Pivots: so many times the root of the number of vectors, within bounds. The pivots are broadcast: MOST vectors at most.
PER_ROOT, FEWEST, MOST = 2.0, 32, 16384
#: Nearest pivots that describe a vector; pivots that a pair must share; rows of a block.
NEAREST, SHARED, BLOCK = 8, 2, 2048
#: Pivots have at most this cosine with each other.
APART = 0.8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by a power of two first, so that no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))
    scaled = np.ldexp(vectors, -exponent)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def usable() -> Column:
    """Whether a row can link: it has an id, a label, and a finite vector that is not zero."""
    values = F.col("embedding")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = values.isNotNull() & finite & F.exists(values, lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole, F.lit(False))


def spread_out(vectors: np.ndarray, apart: float = APART) -> np.ndarray:
    """The unit vectors without those whose cosine with an earlier kept one is over ``apart``: near pivots order by noise."""
    kept = np.empty_like(vectors)
    n = 0
    for vector in vectors:
        if not n or (kept[:n] @ vector).max() <= apart:
            kept[n] = vector
            n += 1
    return kept[:n]


def pair_lists(classes: DataFrame, threshold: float) -> DataFrame:
    """(cid, links long, other): for each class the weight of its partners found in one cell, and one that it links to.

    ``classes`` has cid long, label, embedding, weight long. The pivots are the vectors of lowest hash, a bounded number.
    """
    spark = classes.sparkSession
    n = classes.count()
    wanted = int(min(MOST, max(FEWEST, PER_ROOT * n**0.5)))
    picked = classes.select("embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h")).orderBy("h", F.col("embedding")).limit(wanted).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in sorted({r.dim for r in picked}):
        pivots[dim] = spread_out(unit(np.array([r.embedding for r in picked if r.dim == dim], np.float64)))
    shared = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column("embedding").offsets.to_numpy())
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = unit(matrix(part.column("embedding"), part.num_rows))
                near = shared.value.get(int(dim))
                if near is None:
                    # no pivot has this many dimensions: such vectors share one list
                    names = np.full((len(vectors), SHARED), -1, np.int32)
                    names -= np.arange(SHARED, dtype=np.int32)
                else:
                    angles = vectors @ near.T
                    k = min(NEAREST, len(near))
                    top = np.argpartition(-angles, k - 1, axis=1)[:, :k]
                    names = np.take_along_axis(top, np.argsort(-np.take_along_axis(angles, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
                k = names.shape[1]
                named = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(names) + 1, k, dtype=np.int32)), pa.array(names.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, named], [*part.schema.names, "pivots"])

    kinds = ", ".join(f"{c} {k}" for c, k in classes.dtypes)
    described = cut_lineage(classes.mapInArrow(describe, f"{kinds}, pivots array<int>"))
    listed = described.withColumn("dim", F.size("embedding")).withColumn("pivot", F.explode("pivots"))
    lengths = listed.groupBy("label", "dim", "pivot").agg(F.count("*").alias("members")).where("members > 1")
    sized = listed.join(lengths, ["label", "dim", "pivot"]).withColumn("k", F.ceil(F.col("members") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("cid", F.lit(5)), F.col("k")).cast("int")
    # block i meets block j in the cell (i, j), i <= j: a row goes to all cells with its block
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    sent = sized.withColumn("mine", mine).withColumn("cell", F.explode(cells)).select(
        "label", "dim", "pivot", "cell.i", "cell.j", "mine", "cid", "weight", "embedding", "pivots"
    )

    def verify(key: tuple, cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        n = cell.num_rows
        pivot, i, j = key[2].as_py(), key[3].as_py(), key[4].as_py()
        mine, cid, weight = (cell.column(c).to_numpy() for c in ("mine", "cid", "weight"))
        vectors = unit(matrix(cell.column("embedding").chunk(0), n))
        names = matrix(cell.column("pivots").chunk(0), n).astype(np.int64)
        known, flat = np.unique(names, return_inverse=True)
        hot = np.zeros((n, len(known)), np.float32)
        hot[np.repeat(np.arange(n), names.shape[1]), flat.ravel()] = 1
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        forest, links = LocalForest(n), np.zeros(n, np.int64)
        need = min(SHARED, names.shape[1])
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            a, b = np.nonzero(hot[rows] @ hot[right].T >= need)
            a, b = rows[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for part in range(0, len(a), 20_000):
                x, y = a[part : part + 20_000], b[part : part + 20_000]
                near = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
                x, y = x[near], y[near]
                if not len(x):
                    continue
                # the list of the lowest shared pivot counts the pair
                counted = ~(hot[x][:, known < pivot] * hot[y][:, known < pivot]).any(1)
                x, y = x[counted], y[counted]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                forest.link(x, y)
        full = links > 0
        return pa.table({"cid": cid[full], "links": links[full], "other": cid[forest.root[full]]})

    return sent.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(verify, "cid long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links long, component_id, kept boolean): one row for each row of ``vectors``.

    Rows link when their labels are equal and the cosine of their vectors is at least ``threshold``; equal vectors always
    do. Null, zero or not finite vectors and rows without a label link with nothing, nor do vectors of other lengths. Rows
    that repeat an id count as vectors of their own; a null id gets no links and a null component_id, and is not kept. The
    index can miss pairs that share fewer than ``SHARED`` of their ``NEAREST`` pivots, and never reports one below the threshold.
    """
    kind = f"array<{vectors.schema[vector_col].dataType.elementType.simpleString()}>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).alias("label"))
    valid = rows.where(usable())
    grouped = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").cast("long").alias("weight"))
    classes = cut_lineage(grouped.withColumn("cid", F.monotonically_increasing_id()))
    found = cut_lineage(pair_lists(classes.select("cid", "label", "embedding", "weight"), threshold))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("u"), F.col("other").alias("v")))
    told = classes.join(links, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = told.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = told.join(smallest, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = valid.join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

