"""SimHash near-duplicates found through vantage-point trees.

Word shingles become 64-bit fingerprints inside the tasks. Distinct fingerprints are then partitioned by their Hamming
distance to vantage points: a tree that is fitted on a bounded sample gives every fingerprint a home shard, and the
triangle inequality tells which later shards can hold a partner, so that a fingerprint visits only shards whose boundary
it overlaps. Inside a shard a second tree of the same kind prunes before fingerprints are compared.

Distances over few bits prune best when the radius is small, so the 64 bits are cut into ``BANDS`` bands with a tree
each: fingerprints that differ in at most ``max_bits`` bits differ in at most ``max_bits // BANDS`` bits of some band.
Every pair is checked over all 64 bits, so the result is exact whatever the sample was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut_lineage, power_of_two
from lexmill.llm.components import LocalForest, components

BANDS = 4
#: Distinct fingerprints that a shard should hold, bounds of the number of shards of a band, and of the sample for one.
SHARD, FEWEST, MOST, SAMPLE_PER_SHARD = 2000, 16, 16384, 32
#: A shard expected to hold more than this is cut into blocks, and its blocks are compared in pairs: over 33 million distinct
#: fingerprints shards grow, a band of 16 bits has no more of them, and so does the number of pairs of blocks.
BLOCK = 8000
#: What names the rows that a task compares: a band, a shard, and two blocks of it.
CELL = ("band", "leaf", "i", "j")
HOME, VISITOR, FACING = 0, 1, 2


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the shingles of ``width`` words; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(data, seed)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(data))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 65536):
        spans = zip(starts[at : at + 65536], ends[at + width - 1 : at + 65535 + width])
        hashes = np.array([digest(data[s:e], seed) for s, e in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each row of ``docs``. Null and blank texts have the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), width, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bands(count: int = BANDS) -> list[np.uint64]:
    """Masks of equally wide runs of bits."""
    width = 64 // count
    return [np.uint64(((1 << width) - 1) << (width * b)) for b in range(count)]


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Nodes (vantage point, radius, inner child, outer child); a negative child is the leaf -1 - child."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int, seed: int = 7):
        self.nodes: list[list] = []
        self.weights: list[int] = []
        self.random = np.random.default_rng(seed)
        self.top = self._grow(points, leaf, depth)

    def _grow(self, points: np.ndarray, leaf: int, depth: int) -> int:
        if depth and len(points) > leaf:
            best = None
            for vantage in self.random.choice(points, min(5, len(points)), replace=False):
                d = distance(points, vantage)
                radius = int(np.median(d))
                if (d <= radius).all():
                    radius -= 1
                inside = d <= radius
                if inside.any() and (best is None or d.std() > best[0]):
                    best = (d.std(), vantage, radius, inside)
            if best:
                at = len(self.nodes)
                self.nodes.append([best[1], best[2], 0, 0])
                self.nodes[at][2] = self._grow(points[best[3]], leaf, depth - 1)
                self.nodes[at][3] = self._grow(points[~best[3]], leaf, depth - 1)
                return at
        self.weights.append(len(points))
        return -len(self.weights)

    def reach(self, points: np.ndarray, within: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions of the points with a possible partner in it at that distance); 0 gives each point's own leaf."""
        todo = [(self.top, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            vantage, radius, inner, outer = self.nodes[node]
            d = distance(points[rows], vantage).astype(np.int64)
            todo.append((inner, rows[d - within <= radius]))
            todo.append((outer, rows[d + within > radius]))


def link_within(homes: np.ndarray, visitors: np.ndarray, mask: np.uint64, within: int, max_bits: int, inner: bool, leaf: int = 512) -> LocalForest:
    """Classes over ``homes`` followed by ``visitors``: links among homes (if ``inner``) and from visitors to homes."""
    forest = LocalForest(len(homes) + len(visitors))
    tree = VantageTree(homes & mask, leaf, 24)
    asking = np.concatenate([homes, visitors]) if inner else visitors
    shift = 0 if inner else len(homes)
    inside = dict(tree.reach(homes & mask, 0))
    for leaf_id, rows in tree.reach(asking & mask, within):
        held = inside.get(leaf_id)
        if held is None:
            continue
        points = homes[held]
        step = max(1, 2_000_000 // len(points))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            a, b = np.nonzero(distance(asking[part][:, None], points[None, :]) <= max_bits)
            forest.link(part[a] + shift, held[b])
    return forest


def near_pairs(distinct: DataFrame, max_bits: int = 4, band_count: int = BANDS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(u long, v long): links that connect all fingerprints of ``distinct`` (fp long) within ``max_bits`` bits.

    The links form a forest within each shard rather than all pairs; their components are those of all pairs. The sample
    for the trees has an expected size of at most ``MOST * SAMPLE_PER_SHARD`` fingerprints, chosen by their hash.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    shards = power_of_two(n / shard, FEWEST, MOST)
    share = min(1.0, shards * SAMPLE_PER_SHARD / max(n, 1))
    picked = distinct.where(F.pmod(F.xxhash64("fp", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("fp")
    sample = np.sort(np.array([r.fp for r in picked.toLocalIterator()], np.int64)).view(np.uint64)
    within, depth = max_bits // band_count, shards.bit_length() - 1
    trees = [VantageTree(sample & mask, 1, depth, seed=b) for b, mask in enumerate(bands(band_count))]
    blocks = [[max(1, -(-int(w / share) // block)) for w in t.weights] for t in trees]
    shared = spark.sparkContext.broadcast((trees, blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, blocks = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            salt = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for b, (tree, mask) in enumerate(zip(trees, bands(band_count), strict=True)):
                home = np.zeros(len(fps), np.int64)
                for leaf, rows in tree.reach(fps & mask, 0):
                    home[rows] = leaf
                for leaf, rows in tree.reach(fps & mask, within):
                    own, k = rows[home[rows] == leaf], blocks[b][leaf]
                    come = rows[home[rows] < leaf]
                    mine = (salt[own] % np.uint64(k)).astype(np.int64)
                    sent = [(own, mine, mine, HOME)] + [(come, np.full(len(come), j), np.full(len(come), j), VISITOR) for j in range(k)]
                    for j in range(k):
                        sent += [(own[mine < j], mine[mine < j], np.full((mine < j).sum(), j), FACING), (own[mine > j], np.full((mine > j).sum(), j), mine[mine > j], VISITOR)]
                    for who, i, j, role in sent:
                        if len(who):
                            cell = [np.full(len(who), b), np.full(len(who), leaf), i, j]
                            columns = [*(pa.array(c.astype(np.int32)) for c in cell), pa.array(fps[who].view(np.int64)), pa.array(np.full(len(who), role, np.int8))]
                            yield pa.RecordBatch.from_arrays(columns, [*CELL, "fp", "role"])

    def compare(cell: pa.Table) -> pa.Table:
        mask = bands(band_count)[cell.column("band")[0].as_py()]
        fps, role = cell.column("fp").to_numpy().view(np.uint64), cell.column("role").to_numpy()
        homes, visitors = np.sort(fps[role != VISITOR]), np.sort(fps[role == VISITOR])
        if not len(homes):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        forest = link_within(homes, visitors, mask, within, max_bits, inner=bool((role == HOME).any()))
        every, root = np.concatenate([homes, visitors]).view(np.int64), forest.root
        moved = root != np.arange(len(root))
        return pa.table({"u": every[moved], "v": every[root[moved]]})

    routed = distinct.select("fp").mapInArrow(route, "band int, leaf int, i int, j int, fp long, role byte")
    return routed.groupBy(*CELL).applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): one row for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits, its own included. Null,
    empty and blank texts share the fingerprint 0 and link like any other. Rows that repeat a doc_id are kept. A null
    doc_id gets the id of its group, or null if the group holds no other. Other columns of ``docs`` are not read.
    """
    marked = cut_lineage(fingerprints(docs, width, seed, id_col, text_col))
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(near_pairs(firsts.select("fp"), max_bits))
    rooted = firsts.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
