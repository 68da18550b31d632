"""Near copies of texts: word shingles alike to a stated Jaccard similarity, with candidates from SimHash vantage-point trees.

Each set of shingles has a SimHash of ``WORDS`` x 64 bits, cut into bands with a tree each. Sets that differ in at most one
bit of a band, and in at most ``RADIUS`` of the 128 bits of its word and the next word, are candidates. Only candidates
whose shingles are alike to ``least`` are linked, so no link is false; a pair that no band brings together is missed.

Candidates in the same class need no comparison: each set is compared with its nearest candidate first, twice, and then all
pairs between different classes. Where a set has more than ``CROWD`` candidates in a shard, the nearest and the lowest of them
are taken in the first pass: the lowest is the same for most of a crowd, so that most of it is one class after one turn. A
second pass takes all pairs between the classes that are still apart, so that nothing is left out. First the shards name the
sets that have candidates in other classes; the shingles of those alone travel to the shards, which compare them in place and
return links alone: what leaves a shard grows with its sets and not with its pairs. Sets of more than ``LONG`` shingles are
too large to travel and go as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import power_of_two, stored
from lexmill.llm.components import LocalForest, components
from lexmill.llm.simhash_vptree import BLOCK, CELL, FACING, FEWEST, HOME, MOST, SAMPLE_PER_SHARD, SHARD, VISITOR, VantageTree, bands, distance

#: Words of a fingerprint, bands of 16 bits, bits that may differ in a band and in two words.
WORDS, BANDS, WITHIN, RADIUS = 3, 12, 1, 30
#: Candidates of a set in a shard from which on the first pass takes only the lowest and the nearest; what stands for the
#: distance of a lowest one.
CROWD, HUB = 6, -1
#: Shingles from which on a set of a crowd is also compared by pairs; those that travel have a quarter more at most, since sets
#: alike to 0.8 or more differ no more than that in size.
LONG = 2048
#: Keys of 8 bytes that may be sent to all tasks; more are joined by a shuffle.
MOST_SENT = 1_000_000
MASKS = [bands(4)[b % 4] for b in range(BANDS)]


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(data))
    digest, width = xxhash.xxh64_digest, min(width, len(words))
    return np.unique(np.frombuffer(b"".join([digest(data[s:e], seed) for s, e in zip(starts, ends[width - 1 :])]), ">u8").astype(np.uint64))


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of 64 bits: each the majority of the bits of the hashes, mixed differently for each word."""
    out = np.zeros(WORDS, np.uint64)
    for w in range(WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            x = hashes[at : at + 65536] + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def node_of(hashes: np.ndarray) -> int:
    """The number of a set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest of the text, node, w0, w1, w2): one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(2)]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            words = np.array([wide_simhash(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), *(pa.array(words[:, w].copy()) for w in range(WORDS))], names)

    names = ["doc_id", "digest", "node", *(f"w{w}" for w in range(WORDS))]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, digest long, node long, " + ", ".join(f"w{w} long" for w in range(WORDS)))


def partners(sets: pa.Array, least: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of positions (a sorted, b) have sets that are alike to ``least``; each list of ``sets`` is sorted."""
    flat, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    sizes, out = np.diff(ends), np.zeros(len(a), bool)
    firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    for start, stop in zip(firsts, [*firsts[1:], len(a)]):
        own, them = flat[ends[a[start]] : ends[a[start] + 1]], b[start:stop]
        if not len(own):
            continue
        for at in range(0, len(them), 512):
            some = them[at : at + 512]
            held = np.concatenate([flat[ends[j] : ends[j + 1]] for j in some])
            place = np.minimum(np.searchsorted(own, held), len(own) - 1)
            total = np.concatenate([[0], np.cumsum(own[place] == held)])
            upto = np.concatenate([[0], np.cumsum(sizes[some])])
            shared = total[upto[1:]] - total[upto[:-1]]
            out[start + at : start + at + len(some)] = shared >= least * (len(own) + sizes[some] - shared) - 1e-9
    return out


def candidates(nodes: DataFrame, crowd: int | None, shard: int = SHARD, block: int = BLOCK, least: float | None = None) -> DataFrame:
    """(u, v, d): pairs u < v of ``nodes`` (node, w0, w1, w2, label) with different labels; a pair can come more than once.

    With ``crowd``, a node with more candidates than that in a shard gives the nearest, and the lowest, if lower than itself, with
    d = ``HUB``; rows with u = v name it and all its candidates there. A negative ``crowd`` gives such names alone, of every node
    with a candidate. With ``least``, ``nodes`` have their sorted ``hashes``, and only pairs alike to that are returned, of them
    as many as join the labels that all join.
    """
    spark, n = nodes.sparkSession, nodes.count()
    shards = power_of_two(n / shard, FEWEST, MOST)
    share = min(1.0, shards * SAMPLE_PER_SHARD / max(n, 1))
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = picked.select(*(f"w{w}" for w in range(WORDS))).toArrow()
    sample = [np.sort(sample.column(w).to_numpy()).view(np.uint64) for w in range(WORDS)]
    trees = [VantageTree(sample[b // 4] & mask, 1, shards.bit_length() - 1, seed=b) for b, mask in enumerate(MASKS)]
    blocks = [[max(1, -(-int(w / share) // block)) for w in t.weights] for t in trees]
    shared = spark.sparkContext.broadcast((trees, blocks))
    names = [*CELL, "node", "mine", "next", "label", "role"] + ["hashes"] * (least is not None)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, blocks = shared.value
        for batch in batches:
            node, label = (batch.column(c).to_numpy() for c in ("node", "label"))
            words = [batch.column(f"w{w}").to_numpy().view(np.uint64) for w in range(WORDS)]
            salt = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for b, (tree, mask) in enumerate(zip(trees, MASKS)):
                mine, after = words[b // 4], words[(b // 4 + 1) % WORDS]
                home = np.zeros(len(node), np.int64)
                for leaf, rows in tree.reach(mine & mask, 0):
                    home[rows] = leaf
                for leaf, rows in tree.reach(mine & mask, WITHIN):
                    own, come, k = rows[home[rows] == leaf], rows[home[rows] < leaf], blocks[b][leaf]
                    at = (salt[own] % np.uint64(k)).astype(np.int64)
                    sent = [(own, at, at, HOME)] + [(come, np.full(len(come), j), np.full(len(come), j), VISITOR) for j in range(k)]
                    for j in range(k):
                        sent += [(own[at < j], at[at < j], np.full((at < j).sum(), j), FACING), (own[at > j], np.full((at > j).sum(), j), at[at > j], VISITOR)]
                    for who, i, j, role in sent:
                        if len(who):
                            cell = [np.full(len(who), b), np.full(len(who), leaf), i, j]
                            columns = [*(c.astype(np.int32) for c in cell), node[who], mine[who].view(np.int64), after[who].view(np.int64), label[who], np.full(len(who), role, np.int8)]
                            sets = [batch.column("hashes").take(pa.array(who))] if least is not None else []
                            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *sets], names)

    def compare(cell: pa.Table) -> pa.Table:
        mask = MASKS[cell.column("band")[0].as_py()]
        node, label, role = (cell.column(c).to_numpy() for c in ("node", "label", "role"))
        mine, after = (cell.column(c).to_numpy().view(np.uint64) for c in ("mine", "next"))
        order = np.argsort(node)
        homes, visitors = order[role[order] != VISITOR], order[role[order] == VISITOR]
        asking = order if (role == HOME).any() else visitors
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        crowded: list[np.ndarray] = []
        forest = None
        if least is not None:
            # what has one label is one class from the start, so that only joins of labels are found and returned
            forest = LocalForest(len(node))
            _, firsts, label_no = np.unique(label, return_index=True, return_inverse=True)
            forest.root[:] = firsts[label_no]
            began = forest.root.copy()
        sets = cell.column("hashes").combine_chunks() if least is not None else None
        if len(homes) and len(asking):
            tree = VantageTree(mine[homes] & mask, 512, 24)
            inside = dict(tree.reach(mine[homes] & mask, 0))
            for leaf, rows in tree.reach(mine[asking] & mask, WITHIN):
                held = inside.get(leaf)
                if held is None:
                    continue
                there = homes[held]
                for at in range(0, len(rows), step := max(1, 2_000_000 // len(there))):
                    here = asking[rows[at : at + step]]
                    bits = distance(mine[here][:, None], mine[there][None, :]) + distance(after[here][:, None], after[there][None, :])
                    hits = (bits <= RADIUS) & (label[here][:, None] != label[there][None, :])
                    if forest:
                        hits &= forest.root[here][:, None] != forest.root[there][None, :]
                        a, b = np.nonzero(hits)
                        good = partners(sets, least, here[a], there[b])
                        a, b = here[a[good]], there[b[good]]
                        forest.link(a, b)
                        continue
                    if crowd is not None and (over := np.flatnonzero(hits.sum(1) > crowd)).size:
                        full = hits[over]
                        crowded += [node[here[over]], node[there[full.any(0)]]]
                        hits[over] = False
                        if crowd >= 0:
                            hits[over, np.where(full, bits[over], 255).argmin(axis=1)] = True
                            # homes are in the order of their numbers
                            hub, own = node[there[full.argmax(axis=1)]], node[here[over]]
                            found.append((hub[hub < own], own[hub < own], np.full((hub < own).sum(), HUB)))
                    a, b = np.nonzero(hits)
                    found.append((node[here[a]], node[there[b]], bits[a, b]))
        if crowded:
            named = np.unique(np.concatenate(crowded))
            found.append((named, named, np.zeros(len(named), np.uint8)))
        if forest:
            moved = np.flatnonzero((forest.root != began) & (began == np.arange(len(node))))
            found.append((node[moved], node[forest.root[moved]], np.zeros(len(moved), np.uint8)))
        a, b, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b), "d": d.astype(np.int16)})

    routed = nodes.mapInArrow(route, "band int, leaf int, i int, j int, node long, mine long, next long, label long, role byte" + ", hashes array<long>" * (least is not None))
    return routed.groupBy(*CELL).applyInArrow(compare, "u long, v long, d short")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, hashes) have at least that Jaccard similarity."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"{name}_set"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    return both.where(shared >= F.lit(least) * (F.size("u_set") + F.size("v_set") - shared) - 1e-9).select("u", "v")


def among(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``chosen`` (key; written, so that counting it is cheap): few of them go to the rows."""
    few = chosen.count() <= MOST_SENT
    return rows.join(F.broadcast(chosen) if few else chosen, key, "left_semi")


def sets_of(named: DataFrame, docs: DataFrame, marked: DataFrame, width: int, text_col: str) -> DataFrame:
    """(node, hashes): the sorted shingles of the nodes ``named``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingles(t.as_py(), width).view(np.int64)) for t in batch.column(0)]
            nodes = [np.uint64(node_of(np.sort(s.view(np.uint64)))).astype(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    wanted = stored(marked.join(named, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest")).select("digest").distinct())
    texts = among(docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest")), wanted, "digest").dropDuplicates(["digest"])
    return stored(texts.select("text").mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"]))


def stars(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("node").alias("u"), F.col("root").alias("v"))


def nearest(pairs: DataFrame) -> DataFrame:
    """(u, v): the nearest of the pairs (u, v, d) of each node."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.struct("d", "u", "v").alias("pair"))
    return ends.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.u", "pair.v").distinct()


def linked(first: DataFrame, pairs: DataFrame, docs: DataFrame, marked: DataFrame, width: int, text_col: str, least: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root): the classes that the pairs ``first`` (u, v), asked at once, and ``pairs`` (u, v, d), asked where they are
    between classes, make of the classes ``known`` where they are alike to ``least``.
    """
    named = first.unionByName(pairs.select("u", "v")).select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = sets_of(named, docs, marked, width, text_col)
    label, left, asked, turn = known, pairs, first, 0
    while True:
        needed = sets if turn == 0 else among(sets, asked.select(F.explode(F.array("u", "v")).alias("node")), "node")
        links = stored(alike(asked, needed, least))
        if label is None or not links.isEmpty():
            # the classes so far are stars, which settle at once
            label = stored(components(links.unionByName(stars(label)) if label else links))
        if turn == 2:
            return label
        one, two = (label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv")
        apart = F.coalesce("u_root", "u") != F.coalesce("v_root", "v")
        left = stored(left.join(asked, ["u", "v"], "left_anti").join(one, "u", "left").join(two, "v", "left").where(apart).select("u", "v", "d"))
        if left.isEmpty():
            return label
        # a turn of the nearest alone pays where it spares more than it costs
        turn = 2 if turn == 1 or left.count() <= asked.count() else 1
        asked = stored(nearest(left) if turn == 1 else left.select("u", "v"))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest long, component long, component_id): one row for each row of ``docs``; ``digest`` is xxhash64 of its text.

    ``component`` numbers the texts that links join, and component_id is their smallest doc_id, null if none has one. Texts
    without words are alike.
    """
    marked = stored(fingerprints(docs, width, id_col, text_col))
    words = [f"w{w}" for w in range(WORDS)]
    nodes = stored(marked.groupBy("node").agg(*(F.first(w).alias(w) for w in words)).withColumn("label", F.col("node")))
    found = stored(candidates(nodes, CROWD).groupBy("u", "v").agg(F.min("d").alias("d"), F.max("d").alias("most")))
    crowds = stored(found.where("u = v").select(F.col("u").alias("node")))
    near = found.where(F.col("most") > HUB).select("u", "v", F.when(F.col("d") == HUB, F.col("most")).otherwise(F.col("d")).alias("d")).where("u <> v")
    hubs = found.where(F.col("d") == HUB).groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    first = stored(nearest(near).unionByName(hubs).distinct())
    pairs, crowded = near, not crowds.isEmpty()
    if crowded:
        # pairs inside crowds wait for the second pass, but for the first of them
        one, two = (crowds.select(F.col("node").alias(c)) for c in "uv")
        pairs = near.join(one, "u", "left_anti").unionByName(near.join(two, "v", "left_anti")).distinct()
    label = linked(first, stored(pairs), docs, marked, width, text_col, least)
    if crowded:
        # crowds gave only a few of their candidates: now all pairs of theirs between classes
        known = nodes.drop("label").join(crowds, "node", "left_semi").join(label.select("node", F.col("root").alias("label")), "node", "left")
        known = stored(known.withColumn("label", F.coalesce("label", "node")))
        apart = stored(candidates(known, -1).select(F.col("u").alias("node")).distinct())
        if not apart.isEmpty():
            known = stored(known.join(apart, "node", "left_semi").join(sets_of(apart, docs, marked, width, text_col), "node"))
            short = stored(candidates(known.where(F.size("hashes") <= LONG * 5 // 4), None, least=least).select("u", "v").distinct())
            label = stored(components(short.unionByName(stars(label))))
            more = stored(candidates(known.where(F.size("hashes") >= LONG).drop("hashes"), None).groupBy("u", "v").agg(F.min("d").alias("d")))
            if not more.isEmpty():
                label = linked(stored(nearest(more)), more, docs, marked, width, text_col, least, label)
    rooted = marked.select("doc_id", "digest", "node").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("doc_id", "digest", F.col("root").alias("component"), "component_id")
