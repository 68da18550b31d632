"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Its name is its depth and the exclusive or of two 64-bit hashes of each turn
with its place, a running value that a window gives without holding a conversation. Nodes are counted by a grouping that sums before it shuffles.

Totals go from children to parents. Nodes are sorted by reverse level order (deepest first, then by name), and a node sends its
totals to its parent through a priority queue, which gives them out when the parent's turn comes. The queue spills sorted runs
to scratch files of the running task; they have no name and end with it, so nothing has to outlive an executor.

A shard holds whole pieces of the trie. Nodes are classed by members: class 0 has up to ``LIGHT`` of them, class 1 up to its
square, and so on. Members never grow on the way down, so a class falls into pieces below one shard root each, and a piece has at
most ``LIGHT`` nodes a level, however many conversations share its start. Class 0 is processed first; the totals of its roots
are summed by parent and wait for the nodes of the next class, until no class is left. There are as many rounds as classes,
6 at most, whatever the depth.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut_lineage

#: Members of the largest nodes of class 0, messages of a queue in memory, sorted runs that a queue reads at a time.
LIGHT, QUEUE, RUNS = 4096, 200_000, 64
#: Nodes of many members that are broadcast: so many at most (4 MB), each with so many members at least.
MOST_SHARED, LEAST_SHARED = 100_000, 500
NAME = ["depth", "k1", "k2"]
_NODE = "depth long, k1 long, k2 long, parent1 long, parent2 long, parent_kind int, root boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


class SpillingQueue:
    """A priority queue of 5-tuples of 64-bit integers; beyond ``limit`` of them the heap is written out as a sorted run."""

    record = struct.Struct("<5q")

    def __init__(self, limit: int = QUEUE, runs: int = RUNS):
        self.limit, self.most = limit, max(2, runs)
        self.heap: list[tuple[int, ...]] = []
        self.files: list = []
        #: the next message of each run, with the run's place
        self.heads: list[tuple[tuple[int, ...], int]] = []
        self.spilled = 0

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill(sorted(self.heap))
            self.heap = []
            if len(self.heads) > self.most:
                waiting = [self._rest(self.files[run], message) for message, run in self.heads]
                self.files, self.heads = [], []
                self._spill(heapq.merge(*waiting))

    def _rest(self, file, message: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        yield message
        while data := file.read(self.record.size):
            yield self.record.unpack(data)
        file.close()

    def _spill(self, messages) -> None:
        file = tempfile.TemporaryFile()
        for message in messages:
            file.write(self.record.pack(*message))
            self.spilled += 1
        file.seek(0)
        self.files.append(file)
        self._advance(len(self.files) - 1)

    def _advance(self, run: int) -> None:
        if data := self.files[run].read(self.record.size):
            heapq.heappush(self.heads, (self.record.unpack(data), run))
        else:
            self.files[run].close()

    def first(self) -> tuple[int, ...] | None:
        """The least message, which stays."""
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            message, run = heapq.heappop(self.heads)
            self._advance(run)
            return message
        return heapq.heappop(self.heap)


def _time_forward(limit: int):
    """Nodes sorted by reverse level order, whose children are among them or have sent their sums, with their totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            children, leaves, saved = [], [], []
            for depth, k1, k2, p1, p2, root, n, size, got, got_leaves, got_saved in zip(
                *(c[x] for x in ("depth", "k1", "k2", "parent1", "parent2", "root", "n_convs", "size", "from_children", "from_leaves", "from_saved"))
            ):
                name = (-depth, k1, k2)
                while (message := queue.first()) is not None and message[:3] == name:
                    queue.pop()
                    got, got_leaves, got_saved = got + 1, got_leaves + message[3], got_saved + message[4]
                got_leaves, got_saved = got_leaves or 1, got_saved + (n - 1) * size
                if not root:
                    queue.push((1 - depth, p1, p2, got_leaves, got_saved))
                children.append(got)
                leaves.append(got_leaves)
                saved.append(got_saved)
            keep = ["depth", "k1", "k2", "parent1", "parent2", "parent_kind", "root", "conv_id", "parent_conv_id", "n_convs"]
            arrays = [batch.column(x) for x in keep] + [pa.array(x, pa.int64()) for x in (children, leaves, saved)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_children", "n_leaves", "saved_tokens"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each name of a sorted partition, id by id."""
    now, digest = None, None
    for batch in batches:
        out = []
        for *name, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if name != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = name, hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        if out:
            yield _named(out)
    if now is not None:
        yield _named([(*now, digest.hexdigest())])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows))[:3]), pa.array([r[3] for r in rows])], [*NAME, "ends_sha256"])


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, at long, h1 long, h2 long, size long): numbered turns by (turn, nulls first; role; text), with hashes and bytes of text.

    A null role or text is empty. Rows with a null conv_id belong to no conversation and are left out.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select(
        "conv_id", F.row_number().over(order).cast("long").alias("at"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit("again"), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("size"),
    )


def shared_starts(conversations: DataFrame, group: int = 5, longest: int = 9) -> DataFrame:
    """Conversations that begin with turns of the first of their group: (conv_id, at, h1, h2, size), and a row of depth 0 for each.

    Conversation c takes the first h turns of c - c % group (all if it has fewer, none if it is absent), then its own turns
    after its first h; h = crc32(c as decimal text) % longest. So at most longest - 1 turns are copied, group times.
    """
    turns = cut_lineage(turns_in_order(conversations))
    lengths = turns.groupBy("conv_id").agg(F.max("at").alias("n"))
    taken = F.crc32(F.col("conv_id").cast("string")) % longest
    ids = lengths.select("conv_id", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    given = ids.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("given"))
    start = ids.join(turns.where(F.col("at") < longest).withColumnRenamed("conv_id", "base"), "base").where("at <= h").select("conv_id", "at", "h1", "h2", "size")
    rest = turns.join(given, "conv_id").where("at > h").select("conv_id", (F.col("given") + F.col("at") - F.col("h")).alias("at"), "h1", "h2", "size")
    zero = F.lit(0).cast("long")
    return start.unionByName(rest).unionByName(ids.select("conv_id", *(zero.alias(x) for x in ("at", "h1", "h2", "size"))))


def prefix_trie(turns: DataFrame, light: int = LIGHT, queue: int = QUEUE) -> DataFrame:
    """One row per node of the trie of ``turns``: (conv_id, at, h1, h2, size), turns from 1, with a row of ``at`` 0 per conversation.

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over its subtree, (n_convs - 1) x bytes of the last text), ends_sha256 (of the ids of the conversations that
    end there, in order). Without a conversation there is no node. Equal conversations share all nodes. The ids of one node are
    digested as a stream by one task, and a conversation is numbered by one task as a stream: both can be long, neither large.
    """
    first = F.col("at") == 0
    path = Window.partitionBy("conv_id").orderBy("at")
    so_far = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = turns.select("conv_id", F.col("at").alias("depth"), "at", "size", F.when(first, 0).otherwise(F.xxhash64("at", "h1", "h2")).alias("t1"), F.when(first, 0).otherwise(F.xxhash64("h2", "h1", "at")).alias("t2"))
    named = place.select("conv_id", "depth", "size", F.bit_xor("t1").over(so_far).alias("k1"), F.bit_xor("t2").over(so_far).alias("k2"), F.lead("at").over(path).isNull().alias("ends"))
    rows = cut_lineage(named)
    counts = rows.groupBy(*NAME).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"))
    exceeds = [F.when(F.col("n_convs") > light ** (i + 1), 1).otherwise(0) for i in range(6) if light ** (i + 1) < 1 << 62]
    path = Window.partitionBy("conv_id").orderBy("depth")
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n_convs")).first()[0] or 0
    # nodes with more rows than that are MOST_SHARED at most, since their rows add up: they meet the rows as a broadcast
    shared = F.col("n_convs") > max(LEAST_SHARED, total // MOST_SHARED)
    large = F.broadcast(counts.where(shared))
    known = rows.join(large, NAME).unionByName(rows.join(large.select(*NAME), NAME, "left_anti").join(counts.where(~shared), NAME)).withColumn("kind", sum(exceeds, F.lit(0)))
    linked = known.select("*", F.lag("k1").over(path).alias("parent1"), F.lag("k2").over(path).alias("parent2"), F.lag("least").over(path).alias("parent_conv_id"))
    same = Window.partitionBy("conv_id", "kind").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = linked.withColumns({"head": F.first(F.struct(*NAME)).over(same), "parent_kind": F.lag("kind").over(path)})
    columns = [*NAME, "conv_id", "parent_conv_id", "parent1", "parent2", "parent_kind", "n_convs", "size", "kind", "head", (F.col("head") == F.struct(*NAME)).alias("root")]
    nodes = cut_lineage(head.where("conv_id = least").select(*columns))
    most = nodes.agg(F.max("kind")).first()[0]
    done = rows.sparkSession.createDataFrame([], _NODE)
    for kind in range(0 if most is None else most + 1):
        roots = done.where(F.col("root") & (F.col("parent_kind") == kind)).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("k1"), F.col("parent2").alias("k2"))
        sent = roots.agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        sums = {"from_children": "n", "from_leaves": "leaves", "from_saved": "saved"}
        now = nodes.where(F.col("kind") == kind).join(sent, NAME, "left").withColumns({a: F.coalesce(b, F.lit(0)) for a, b in sums.items()})
        dealt = now.repartition("head").sortWithinPartitions(F.desc("depth"), "k1", "k2").drop("head", "kind", *sums.values())
        done = done.unionByName(cut_lineage(dealt.mapInArrow(_time_forward(queue), _NODE)))
    ended = rows.where("ends").select(*NAME, "conv_id").repartition(*NAME).sortWithinPartitions(*NAME, "conv_id")
    ends = ended.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    return done.join(ends, NAME, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


#: Prefixes as lists; the subtree of a node is what its members pass through from there. The checksum is worked out bit by bit.
ORACLE_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, c - c % 5 AS base,
             xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
                 LAMBDA a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), LAMBDA x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
      FROM (SELECT DISTINCT c FROM t)),
s AS (SELECT i.c, 0 AS part, t.r, t.role, t.text FROM i JOIN t ON t.c = i.base AND t.r <= i.h
      UNION ALL SELECT i.c, 1, t.r, t.role, t.text FROM i JOIN t ON t.c = i.c AND t.r > i.h),
l AS (SELECT c, list({'role': role, 'text': text} ORDER BY part, r) AS turns FROM s GROUP BY c),
p AS (SELECT i.c, coalesce(l.turns, []) AS turns FROM i LEFT JOIN l ON i.c = l.c),
q AS (SELECT c, len(turns) AS n, d, sha256(to_json(turns[1 : d])) AS k, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS size,
             CASE WHEN d > 0 THEN sha256(to_json(turns[1 : d - 1])) END AS pk
      FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM p)),
m AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM q GROUP BY d, k),
k AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM m WHERE d > 0 GROUP BY d, pk),
g AS (SELECT DISTINCT a.d AS ad, a.k AS ak, b.d, b.k FROM q a JOIN q b ON a.c = b.c AND b.d >= a.d),
w AS (SELECT g.ad, g.ak, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((m.n_convs - 1) * m.size) AS saved
      FROM g JOIN m ON m.d = g.d AND m.k = g.k LEFT JOIN k ON k.d = g.d AND k.k = g.k GROUP BY g.ad, g.ak)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, coalesce(k.n, 0) AS n_children, w.leaves AS n_leaves,
       CAST(w.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN w ON w.ad = m.d AND w.ak = m.k LEFT JOIN k ON k.d = m.d AND k.k = m.k LEFT JOIN m u ON u.d = m.d - 1 AND u.k = m.pk"""
