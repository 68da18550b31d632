"""Substring deduplication with repeated-phrase automata.

A window is ``width`` consecutive words. Every window has an anchor, the least hash of its runs of ``width // 2`` words, so equal
windows have equal anchors; consecutive windows with one anchor form a segment. The work goes in three steps.

1. Candidates. Segments travel as hashes, without text. Anchors met in one document only are dropped. Of equal segments the
   documents after the first lose all words: each of their windows starts in the first one.
2. Confirmation. The segments of the first documents go, with their words, to shards by anchor. A shard keeps the windows that it
   meets in two documents or more as passages and compiles them into one Aho-Corasick automaton. Its letters are numbers of
   runs of words, told apart by their text, so a hit is an equal window and no likely one.
3. Streaming. All segments of a shard run through its automaton, which reports every occurrence with the smallest document.

Hashes only choose what is compared. A shard holds about ``SHARD`` segments; the windows of an anchor with more distinct segments
than that are dealt to shards one by one, by their own hash. No step gathers the rows of a key in one task: counts are summed
before they are shuffled, and the frequent anchors and segments meet their rows as a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut_lineage, joined_by_key, stored

#: Words of a window, segments in a shard, bytes of text that are hashed at a time, words whose hash a worker keeps.
WIDTH, SHARD, BLOCK_BYTES, KEPT_WORDS = 50, 20_000, 4_000_000, 1_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_SEGMENT = "doc_id {kind}, text_key long, anchor long, segment long, at int, n int"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[starts[i]:ends[i]], the same wherever the run lies."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(_MULTIPLIER, len(values)), dtype=np.uint64)])
    found = (sums[ends] - sums[starts]) * _powers(pow(_MULTIPLIER, -1, 1 << 64), len(values) + 1)[starts]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def segments_of(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, anchor) of the segments of one text, from the hashes of its words."""
    n = len(values) - width + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    part = max(1, width // 2)
    at = np.arange(len(values) - part + 1)
    least, have, need = run_hashes(values, at, at + part), 1, width - part + 1
    while have < need:
        step = min(have, need - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return starts, np.diff(np.append(starts, n)), least[starts]


def _segment_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            waiting = 0
            for row, text in enumerate(batch.column("text")):
                found = words_of(text.as_py())
                if len(found) < width:
                    continue
                values = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
                at, n, anchor = segments_of(values, width)
                out.append((np.full(len(at), row), anchor.view(np.int64), run_hashes(values, at, at + n + width - 1).view(np.int64), at, n))
                waiting += len(found) * 8
                if waiting > BLOCK_BYTES:
                    yield _packed(batch, out)
                    out, waiting = [], 0
            if out:
                yield _packed(batch, out)

    return run


def _packed(batch: pa.RecordBatch, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    row, anchor, segment, at, n = (np.concatenate(p) for p in zip(*parts))
    keys = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")]
    return pa.RecordBatch.from_arrays([*keys, pa.array(anchor), pa.array(segment), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "text_key", "anchor", "segment", "at", "n"])


def _cut_rows(width: int, shards: int):
    """From documents with the places of their segments: the words of each segment, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: dict[str, list] = {"shard": [], "row": [], "at": [], "text": []}
            size = 0
            for row, (text, places) in enumerate(zip(batch.column("text"), batch.column("places"))):
                found = words_of(text.as_py())
                for place in places.as_py():
                    at, n = place["at"], place["n"]
                    cuts = range(at, at + n) if place["split"] else (at,)
                    for start in cuts:
                        words = b" ".join(found[start : (start if place["split"] else at + n - 1) + width])
                        key = xxhash.xxh3_64_intdigest(words) if place["split"] else place["anchor"]
                        out["shard"].append(key % shards)
                        out["row"].append(row)
                        out["at"].append(start)
                        out["text"].append(words)
                        size += len(words)
                    if size > BLOCK_BYTES:
                        yield _with_keys(batch, out)
                        out, size = {c: [] for c in out}, 0
            if out["row"]:
                yield _with_keys(batch, out)

    return run


def _with_keys(batch: pa.RecordBatch, out: dict[str, list]) -> pa.RecordBatch:
    rows = pa.array(out["row"], pa.int64())
    keys = [batch.column(c).take(rows) for c in ("doc_id", "text_key")]
    return pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), *keys, pa.array(out["at"], pa.int32()), pa.array(out["text"], pa.binary())], ["shard", "doc_id", "text_key", "at", "text"])


class PhraseShard:
    """The segments of one shard; finds the windows that start in a smaller document too."""

    def __init__(self, width: int):
        self.width = width
        # words of a letter: windows are read as so many letters, and a text as ``letter`` interleaved rows of them
        self.letter = gcd(width, 10) if width > 10 else width
        self.docs: list = []
        self.words: list[list[bytes]] = []

    def add(self, doc, text: bytes) -> None:
        self.docs.append(doc)
        self.words.append(text.split(b" "))

    def confirmed(self) -> list[np.ndarray]:
        """Of each segment, the starts of windows whose hash the shard meets in two documents or more."""
        hashes, docs, sizes = [], [], []
        rank = {doc: i for i, doc in enumerate(sorted(set(self.docs)))}
        for doc, words in zip(self.docs, self.words):
            values = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
            at = np.arange(len(words) - self.width + 1)
            hashes.append(run_hashes(values, at, at + self.width))
            docs.append(np.full(len(at), rank[doc]))
            sizes.append(len(at))
        found, which = np.unique(np.concatenate(hashes), return_inverse=True)
        of = np.concatenate(docs)
        least, most = np.full(len(found), len(rank)), np.full(len(found), -1)
        np.minimum.at(least, which, of)
        np.maximum.at(most, which, of)
        return [np.flatnonzero(part) for part in np.split((least < most)[which], np.cumsum(sizes)[:-1])]

    def located(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(segment, ranges of its words) for the segments that lose words."""
        import ahocorasick

        confirmed = self.confirmed()
        numbers: dict[bytes, int] = {}
        firsts: dict[tuple[int, ...], object] = {}
        letters, size = [], self.letter
        for doc, words, starts in zip(self.docs, self.words, confirmed):
            # only texts that hold a confirmed window have letters
            row = [] if not len(starts) else [numbers.setdefault(b" ".join(words[i : i + size]), len(numbers) + 1) for i in range(len(words) - size + 1)]
            letters.append(row)
            for start in starts.tolist():
                phrase = tuple(row[start : start + self.width : size])
                if phrase not in firsts or doc < firsts[phrase]:
                    firsts[phrase] = doc
        if not firsts:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, doc in firsts.items():
            automaton.add_word(phrase, doc)
        automaton.make_automaton()
        span = self.width // size
        for segment, (doc, row) in enumerate(zip(self.docs, letters)):
            hits = []
            for offset in range(min(size, len(row))):
                for end, first in automaton.iter(tuple(row[offset::size])):
                    if first < doc:
                        hits.append(offset + (end - span + 1) * size)
            if hits:
                yield segment, merged([(start, start + self.width) for start in hits])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _shard_rows(width: int, kind: pa.DataType):
    """Each shard of a sorted partition is read, compiled and streamed before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "from", "to"]

        def close() -> Iterator[pa.RecordBatch]:
            rows = [(*places[i][:2], places[i][2] + a, places[i][2] + b) for i, ranges in shard.located() for a, b in ranges]
            if rows:
                doc, key, start, end = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names)

        now, shard, places = None, PhraseShard(width), []
        for batch in batches:
            for name, doc, key, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now and places:
                    yield from close()
                    shard, places = PhraseShard(width), []
                now = name
                shard.add(doc, text)
                places.append((doc, key, at))
        if places:
            yield from close()

    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, text_key, from, to): ranges of words, the end not included, that lie in windows of earlier documents.

    ``text_key`` is xxhash64 of the text; with the id it names a row, so that rows that repeat an id keep their own ranges. Rows of
    one id never take words from each other. Rows with a null id lose no word and make no other row lose one. Null, empty and short
    texts have no window. Ranges of a row can overlap. An empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # several steps read these; without the cuts each would hash all texts again
    segments = stored(known.mapInArrow(_segment_rows(width), _SEGMENT.format(kind=kind)))
    recurring = segments.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("__n")).where("a < b").select("anchor", "__n")
    of = cut_lineage(joined_by_key(segments, cut_lineage(recurring), ["anchor"]))
    first = cut_lineage(of.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first"), F.count("*").alias("__n")))
    crowd = first.groupBy("anchor").agg((F.count("*") > shard).alias("split"))
    placed = cut_lineage(joined_by_key(of, first.join(crowd, "anchor"), ["anchor", "segment"]).select("doc_id", "text_key", "anchor", "at", "n", "first", "split"))
    whole = placed.where("doc_id > first").select("doc_id", "text_key", F.col("at").alias("from"), (F.col("at") + F.col("n") + (width - 1)).alias("to"))
    own = placed.where("doc_id = first")
    shards = max(1, own.agg(F.sum(F.expr("if(split, n, 1)"))).first()[0] or 0) // shard + 1
    places = own.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n", "anchor", "split")).alias("places"))
    # equal rows hold the same places: one of them is enough
    texts = known.join(places, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "places")
    cut = texts.mapInArrow(_cut_rows(width, shards), f"shard int, doc_id {kind}, text_key long, at int, text binary")
    arrow = _arrow_type(docs, id_col)
    located = cut.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(_shard_rows(width, arrow), f"doc_id {kind}, text_key long, from int, to int")
    return whole.unionByName(located)


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def remove_passages(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words long, n_removed long, kept string): a row for each row of ``docs``, without the repeated passages.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller id; windows are judged on the
    input. ``kept`` holds the other words, joined by one space. Nulls, repeated rows and short texts: see `repeated_passages`; a
    null text keeps the empty string. Other columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    ranges = repeated_passages(docs, width, id_col, text_col, shard).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, removed, kept = [], [], []
                for text, gone in zip(batch.column("text"), batch.column("ranges")):
                    words = words_of(text.as_py())
                    sizes.append(len(words))
                    last, parts, lost = 0, [], 0
                    for start, end in merged([(r["from"], r["to"]) for r in gone.as_py() or ()]):
                        parts.extend(words[last:start])
                        last, lost = end, lost + end - start
                    removed.append(lost)
                    kept.append(b" ".join(parts + words[last:]))
                arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(ranges, ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


#: Every window of every document by its words, and the smallest document that it starts in.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
v AS (SELECT r, doc_id, s, sha256(array_to_string(w[s : s + 49], ' ')) AS h FROM i),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT v.r, unnest(range(v.s, v.s + 50)) AS p FROM v JOIN f ON v.h = f.h AND v.doc_id > f.first),
l AS (SELECT r, list(p) AS gone FROM g GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(gone, p)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN l ON d.r = l.r"""
