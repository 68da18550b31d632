"""Alignment of the tokens of two vocabularies by the places where both end.

Each tokenizer's ends are an ascending list of byte offsets. The shorter list drives: for each of its ends a step that doubles
looks ahead in the longer one from the last place found, and a binary search ends it. The common ends cut both token rows into
groups; differences of their ranks say how many tokens of either side a group holds. At each common end the two tokens that end there are linked.

Corpus-wide counts of linked pairs are summed in the tasks before they are shuffled, so frequent pairs are no hot keys. The most
frequent ones, ``HELD`` at most, are broadcast as two arrays (16 bytes a pair and a bit); links of others go through a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bpe_forced import byte_symbols, vocabulary_path
from lexmill.llm.common import cut_lineage

#: Pairs in the broadcast table, links that a task sums at a time, characters of a text encoded at a time, texts with those together,
#: and words whose ids a worker keeps.
HELD, LINKS, PIECE, BATCH = 1 << 21, 4_000_000, 1 << 16, 1 << 18
#: A space that starts a token of both vocabularies, whatever comes before: a text may be cut there.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Fixed value: how byte-level vocabularies of this kind split a text, and signs on whose classes both libraries agree.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = re.compile("[^\x00-\u024f]")


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indices in ``a`` and in ``b`` of the values that both ascending lists hold."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, at = len(long), 0
    mine: list[int] = []
    theirs: list[int] = []
    for i, end in enumerate(short):
        if at == n:
            break
        if long[at] < end:
            low, step = at + 1, 1
            while low + step <= n and long[low + step - 1] < end:
                low += step
                step += step
            at = bisect_left(long, end, low, min(low + step, n))
            if at == n:
                break
        if long[at] == end:
            mine.append(i)
            theirs.append(at)
            at += 1
    return (mine, theirs) if short is a else (theirs, mine)


class TokenizerPair:
    """A byte-level vocabulary of ``tokenizers`` and a model of ``sentencepiece``, which puts a space before each text itself."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte_of = {sign: bytes([i]) for i, sign in enumerate(byte_symbols())}
        self.bytes_a = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(byte_of[s] for s in token) if all(s in byte_of for s in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.fast = self._by_rank(a)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        # ids as text with the sign behind them inside a group and at its end
        self.names_a, self.names_b = (tuple(np.array([f"{x}{sign}" for x in range(len(table))], object) for sign in signs) for table, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        # a cut is safe for the second only if no piece has a space after another sign
        self.cuts = not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_control(i))

    def _by_rank(self, path: str):
        """The same vocabulary in a library that is several times faster; None unless merges are ranked by their ids and texts are split as in ``SPLIT``."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        step = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = spec["normalizer"] is None and step.items() <= (spec["pre_tokenizer"] or {}).items()
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or made != sorted(made) or any(spec["model"].get(o) for o in options):
            return None
        import tiktoken

        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {self.bytes_a[i]: i for i in vocab.values() if i not in special}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if made and min(made) > 255 else None

    def parts(self, text: str) -> list[str]:
        """The text in parts that start with a space, all but the first with their own."""
        out, start = [], 0
        while self.cuts and len(text) - start > PIECE:
            found = _CUT.search(text, start + PIECE)
            if not found:
                break
            out.append(text[start : found.start()])
            start = found.end()
        return [*out, text[start:]]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids on both sides of each text; none if it is null or empty, or if a side does not give its bytes again."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH):
                size += len(texts[end] or "")
                end += 1
            yield from self._encode([self.parts(t) if t else [] for t in texts[at:end]])
            at = end

    def _encode(self, split: list[list[str]]) -> Iterator[tuple[list[int], list[int]]]:
        flat = [part for parts in split for part in parts]
        # a part of a long text at a time, so that what the libraries hold beside the ids stays small
        first = iter(self._ids(flat))
        second = iter(self.b.encode(flat, num_threads=1)) if flat else iter(())
        for parts in split:
            a = [i for _ in parts for i in next(first)]
            b = [i for _ in parts for i in next(second)]
            whole = (" " + " ".join(parts)).encode() if parts else b""
            same = parts and b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            yield (a, b) if same else ([], [])

    def _ids(self, flat: list[str]) -> Iterator[list[int]]:
        for part in flat:
            if self.fast and not _RARE.search(part):
                yield self.fast.encode_ordinary(" " + part)
            else:
                yield self.a.encode_batch_fast([" " + part], add_special_tokens=False)[0].ids

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """The places in ``a`` and ``b`` of the tokens that end together."""
        return common_ends(np.cumsum(self.sizes_a[a]).tolist(), np.cumsum(self.sizes_b[b]).tolist())

    def groups(self, a: np.ndarray, b: np.ndarray, i: list[int], j: list[int]) -> str:
        """``a1,a2|b1;a3|b2,b3``: a token stands behind its own side's and as many of the other side's as end in groups before."""
        if not i:
            return ""
        last_a, last_b = np.array(i), np.array(j)
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out = np.empty(len(a) + len(b), object)
        for ids, last, at, (inner, final) in (
            (a, last_a, np.repeat(last_b + 1 - sizes_b, sizes_a), self.names_a), (b, last_b, np.repeat(last_a + 1, sizes_b), self.names_b),
        ):
            named = inner[ids]
            named[last] = final[ids[last]]
            out[np.arange(len(ids)) + at] = named
        return "".join(out.tolist())[:-1]


@lru_cache(maxsize=2)
def tokenizer_pair(a: str, b: str) -> TokenizerPair:
    return TokenizerPair(vocabulary_path(a), vocabulary_path(b))


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("spans",)) -> DataFrame:
    """doc_id, n_a long, n_b long, n_groups long, and of ``outputs``: one row for each row of ``docs``, over its whole text.

    ``spans`` array<struct<a_to:int,b_to:int>>: where each group ends in the token rows (it starts where the one before ends);
    ``groups`` string: its ids as ``a1,a2|b1;a3|b2,b3``; ``groups_sha256``: their digest, empty for a text without tokens;
    ``ids_a``, ``ids_b`` array<int>; ``links`` binary: the ids that end together, all of a and then all of b, as little-endian
    unsigned integers of 2 bytes, or 4 if a vocabulary has over 65,536 ids. A null or empty text, or one that a vocabulary does
    not give back byte by byte, has no tokens. Rows that repeat an id count each; null ids stay; no other column is read.
    """
    kinds = {"spans": "array<struct<a_to:int,b_to:int>>", "groups": "string", "groups_sha256": "string", "ids_a": "array<int>", "ids_b": "array<int>", "links": "binary"}
    spans = pa.list_(pa.struct([("a_to", pa.int32()), ("b_to", pa.int32())]))
    arrow = {"spans": spans, "groups": pa.string(), "groups_sha256": pa.string(), "ids_a": pa.list_(pa.int32()), "ids_b": pa.list_(pa.int32()), "links": pa.binary()}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a, b)
        width = link_width(pair)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                counts, made = [], {c: [] for c in outputs}
                for x, y in pair.encode(batch.column(1).to_pylist()):
                    at_a, at_b = np.array(x, np.int64), np.array(y, np.int64)
                    i, j = pair.align(at_a, at_b)
                    counts.append((len(x), len(y), len(i)))
                    groups = pair.groups(at_a, at_b, i, j) if {"groups", "groups_sha256"} & made.keys() else ""
                    ends = {
                        "spans": lambda: [{"a_to": p + 1, "b_to": q + 1} for p, q in zip(i, j)],
                        "groups": lambda: groups,
                        "groups_sha256": lambda: hashlib.sha256(groups.encode()).hexdigest() if x else "",
                        "ids_a": lambda: x,
                        "ids_b": lambda: y,
                        "links": lambda: np.concatenate([at_a[i], at_b[j]]).astype(width).tobytes() if i else b"",
                    }
                    for c in made:
                        made[c].append(ends[c]())
                numbers = [pa.array(c, pa.int64()) for c in zip(*counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, *(pa.array(made[c], arrow[c]) for c in made)], ["doc_id", "n_a", "n_b", "n_groups", *made])

    columns = ", ".join(f"{c} {kinds[c]}" for c in outputs)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long" + (f", {columns}" if columns else ""))


def link_width(pair: TokenizerPair) -> str:
    return "<u2" if max(len(pair.bytes_a), len(pair.bytes_b)) <= 1 << 16 else "<u4"


def _pairs(links: bytes, width: str) -> np.ndarray:
    """a << 32 | b of each link."""
    both = np.frombuffer(links, width).astype(np.int64).reshape(2, -1)
    return both[0] << 32 | both[1]


def pair_counts(aligned: DataFrame, width: str) -> DataFrame:
    """(pair long, n long, best boolean): links of each pair of ids, and whether no other pair with its b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([_pairs(x, width) for x in waiting]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pair", "n"])

        waiting, size = [], 0
        for batch in batches:
            for links in batch.column(0).to_pylist():
                waiting.append(links)
                size += len(links)
                if size > LINKS * 4:
                    yield sums()
                    waiting, size = [], 0
        if size:
            yield sums()

    counts = aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_strength(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): how the links of a text stand in the corpus.

    ``n_best`` counts links whose pair is the most frequent of its b id, ties included; ``count_sum`` adds the corpus-wide
    counts of its links. Rows as in `align`; an empty table gives no row.
    """
    width = link_width(tokenizer_pair(a, b))
    aligned = cut_lineage(align(docs, a, b, id_col, text_col, ("groups_sha256", "links")).withColumn("row", F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(aligned, width))
    level = F.floor(F.log2("n")).cast("int")
    levels = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, room = 64, held
    while least > 0 and room >= levels.get(least - 1, 0):
        least -= 1
        room -= levels.get(least, 0)
    frequent = counts.where(level >= least).orderBy("pair").toArrow()
    table = docs.sparkSession.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            sums, bests, rest = [], [], []
            for links in batch.column("links").to_pylist():
                found = _pairs(links, width)
                at = np.searchsorted(pairs, found)
                known = np.zeros(len(found), bool)
                known[at < len(pairs)] = pairs[at[at < len(pairs)]] == found[at < len(pairs)]
                sums.append(int(n[at[known]].sum()))
                bests.append(int(best[at[known]].sum()))
                rest.append(found[~known].tolist())
            keep = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
            arrays = [*(batch.column(c) for c in keep), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_best", "count_sum", "rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = aligned.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, rest array<long>")
    if sum(levels.values()) > frequent.num_rows:
        told = cut_lineage(told)
        rare = told.select("row", F.explode("rest").alias("pair")).join(counts, "pair").groupBy("row").agg(F.count_if("best").alias("more_best"), F.sum("n").alias("more"))
        told = told.join(rare, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return told.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
