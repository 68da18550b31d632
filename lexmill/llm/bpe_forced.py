"""Byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so every such pair in a word marks a certain
cut. The fragments between cuts are encoded by themselves and their ids are joined; the result is that of the whole word.
Ids of a text depend only on its white-space-free runs, so each task keeps a bounded table of the runs it has met.

The vocabulary is a ``tokenizers`` JSON file of the kind "BPE with word ends": NFC, white space to one space, lower case,
a split into letters, single digits and other signs, byte-level symbols, and an end-of-word suffix. The library that such files
are made for knows other versions of Unicode than Python. Texts with code points that Python has not assigned are normalised
and split by that library; their fragments are encoded like any others.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs whose ids a worker keeps; later ones are encoded once for each block of texts.
KEPT_RUNS = 250_000
#: Texts in a block.
BLOCK = 1000
NONE = 1 << 62
#: A fragment of more bytes than this is merged by itself, with a heap.
LONG_FRAGMENT = 512
#: Characters that the splitting pattern takes as white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: str.split() also cuts at these, which the pattern does not.
NOT_SPACES = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex
        import tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = tokenizers.Tokenizer.from_file(path)
        #: characters met so far that this Python has assigned, and that it has not
        self.assigned: set[str] = set()
        self.new: set[str] = set()
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.symbols = byte_symbols()
        self.first_ids = np.array([[vocab[s] for s in self.symbols], [vocab[s + self.suffix] for s in self.symbols]], np.int64)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        keys = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        #: left id << 32 | right id, ascending, and rank << 32 | merged id, so that the least value is the next merge
        self.pair_keys, self.pair_values = keys[order], np.array([r << 32 | m[2] for r, m in enumerate(merges)], np.int64)[order]
        self.value_of = dict(zip(keys.tolist(), (r << 32 | m[2] for r, m in enumerate(merges))))
        self.byte_of = byte_of = {s: i for i, s in enumerate(self.symbols)}
        #: the byte pairs inside tokens; any other pair is a forced boundary
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            inside = [byte_of[c] for c in token.removesuffix(self.suffix)]
            self.joined[inside[:-1], inside[1:]] = True
        self.token_bytes = [t.encode() for t in self.tokens]
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACES + r"\p{L}\p{N}]+")
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.blank = regex.compile("[" + SPACES + "]+")
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], NONE)

    def merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Ids of a long fragment, and the place of each: the next merge is the first of the least rank, found by a heap."""
        n, value_of = len(ids), self.value_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(value >> 32, at, ids[at] << 32 | ids[at + 1]) for at in range(n - 1) if (value := value_of.get(ids[at] << 32 | ids[at + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, key = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right >= n or ids[at] << 32 | ids[right] != key:
                continue
            ids[at], ids[right] = value_of[key] & 0xFFFFFFFF, -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n:
                    key = ids[left] << 32 | ids[after[left]]
                    if (value := value_of.get(key)) is not None:
                        heapq.heappush(heap, (value >> 32, left, key))
        places = [at for at in range(n) if ids[at] >= 0]
        return [ids[at] for at in places], places

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each piece has. All fragments are merged side by side."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(p) for p in pieces])
        last = np.zeros(len(data), np.int64)
        last[np.cumsum(lengths) - 1] = 1
        starts = np.ones(len(data), bool)
        starts[1:] = (last[:-1] == 1) | ~self.joined[data[:-1], data[1:]]
        ids, place, group = self.first_ids[last, data], np.arange(len(data)), np.cumsum(starts) - 1
        done_ids, done_place = [], []
        heads = np.flatnonzero(starts)
        sizes = np.diff(np.r_[heads, len(ids)])
        if (sizes > LONG_FRAGMENT).any():
            for head, size in zip(heads[sizes > LONG_FRAGMENT].tolist(), sizes[sizes > LONG_FRAGMENT].tolist()):
                made, at = self.merge_long(ids[head : head + size].tolist())
                done_ids.append(np.array(made, np.int64))
                done_place.append(np.array(at, np.int64) + head)
            short = np.repeat(sizes <= LONG_FRAGMENT, sizes)
            ids, place, group = ids[short], place[short], group[short]
        ranks = np.full(len(ids), NONE)
        ranks[:-1] = np.where(group[1:] == group[:-1], self.pair_ranks(ids[:-1], ids[1:]), NONE)
        while len(ids):
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            best = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.r_[heads, len(ids)]))
            ended = best == NONE
            if ended.any():
                done_ids.append(ids[ended])
                done_place.append(place[ended])
                ids, place, group, ranks, best = (x[~ended] for x in (ids, place, group, ranks, best))
                if not len(ids):
                    break
            hit = np.flatnonzero(ranks == best)
            hit = hit[np.r_[True, group[hit[1:]] != group[hit[:-1]]]]
            ids[hit] = best[hit] & 0xFFFFFFFF
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))
            ids, place, group, ranks = (x[stay] for x in (ids, place, group, ranks))
            for at in (moved, moved[moved > 0] - 1):
                right = np.minimum(at + 1, len(ids) - 1)
                same = (at + 1 < len(ids)) & (group[right] == group[at])
                ranks[at] = np.where(same, self.pair_ranks(ids[at], ids[right]), NONE)
        place = np.concatenate(done_place)
        order = np.argsort(place)
        piece_of = np.repeat(np.arange(len(pieces)), lengths)[place]
        return np.concatenate(done_ids)[order], np.bincount(piece_of, minlength=len(pieces))

    def encode_runs(self, runs: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Of normalised runs without white space: packed ids, and the decoded text in UTF-8."""
        pieces, counts = [], []
        for run in runs:
            if self.new and self.is_new(run):
                found = [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(run)]
            else:
                found = [piece.encode() for piece in ([run] if run.isalpha() else self.pieces.findall(run))]
            counts.append(len(found))
            pieces += found
        if not pieces:
            return {r: (b"", b"") for r in runs}
        ids, sizes = self.encode_pieces(pieces)
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)].tolist()
        packed, every, token, start, out = ids.astype("<u4").tobytes(), ids.tolist(), self.token_bytes, 0, {}
        for run, end in zip(runs, ends):
            out[run] = packed[4 * start : 4 * end], b" ".join([token[i] for i in every[start:end]])
            start = end
        return out

    def is_new(self, text: str) -> bool:
        """Whether a text holds a code point that this Python has not assigned; Latin-1 has none."""
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            signs = set(text)
        for sign in signs.difference(self.assigned):
            (self.new if unicodedata.category(sign) == "Cn" else self.assigned).add(sign)
        return not self.new.isdisjoint(signs)

    def runs(self, text: str) -> list[str]:
        """The normalised runs of a text that holds no special token."""
        if not text.isascii():
            if self.is_new(text):
                return [r for r in self.blank.split(self.library.normalizer.normalize_str(text)) if r]
            text = unicodedata.normalize("NFC", text)
        # each character is lower-cased by itself; str.lower() looks around a capital sigma
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        if any(c in text for c in NOT_SPACES):
            return [r for r in self.blank.split(text) if r]
        return text.split()

    def parts(self, text: str) -> list[list[str] | str]:
        """Lists of runs, and special tokens between them."""
        if not text.isascii():
            text = text.encode("utf-8", "replace").decode()
        if not self.cut_special or not self.cut_special.search(text):
            return [self.runs(text)]
        return [p if p in self.special else self.runs(p) for p in self.cut_special.split(text)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each whole text: little-endian unsigned 32-bit ids, and what they decode to, in UTF-8."""
        split, known = [self.parts(t) for t in texts], self.known
        missing = list({r for parts in split for p in parts if not isinstance(p, str) for r in p}.difference(known))
        fresh = self.encode_runs(missing)
        if len(known) < KEPT_RUNS:
            known.update((r, e) for r, e in fresh.items() if len(r) <= 100)
            fresh = {r: e for r, e in fresh.items() if len(r) > 100}
        special = {t: (np.array([i], "<u4").tobytes(), t.encode()) for t, i in self.special.items()}
        out = []
        for parts in split:
            both = []
            for p in parts:
                if isinstance(p, str):
                    both.append(special[p])
                elif fresh:
                    both += [known.get(r) or fresh[r] for r in p]
                else:
                    both += [known[r] for r in p]
            out.append((b"".join([i for i, _ in both]), b" ".join([w for i, w in both if i])))
        return out

    def decode(self, ids) -> str:
        """Token strings joined by a space: what a vocabulary file without a decoder gives."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker process and file."""
    return ForcedBoundaryBPE(path)


def vocabulary_path(path_or_name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public vocabularies."""
    if "/" in path_or_name:
        return path_or_name
    import public_tokenizers

    return public_tokenizers.path(path_or_name)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Encode every whole text; null is the empty text. One row for each row, also for repeated ids.

    Columns: doc_id, those of ``keep``, then of ``outputs`` any of n_tokens long, ids array<int>, packed_ids binary
    (little-endian unsigned 32 bits), decoded string. Nothing else of ``docs`` is read, so clashing names do no harm.
    """
    kinds = {"n_tokens": "long", "ids": "array<int>", "packed_ids": "binary", "decoded": "string"}
    taken = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{c}` {k}" for c, k in taken.dtypes[:-1]), *(f"{o} {kinds[o]}" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary_path(vocabulary))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                both = bpe.encode(batch.column(batch.num_columns - 1).to_pylist())
                made = {
                    "n_tokens": lambda both=both: pa.array([len(i) // 4 for i, _ in both], pa.int64()),
                    "ids": lambda both=both: pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in both], pa.list_(pa.int32())),
                    "packed_ids": lambda both=both: pa.array([i for i, _ in both], pa.binary()),
                    "decoded": lambda both=both: pa.array([w.decode() for _, w in both], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(made[o]() for o in outputs)], [*batch.schema.names[:-1], *outputs])

    return taken.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded string) from an ids array<int> column; null ids decode to the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary_path(vocabulary))
        for batch in batches:
            texts = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")
