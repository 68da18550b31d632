"""Unigram token counts with a trie of pre-tokens.

The distinct pre-tokens of a block of texts are inserted in a trie. The best segmentation of a prefix does not depend on
what follows, so the forward score (best sum of piece scores) and its number of tokens are computed once per trie node,
from the nodes of its shorter prefixes; the nodes at which pre-tokens end store the counts that texts then add up.

The trie is visited in the order of its sorted words: the path to the last word is kept, and the next word shares the part
that both begin with. Words keep their counts in a bounded table of each worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bpe_forced import vocabulary_path

#: Words whose counts a worker keeps, texts in a block, and the sign put before each word.
KEPT_WORDS, BLOCK, WORD_START = 400_000, 1000, "▁"


class TrieCounter:
    """Pieces with scores; characters in no piece cost one token for each byte of their UTF-8."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        #: how far a piece that ends with this character can reach back
        self.reach: dict[str, tuple[int, ...]] = {}
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.reach = {c: tuple(sorted(found)) for c, found in lengths.items()}
        self.known: dict[str, int] = {}

    def count(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct word. Ties of the score go to fewer tokens."""
        scores, reach, out = self.scores, self.reach, {}
        best, tokens, last = [0.0], [0], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                sign = word[end - 1]
                top, least = -math.inf, 0
                for length in reach.get(sign, ()):
                    if length > end:
                        break
                    score = scores.get(word[end - length : end])
                    if score is not None:
                        score += best[end - length]
                        n = tokens[end - length] + 1
                        if score > top or score == top and n < least:
                            top, least = score, n
                if top == -math.inf:
                    size = len(sign.encode("utf-8", "replace"))
                    top, least = best[end - 1] + self.unknown * size, tokens[end - 1] + size
                best.append(top)
                tokens.append(least)
            out[word] = tokens[-1]
            last = word
        return out

    def totals(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        split = [(t or "").split() for t in texts]
        known = self.known
        fresh = self.count([WORD_START + w for w in {w for words in split for w in words}.difference(known)])
        fresh = {w[1:]: n for w, n in fresh.items()}
        if len(known) < KEPT_WORDS:
            known.update((w, n) for w, n in fresh.items() if len(w) <= 100)
        both = known if not fresh else _Both(known, fresh)
        get = both.__getitem__
        return [sum(map(get, words)) for words in split]


class _Both(dict):
    """A block's new words; others are looked up in the table kept."""

    def __init__(self, known: dict[str, int], fresh: dict[str, int]):
        super().__init__(fresh)
        self.kept = known

    def __missing__(self, word: str) -> int:
        return self.kept[word]


@lru_cache(maxsize=2)
def counter(path: str) -> TrieCounter:
    """Pieces of a sentencepiece model; the piece of rank r among n has the probability (1 / (r + 1)) / H(n)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return TrieCounter({p: -math.log(r + 1) - norm for r, p in enumerate(pieces)})


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words long, n_tokens long): one row for each row of ``docs``, over its whole text.

    Pre-tokens are the runs without white space, each with ``WORD_START`` before it. Null, empty and blank texts have none.
    Rows that repeat an id are counted by row; no other column is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = counter(vocabulary_path(vocabulary))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                texts = batch.column(1).to_pylist()
                counts = [pa.array([len((t or "").split()) for t in texts], pa.int64()), pa.array(trie.totals(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
