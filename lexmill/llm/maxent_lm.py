"""Scoring texts with a hashed maximum-entropy language model.

The softmax is factored by classes: P(token | history) = P(class | history) P(cell | class, history) P(token | cell). The frequent
words have a class each, the others share classes by a hash of their ending, the end of a text is a class of its own. A class
is cut into cells by a hash of the whole word.

* P(class | history) is log-linear in hashed features of the classes before: the last, the last two (n-grams), the one before
  the last and a coarse form of the third last (skips). Its sufficient statistics, counts of (history, class), come from all
  training texts; full-batch gradients are computed in tasks over parts of that table, summed, and applied by the driver.
* Both P(class | history) and P(cell | class, history) have features of words: the last word, the last two, the last three
  (n-grams), and the one before the last (a skip). A table of hashed histories keeps, for each, the cell that has followed it
  most often in all training texts. The feature "this cell followed this history" has a weight by kind of history, count
  and share. The weights are fitted by distributed Newton steps over all training texts that leave each token's own count out.
* P(token | cell) comes from the counts of all tokens of the training texts, which stay a distributed table; the most
  frequent tokens are answered where they stand. Texts are scored in blocks: each block sends its other distinct tokens with
  their places once through a join with the counts, and sparse numpy sums bring the logarithms back to the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut_lineage, power_of_two

#: Classes: the end of a text, frequent words with their own class, and endings. Cells of a class.
CLASSES, FREQUENT, CELLS = 64, 31, 1024
ENDINGS = CLASSES - FREQUENT - 1
#: Coarse classes of the third last token, and so histories of classes; how many of them a part of the statistics holds.
COARSE = 8
HISTORIES = CLASSES * CLASSES * COARSE
PART = 512
#: Rows of the weight matrix, gradient steps, their length, and a prior count.
FEATURES, STEPS, RATE, RIDGE = 1 << 13, 10, 0.45, 2.0
#: Kinds of word histories; slots of their table grow with the training tokens, PER_TOKEN for each, within bounds: it is broadcast.
KINDS, PER_TOKEN, FEWEST_SLOTS, MOST_SLOTS, SLOT_PART = 4, 8, 1 << 16, 1 << 21, 4096
#: Steps of a weight by count and by share, and so weights of a factor; training documents, as expected, from which the fit to all
#: of them starts; the most steps of a fit, how far one moves a weight, and what the last one promises for each token at most, in nats.
COUNTS, SHARES, WEIGHT_DOCS, WEIGHT_STEPS, FARTHEST, SETTLED = 6, 4, 3000, 20, 3.0, 3e-4
WEIGHTS = KINDS * COUNTS * SHARES
#: Frequent tokens whose counts every task knows, at most.
ANSWERED = 1 << 16
#: Tokens of a task that gathers statistics, and the fewest such tasks.
TASK_TOKENS, FEWEST_TASKS = 4_000_000, 8
#: Characters of a block of texts from which statistics are gathered.
SEEN_CHARS = 1_500_000
#: A block of texts; places are packed as document << 20 | times. Places whose word features are looked up at once.
BLOCK_DOCS, BLOCK_CHARS, MOST_TIMES, PLACES = 2000, 4_000_000, (1 << 20) - 1, 1 << 17
END = b""
#: Bytes between tokens.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def class_of(token: bytes, frequent: dict[bytes, int]) -> int:
    if not token:
        return 0
    return frequent.get(token) or 1 + FREQUENT + zlib.crc32(token[-2:]) % ENDINGS


#: Classes of the endings of one byte, then of those of two.
ENDING_OF = np.array([class_of(bytes(x), {}) for x in [*((i,) for i in range(256)), *((i, j) for i in range(256) for j in range(256))]])


def blocks(batches: Iterator[pa.RecordBatch], text_at: int, most_chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        start, held, size = 0, [], 0
        for at, text in enumerate(batch.column(text_at)):
            held.append(text.as_py())
            size += len(held[-1] or "")
            if size >= most_chars or len(held) == BLOCK_DOCS:
                yield batch.slice(start, len(held)), held
                start, held, size = at + 1, [], 0
        if held:
            yield batch.slice(start, len(held)), held


def tokens_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens as they first occur, the token number at each place (an end after each text), and the length of each text in tokens."""
    parts = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    upto = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
    offsets = np.r_[0, np.cumsum(np.insert(ends - starts, upto, 0))].astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
    return every.dictionary, every.indices.to_numpy().astype(np.int64), np.diff(upto, prepend=0) + 1


def held(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each token begins and the last one ends, and their bytes."""
    _, offsets, data = tokens.buffers()
    offsets = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)


def classes_of(distinct: pa.Array, frequent: dict[bytes, int]) -> np.ndarray:
    """As `class_of`, of all tokens at once."""
    offsets, data = held(distinct)
    sizes, ends = np.diff(offsets), offsets[1:]
    out = np.zeros(len(distinct), np.int64)
    one, more = sizes == 1, sizes > 1
    out[one] = ENDING_OF[data[ends[one] - 1]]
    out[more] = ENDING_OF[256 + data[ends[more] - 2].astype(np.int64) * 256 + data[ends[more] - 1]]
    own = pc.index_in(distinct, pa.array(list(frequent), pa.large_binary())).fill_null(-1).to_numpy()
    return np.where(own >= 0, np.array([*frequent.values(), 0])[own], out)


def histories(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The history of each place; before a text there are ends."""
    begins = np.cumsum(lengths) - lengths
    back = []
    for k in (1, 2, 3):
        past = np.zeros(len(classes), np.int64)
        past[k:] = classes[:-k]
        for j in range(k):
            short = begins[lengths > j] + j
            past[short] = 0
        back.append(past)
    return (back[0] * CLASSES + back[1]) * COARSE + back[2] % COARSE


def features(history: np.ndarray) -> np.ndarray:
    """Hashed rows of the weight matrix for each history (histories x 4)."""
    third, pair = history % COARSE, history // COARSE
    first, second = pair // CLASSES, pair % CLASSES
    keys = np.stack([first, CLASSES + second, 2 * CLASSES + third, 3 * CLASSES + pair], axis=-1).astype(np.uint64)
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % FEATURES


def log_softmax(weights: np.ndarray, bias: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(class | history), histories x classes."""
    scores = weights[features(history)].sum(1) + bias
    scores -= scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def hashes(tokens: pa.Array) -> np.ndarray:
    import xxhash

    offsets, data = held(tokens)
    digest, data, ends = xxhash.xxh64_digest, data.tobytes(), offsets.tolist()
    return np.frombuffer(b"".join([digest(data[a:b], 42) for a, b in zip(ends, ends[1:])]), ">u8").astype(np.uint64)


def cells(classes: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The cell of each token, counted over all classes."""
    return (classes * CELLS + (hashed >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)).astype(np.int32)


def word_histories(hashed: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Hashes of the histories of each place, one array for each kind; before a text there are zeros."""
    begins, back = np.cumsum(lengths) - lengths, []
    for k in (1, 2, 3):
        past = np.zeros_like(hashed)
        past[k:] = hashed[:-k]
        for j in range(k):
            past[begins[lengths > j] + j] = 0
        back.append(past)
    one, two, three = back
    pair = scrambled(one + np.uint64(1)) ^ (two + np.uint64(2))
    return [scrambled(h + np.uint64(k)) for k, h in enumerate((one, pair, two ^ np.uint64(1 << 40), scrambled(pair) ^ three), 3)]


@dataclass
class Followers:
    """For each slot the cell that followed its history most often, how often, and how often any did; counts reach 255."""

    cell: np.ndarray
    check: np.ndarray
    n: np.ndarray
    total: np.ndarray

    def opened(self) -> Followers:
        """Puts what a slot has side by side, so that it is read at once."""
        self.packed = self.total | self.n.astype(np.uint64) << np.uint64(8) | self.check.astype(np.uint64) << np.uint64(16) | self.cell.astype(np.uint64) << np.uint64(24)
        return self

    def find(self, history: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cell or -1, weight number) for each history; with ``own``, the cell that is there, without its own count."""
        slot, check = slot_of(history, len(self.cell))
        got = self.packed[slot].view(np.int64)
        there, cell, counts = (got >> 16 & 255).astype(np.uint8) == check, (got >> 24).astype(np.int32), got & 65535
        if own is not None:
            # n is at least 1 where own is there, and total is at least n
            counts = counts - ((there & (cell == own)) << 8) - (counts > 0)
        known = there & (counts > 255)
        return np.where(known, cell, -1), np.where(known, STEP_OF[counts], 0)


#: The weight number of each count << 8 | total.
STEP_OF = np.array([min(max(n.bit_length() - 1, 0), COUNTS - 1) * SHARES + min(SHARES * n // max(total, 1), SHARES - 1) for n in range(256) for total in range(256)], np.int32)


def slot_of(history: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    return (history >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64), (history & np.uint64(255)).astype(np.uint8)


def lift(own: np.ndarray, found: np.ndarray, gain: np.ndarray, before: np.ndarray, shares: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """What features add to the natural logarithm of P(own), and with ``shares`` the probability of each feature's outcome.

    Features name an outcome each (``found``, -1: none; kinds x places), with its probability without features (``before``) and
    the feature's weight (``gain``). Outcomes that no feature names keep their probability but for the normaliser.
    """
    valid = found >= 0
    gain = np.where(valid, gain, 0)
    total, first = gain.copy(), valid.copy()
    for i in range(len(found)):
        for j in range(i):
            # features without an outcome have no gain, and are no first ones
            same = found[i] == found[j]
            total[i] += same * gain[j]
            total[j] += same * gain[i]
            first[i] &= ~same
    # exponentials cost most: only where they count
    changes = np.zeros_like(total)
    changes[first] = before[first] * np.expm1(total[first])
    norm, share = 1 + changes.sum(0), None
    if shares:
        share = np.zeros_like(total)
        share[valid] = before[valid] * np.exp(total[valid])
        share /= norm
    return np.where(found == own, gain, 0).sum(0) - np.log(norm), share


@dataclass
class Small:
    """The parts of the model that every task has: counts of frequent tokens, weights, cells and followers."""

    frequent: dict[bytes, int]
    answered: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    mass: np.ndarray
    followers: Followers
    gains: np.ndarray

    def opened(self) -> Small:
        """Fills what a task derives from the rest: log P(class | history of classes), and P(cell | class)."""
        if hasattr(self, "logs"):
            return self
        self.logs = np.concatenate([log_softmax(self.weights, self.bias, np.arange(at, at + 1024)) for at in range(0, HISTORIES, 1024)]).astype(np.float32)
        self.odds = np.exp(self.logs)
        self.shares = (self.mass / self.mass.sum(1, keepdims=True)).ravel()
        self.followers.opened()
        return self

    def place_scores(self, texts: list[str | None], fit: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
        """Tokens, their numbers by place, lengths, and log P(cell | history) by place; with ``fit`` gradient and curvature of the gains, by factor; the tokens' cells."""
        distinct, ids, lengths = tokens_of(texts)
        cls, hashed = classes_of(distinct, self.frequent), hashes(distinct)
        cell_of = cells(cls, hashed)
        cell = cell_of[ids]
        cls, kinds = cls[ids], word_histories(hashed[ids], lengths)
        history = histories(cls, lengths)
        scores = self.logs[history, cls].astype(np.float64) + np.log(self.shares[cell])
        steps = np.zeros((2, 1 + WEIGHTS, WEIGHTS)) if fit else None
        for at in range(0, len(ids), PLACES):
            part = slice(at, at + PLACES)
            own, past = cell[part], history[part]
            found, step = (np.stack(x) for x in zip(*(self.followers.find(k[part], own if fit else None) for k in kinds)))
            for factor in (0, 1):
                if factor == 0:
                    named, mine = np.where(found >= 0, found // CELLS, -1), own // CELLS
                else:
                    named, mine = np.where((found >= 0) & (found // CELLS == own // CELLS), found, -1), own
                some = np.flatnonzero((named >= 0).any(0))
                named, mine, kept = named[:, some], mine[some], step[:, some]
                before = self.odds[past[some], np.maximum(named, 0)] if factor == 0 else self.shares[np.maximum(named, 0)]
                gain = np.stack([self.gains[factor, k][kept[k]] for k in range(KINDS)])
                more, share = lift(mine, named, gain, before, fit)
                scores[at + some] += more
                if fit:
                    # where a feature has no outcome its share is 0, and so is all that it adds
                    for k in range(KINDS):
                        row = k * COUNTS * SHARES + kept[k]
                        steps[factor, 0] += np.bincount(row, (named[k] == mine) - share[k], WEIGHTS)
                        for j in range(k + 1):
                            both = np.bincount(row * WEIGHTS + j * COUNTS * SHARES + kept[j], ((named[k] == named[j]) - share[k]) * share[j], WEIGHTS * WEIGHTS).reshape(WEIGHTS, WEIGHTS)
                            steps[factor, 1:] += both if j == k else both + both.T
        return distinct, ids, lengths, scores, steps, cell_of


@dataclass
class MaxentLM:
    """``tokens`` (token binary, n long, cls int) stays distributed; the rest is small."""

    tokens: DataFrame
    total: int
    distinct: int
    small: Small
    losses: list[float]


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token binary, n long): how often each token occurs; the end of a text is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, 0):
            distinct, ids, _ = tokens_of(texts)
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(np.bincount(ids, minlength=len(distinct)))], ["token", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame) -> DataFrame:
    """The tokens of (token, n) with at least some number of occurrences, which ``ANSWERED`` of them have at most; no other is sent to the driver."""
    step = F.floor(8 * F.log2("n"))
    least, total = None, 0
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > ANSWERED:
            break
        least = r.step
    return counted.where(F.lit(False) if least is None else (F.length("token") > 0) & (step >= least))


def packed(at: np.ndarray, *values: np.ndarray) -> bytes:
    """Positions in a part and what is there, as bytes."""
    return np.concatenate([at, *values]).astype("<i8").tobytes() if len(at) else b""


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(width, -1)


class SlotCounts:
    """What followed each history in the tasks seen so far: for each slot the outcomes counted most often, and all counts."""

    def __init__(self, slots: int):
        self.total = np.zeros(slots, np.int64)
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray, total: np.ndarray, kept: int) -> None:
        """Keys are slot << 24 | check << 16 | cell; the ``kept`` most frequent of a slot stay, ties by key."""
        self.total += total
        keys, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        n = np.bincount(place, np.concatenate([self.n, n]), len(keys)).astype(np.int64)
        slot = keys >> 24
        order = np.lexsort((keys, -n, slot))
        ranked = slot[order]
        head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        rank = np.arange(len(ranked)) - np.repeat(head, np.diff(np.r_[head, len(ranked)]))
        stay = np.sort(order[rank < kept])
        self.keys, self.n = keys[stay], n[stay]


def statistics(docs: DataFrame, frequent: dict[bytes, int], slots: int, tokens: int) -> DataFrame:
    """(kind int, part int, data binary): counts of (history of classes, class), kind 0, and of followers, kind 1, in parts.

    ``docs`` (text, key). A task passes on one outcome for each slot, its most frequent. Texts are dealt to tasks by their key, to
    as many as their tokens ask for, and read in the order of their keys, and what tasks pass on is merged in the order of the
    tasks; so the result depends on the rows alone, whatever cores and splits there are.
    """

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, winner, n, total = np.zeros(HISTORIES * CLASSES, np.int32), np.zeros(slots, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        for _, texts in blocks(batches, 0, SEEN_CHARS):
            distinct, ids, lengths = tokens_of(texts)
            of, hashed = classes_of(distinct, frequent), hashes(distinct)
            cell, classes = cells(of, hashed)[ids], of[ids]
            keys, times = np.unique(histories(classes, lengths) * CLASSES + classes, return_counts=True)
            seen[keys] += times.astype(np.int32)
            every = []
            for history in word_histories(hashed[ids], lengths):
                slot, check = slot_of(history, slots)
                every.append(slot << 24 | check.astype(np.int64) << 16 | cell)
            keys, times = np.unique(np.concatenate(every), return_counts=True)
            # the most frequent outcome of each slot in this block, ties to the lowest; then the more frequent of the block's and the task's
            slot = keys >> 24
            heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            best = np.maximum.reduceat(times << 32 | np.arange(len(keys))[::-1], heads)
            slot, keys, times, sums = slot[heads], keys[len(keys) - 1 - (best & 0xFFFFFFFF)], best >> 32, np.add.reduceat(times, heads)
            times = (times + np.where(winner[slot] == keys, n[slot], 0)).astype(np.int32)
            more = times > n[slot]
            winner[slot[more]], n[slot[more]] = keys[more], times[more]
            total[slot] += sums.astype(np.int32)
        made = []
        for at in range(0, HISTORIES // PART):
            own = seen[at * PART * CLASSES : (at + 1) * PART * CLASSES]
            full = np.flatnonzero(own)
            made.append((0, at, packed(full, own[full])))
        for at, low in enumerate(range(0, slots, SLOT_PART)):
            full = np.flatnonzero(n[low : low + SLOT_PART])
            keys = winner[low + full]
            left, sums, rows = n[low + full], total[low + full], []
            # counts beyond 16 bits go on in further rows
            while len(full):
                rows.append(np.stack([full, keys & 0xFFFF, keys >> 16 & 255, np.minimum(left, 65535), np.minimum(sums, 65535)]))
                left, sums = left - rows[-1][3], sums - rows[-1][4]
                more = (left > 0) | (sums > 0)
                full, keys, left, sums = full[more], keys[more], left[more], sums[more]
            made.append((1, at, np.concatenate(rows, axis=1).astype("<u2").tobytes() if rows else b""))
        made = [m for m in made if m[2]]
        task = TaskContext.get().partitionId()
        for at in range(0, len(made), 64):
            kind, part, data = zip(*made[at : at + 64])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array([task] * len(kind), pa.int32()), pa.array(data, pa.binary())], ["kind", "part", "task", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, held = None, None, []

        def fold(kept: int) -> None:
            rows = np.concatenate(held, axis=1).astype(np.int64)
            held.clear()
            sums.add(*summed(rows[0] << 24 | rows[2] << 16 | rows[1], rows[3]), np.bincount(rows[0], rows[4], SLOT_PART).astype(np.int64), kept)

        def done() -> pa.RecordBatch:
            if at[0] == 0:
                full = np.flatnonzero(sums)
                data = packed(full, sums[full])
            else:
                if held:
                    fold(8)
                sums.add(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(SLOT_PART, np.int64), 1)
                slot = sums.keys >> 24
                data = packed(slot, sums.keys & 0xFFFF, sums.keys >> 16 & 255, sums.n, sums.total[slot])
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([data], pa.binary())], ["kind", "part", "data"])

        for batch in batches:
            for kind, part, data in zip(*(batch.column(c) for c in ("kind", "part", "data"))):
                if at != (key := (kind.as_py(), part.as_py())):
                    if at is not None:
                        yield done()
                    at, sums = key, np.zeros(PART * CLASSES, np.int64) if key[0] == 0 else SlotCounts(SLOT_PART)
                if at[0] == 0:
                    places, n = unpacked(data.as_py(), 2)
                    sums[places] += n
                else:
                    held.append(np.frombuffer(data.as_py(), "<u2").reshape(5, -1))
                    if len(held) == 64:
                        fold(8)
        if at is not None:
            yield done()

    dealt = docs.repartition(max(FEWEST_TASKS, -(-tokens // TASK_TOKENS)), "key").sortWithinPartitions("key").select("text")
    spread = dealt.mapInArrow(observe, "kind int, part int, task int, data binary").repartition("kind", "part").sortWithinPartitions("kind", "part", "task")
    return cut_lineage(spread.mapInArrow(merge, "kind int, part int, data binary"))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, n, len(keys)).astype(np.int64)


def follower_table(seen: DataFrame, slots: int) -> Followers:
    table = Followers(np.zeros(slots, np.uint16), np.zeros(slots, np.uint8), np.zeros(slots, np.uint8), np.zeros(slots, np.uint8))
    for row in seen.where("kind = 1").toLocalIterator():
        at, cell, check, n, total = unpacked(bytes(row.data), 5)
        at = at + row.part * SLOT_PART
        table.cell[at], table.check[at] = cell, check
        scale = np.maximum(total / 255, 1)
        table.n[at], table.total[at] = np.clip(np.round(n / scale), 1, 255), np.clip(np.round(total / scale), 1, 255)
    return table


def class_weights(seen: DataFrame, bias: np.ndarray, steps: int) -> tuple[np.ndarray, list[float]]:
    """The weights of P(class | history of classes), and the loss before each step."""
    table, spark = seen.where("kind = 0").select("part", "data"), seen.sparkSession

    def gathered(make) -> tuple[np.ndarray, float]:
        """Sum over the parts of the table of a (features x classes) array given by history."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros((FEATURES, CLASSES)), 0.0
            for batch in batches:
                for part, data in zip(batch.column("part"), batch.column("data")):
                    places, n = unpacked(data.as_py(), 2)
                    history, row = np.unique(places // CLASSES, return_inverse=True)
                    times = np.zeros((len(history), CLASSES))
                    times[row, places % CLASSES] = n
                    history += part.as_py() * PART
                    values, more = make(history, times)
                    np.add.at(total, features(history).ravel(), np.repeat(values, 4, axis=0))
                    loss += more
            rows = np.flatnonzero(total.any(1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array([total[r].astype(np.float32).tobytes() for r in rows], pa.binary()), pa.array(np.where(np.arange(len(rows)) == 0, loss, 0.0))], ["row", "sums", "loss"])

        got = table.mapInArrow(run, "row int, sums binary, loss double").toArrow()
        out = np.zeros((FEATURES, CLASSES))
        if got.num_rows:
            np.add.at(out, got.column("row").to_numpy(), np.frombuffer(b"".join(got.column("sums").to_pylist()), np.float32).reshape(-1, CLASSES))
        return out, float(np.sum(got.column("loss").to_numpy()))

    observed, _ = gathered(lambda history, times: (times, 0.0))
    weights, best, losses = np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES)), []
    for step in range(steps + 1):
        shared = spark.sparkContext.broadcast((weights.astype(np.float32), bias))

        def expect(history: np.ndarray, times: np.ndarray, shared=shared) -> tuple[np.ndarray, float]:
            logs = log_softmax(*shared.value, history)
            return np.exp(logs) * times.sum(1, keepdims=True), float((logs * times).sum())

        expected, likelihood = gathered(expect)
        shared.unpersist()
        losses.append(-likelihood)
        if losses[-1] <= min(losses):
            best = weights
        if step < steps:
            weights = weights + RATE * (observed - expected) / (np.maximum(observed, expected) + RIDGE)
    return best.astype(np.float32), losses


def fit_gains(docs: DataFrame, small: Small, count: int) -> np.ndarray:
    """The weights of word features by Newton steps; likelihood, gradient and curvature are summed over tasks.

    Every step of the fit reads all of ``docs`` (text, key), and steps go on until the last one promises next to nothing. It starts
    from weights that are fitted in the same way to about ``WEIGHT_DOCS`` of them by a hash of the key, so that few steps are left.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(small)

    def summed_steps(texts: DataFrame, gains: np.ndarray) -> tuple[np.ndarray, float, int] | None:
        """Gradient and curvature, log likelihood, and places: sums of a task, then of tasks in their order, a few of which reach the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total, likelihood, places = None, 0, 0.0, 0
            for _, texts in blocks(batches, 0, SEEN_CHARS):
                model = model or shared.value.opened()
                model.gains = gains
                scores, steps = model.place_scores(texts, fit=True)[3:5]
                total, likelihood, places = total + steps, likelihood + float(scores.sum()), places + len(scores)
            if model:
                yield told(TaskContext.get().partitionId(), total, likelihood, places)

        def told(task: int, total: np.ndarray, likelihood: float, places: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task]), pa.array([total.tobytes()], pa.binary()), pa.array([likelihood]), pa.array([places])], ["task", "steps", "likelihood", "places"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, total, likelihood, places = None, 0, 0.0, 0
            for batch in batches:
                for row in batch.to_pylist():
                    task = row["task"] if task is None else task
                    total, likelihood, places = total + np.frombuffer(row["steps"]), likelihood + row["likelihood"], places + row["places"]
            if task is not None:
                yield told(task, total, likelihood, places)

        kind = "task long, steps binary, likelihood double, places long"
        parts = texts.mapInArrow(run, kind).repartition(FEWEST_TASKS, "task").sortWithinPartitions("task").mapInArrow(merge, kind).toArrow().sort_by("task").to_pylist()
        if not parts:
            return None
        return sum(np.frombuffer(x["steps"]) for x in parts).reshape(2, 1 + WEIGHTS, WEIGHTS), sum(x["likelihood"] for x in parts), sum(x["places"] for x in parts)

    def fitted(texts: DataFrame, gains: np.ndarray) -> np.ndarray:
        best, held = -np.inf, gains
        for _ in range(WEIGHT_STEPS):
            if (got := summed_steps(texts, gains)) is None:
                return gains
            steps, likelihood, places = got
            value = likelihood - 0.1 * (gains**2).sum()
            if value < best:
                # the step was too long
                gains = (gains + held) / 2
                continue
            best, held, promised, moved = value, gains, 0.0, []
            for factor, own in enumerate(gains.reshape(2, WEIGHTS)):
                slope, curve = steps[factor, 0] - 0.2 * own, steps[factor, 1:] + 0.2 * np.eye(WEIGHTS)
                moved.append(np.clip(own + np.clip(np.linalg.solve(curve, slope), -FARTHEST, FARTHEST), -3, 15))
                step = moved[-1] - own
                promised += slope @ step - step @ curve @ step / 2
            gains = np.stack(moved).reshape(gains.shape)
            if promised < SETTLED * places:
                break
        return gains

    place, upto = F.pmod(F.xxhash64(F.lit("slice"), "key"), F.lit(1 << 31)), max(1, int(min(1.0, WEIGHT_DOCS / max(count, 1)) * (1 << 31)))
    first = cut_lineage(docs.where(place < upto).repartition(FEWEST_TASKS, "key").sortWithinPartitions("key").select("text"))
    gains = fitted(first, small.gains)
    if upto < 1 << 31:
        gains = fitted(docs.select("text"), gains)
    shared.unpersist()
    return gains


def train(docs: DataFrame, text_col: str = "text", steps: int = STEPS) -> MaxentLM:
    """Fit the model to all rows of ``docs``; a null text is empty. An empty table gives a uniform model.

    All counts and weights come from all rows. The model depends on the rows and not on how they are dealt, but for rounding in
    sums of gradients.
    """
    docs = docs.select(F.col(text_col).alias("text"), F.xxhash64(*docs.columns).alias("key"))
    counted = cut_lineage(count_tokens(docs.select("text"), "text"))
    top = counted.where(F.length("token") > 0).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    frequent = {bytes(r.token): i for i, r in enumerate(top, 1)}
    answered = {bytes(r.token): r.n for r in [*top, *most_frequent(counted).collect()]}
    ending = (F.lit(1 + FREQUENT) + F.crc32(F.substring("token", -2, 2)) % ENDINGS).cast("int")
    cls = F.when(F.length("token") == 0, 0)
    for token, i in frequent.items():
        cls = cls.when(F.col("token") == F.lit(token), i)
    tokens = counted.withColumn("cls", cls.otherwise(ending).cast("int"))
    cell = F.shiftrightunsigned(F.xxhash64("token"), 64 - CELLS.bit_length() + 1)
    mass, counts, distinct = np.full((CLASSES, CELLS), 0.5), np.zeros(CLASSES), 0
    for r in tokens.groupBy("cls", cell.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r.cls, r.cell] += r.n + 0.5 * r.v
        counts[r.cls] += r.n
        distinct += r.v
    answered[END] = int(counts[0])
    slots = power_of_two(PER_TOKEN * counts.sum(), FEWEST_SLOTS, MOST_SLOTS)
    seen = statistics(docs, frequent, slots, int(counts.sum()))
    bias = np.log((counts + 0.5) / (counts + 0.5).sum())
    weights, losses = class_weights(seen, bias, steps)
    small = Small(frequent, answered if counts.sum() else {}, weights, bias, mass, follower_table(seen, slots), np.ones((2, KINDS, COUNTS * SHARES)))
    small.gains = fit_gains(docs, small, int(counts[0]))
    return MaxentLM(tokens, int(counts.sum()), distinct, small, losses)


def score(docs: DataFrame, model: MaxentLM, keep: tuple[str | Column, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ``keep``, n_tokens, n_known, train_tokens long, base_score, score double.

    ``base_score`` is the unigram log10 probability with half a count added to each of the known tokens and one unknown;
    ``score`` is the model's. Null and empty texts have one token, the end; a long text is scored whole, by one task. Repeated
    and null ids are scored by row. Columns of ``keep`` may have any name; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    norm = np.log10(model.total + 0.5 * (model.distinct + 1))
    shared = spark.sparkContext.broadcast(model.small)
    taken = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("__text"))
    columns_out = [*taken.columns[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    # inside, kept columns have names that no other column has
    taken = taken.toDF(*(f"__{i}" for i in range(len(taken.columns))))
    own = taken.dtypes[:-1]
    schema = ", ".join(["token binary, block long, places array<int>, n_tokens long, class_score double, answered double, answers long", *(f"`{c}` {k}" for c, k in own)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, task, serial = None, TaskContext.get().partitionId(), 0
        for batch, texts in blocks(batches, len(own)):
            if small is None:
                small = shared.value.opened()
                known_tokens, known_counts = pa.array(list(small.answered), pa.large_binary()), np.array([*small.answered.values(), -1], np.int64)
            block, serial = task << 32 | serial, serial + 1
            distinct, ids, lengths, scores, _, cell = small.place_scores(texts)
            scores = scores / np.log(10) - np.log10(small.mass.ravel()[cell])[ids]
            n = known_counts[pc.index_in(distinct, known_tokens).fill_null(-1).to_numpy()]
            answered = np.where(n > 0, np.log10(np.maximum(n, 0) + 0.5), 0.0)[ids]
            starts = np.cumsum(lengths) - lengths
            class_score, logs, known = (np.add.reduceat(x, starts) for x in (scores, answered, (n > 0)[ids].astype(np.int64)))
            owner = np.repeat(np.arange(len(texts)), lengths)
            rest = (n <= 0)[ids]
            keys, times = np.unique(ids[rest] << 12 | owner[rest], return_counts=True)
            while (times > MOST_TIMES).any():
                over = times > MOST_TIMES
                keys, times = np.r_[keys, keys[over]], np.r_[np.minimum(times, MOST_TIMES), times[over] - MOST_TIMES]
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order]
            token_at, places = keys >> 12, ((keys & 4095) << 20 | times).astype(np.int32)
            sent = np.flatnonzero(n <= 0)
            offsets = np.r_[np.searchsorted(token_at, sent), len(keys)].astype(np.int32)
            k, m = len(sent), len(texts)
            columns = [
                distinct.take(pa.array(sent)).cast(pa.binary()), pa.array(np.full(k, block)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places)),
                pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()), *(pa.nulls(k, batch.schema.field(i).type) for i in range(len(own))),
            ]
            names = ["token", "block", "places", "n_tokens", "class_score", "answered", "answers", *(c for c, _ in own)]
            yield pa.RecordBatch.from_arrays(columns, names)
            # a document's own row travels with a key that no token has, and with its place
            keys_of_docs = [b" %d %d" % (block, i) for i in range(m)]
            columns = [
                pa.array(keys_of_docs, pa.binary()), pa.array(np.full(m, block)),
                pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32)), pa.array((np.arange(m) << 20).astype(np.int32))), pa.array(lengths), pa.array(class_score), pa.array(logs), pa.array(known), *batch.columns[: len(own)],
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block with sums for those of its documents that have tokens here, and the documents' own rows."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            own_row = batch.column("n_tokens").is_valid()
            mine = batch.filter(own_row)
            if mine.num_rows:
                empty = pa.nulls(mine.num_rows, pa.list_(pa.float64()))
                slots = pa.ListArray.from_arrays(pa.array(np.arange(mine.num_rows + 1, dtype=np.int32)), pa.array((mine.column("places").flatten().to_numpy() >> 20).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([mine.column("block"), slots, empty, empty, mine.column("n_tokens"), mine.column("class_score"), mine.column("answered"), mine.column("answers"), *(mine.column(c) for c, _ in own)], out_names)
            n = batch.column("n").fill_null(0).to_numpy().astype(float)
            real = ~own_row.to_numpy(zero_copy_only=False)
            logs, seen = np.where(real, np.log10(n + 0.5), 0.0), real & (n > 0)
            lists = batch.column("places")
            row = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten().to_numpy()
            block, times, slot = batch.column("block").to_numpy()[row], flat & MOST_TIMES, flat >> 20
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                into = sums.setdefault(int(block[part[0]]), np.zeros((2, BLOCK_DOCS)))
                into[0] += np.bincount(slot[part], times[part] * logs[row[part]], BLOCK_DOCS)
                into[1] += np.bincount(slot[part], times[part] * seen[row[part]], BLOCK_DOCS)
            if len(sums) > 1000:
                yield told(sums)
        if sums:
            yield told(sums)

    def told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        full = [np.flatnonzero(cells.any(0)) for cells in sums.values()]
        k = len(full)
        offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in full])].astype(np.int32))
        columns = [pa.array(list(sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(full).astype(np.int32)))]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c[i][f] for c, f in zip(sums.values(), full)]))) for i in range(2)]
        sums.clear()
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()), *(pa.nulls(k, t) for t in own_types)], out_names)

    def finish(block: pa.Table) -> pa.Table:
        """The documents of a block with their sums."""
        docs = block.filter(block.column("n_tokens").is_valid()).combine_chunks()
        parts = block.filter(block.column("n_tokens").is_null()).combine_chunks()
        sums = np.zeros((2, BLOCK_DOCS))
        if parts.num_rows:
            flat = [parts.column(c).combine_chunks().flatten().to_numpy() for c in ("slots", "logs", "known")]
            for i in range(2):
                sums[i] = np.bincount(flat[0], flat[i + 1], BLOCK_DOCS)
        at = docs.column("slots").combine_chunks().flatten().to_numpy()
        logs, length = sums[0][at] + docs.column("answered").to_numpy(), docs.column("n_tokens").to_numpy()
        known = sums[1][at].astype(np.int64) + docs.column("answers").to_numpy()
        made = [pa.array(length), pa.array(known), pa.array(np.full(len(at), total)), pa.array(logs - length * norm), pa.array(docs.column("class_score").to_numpy() + logs)]
        return pa.table([*(docs.column(c) for c, _ in own), *made], [*(c for c, _ in own), "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    own_types = [to_arrow_type(taken.schema[i].dataType) for i in range(len(own))]
    total = model.total
    out_names = ["block", "slots", "logs", "known", "n_tokens", "class_score", "answered", "answers", *(c for c, _ in own)]
    named = [f"`{c}` {k}" for c, k in own]
    out_schema = ", ".join(["block long, slots array<int>, logs array<double>, known array<double>, n_tokens long, class_score double, answered double, answers long", *named])
    last_schema = ", ".join([*named, "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    joined = taken.mapInArrow(send, schema).join(model.tokens.select("token", "n"), "token", "left")
    return joined.mapInArrow(gather, out_schema).groupBy("block").applyInArrow(finish, last_schema).toDF(*columns_out)
