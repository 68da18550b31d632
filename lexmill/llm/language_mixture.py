"""Language identification by multilingual mixture inference.

Every labelled language has a distribution over hashed character 1-, 2- and 3-grams, counted over all training texts. A
document is explained as a mixture of languages: expectation-maximisation estimates each language's proportion from the
n-gram likelihoods, and the set of languages is grown from the best single one while the likelihood gains more than a
penalty. All documents of a block are inferred side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of an n-gram distribution: a model has that many numbers for each language.
BUCKETS = 1 << 16
#: Added to each cell's count; steps of expectation-maximisation; characters in a block of documents.
SMOOTHING, STEPS, BLOCK_CHARS = 0.05, 12, 400_000
UNDETERMINED = "und"


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of all distinct n-gram buckets, ordered by document; and whether each has a letter.

    Texts are lower-cased; every run of other characters than letters counts as one space, a space before and after each
    text too. N-grams of spaces alone are left out.
    """
    joined = "\x00".join([(t or "").lower() for t in texts]) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    distinct, inverse = np.unique(codes, return_inverse=True) if len(codes) < 1000 else _distinct(codes)
    kinds = np.array([2 if c == 0 else chr(c).isalpha() for c in distinct.tolist()], np.int8)[inverse]
    # a text that itself holds the separator would shift all later ones
    if int((kinds == 2).sum()) != len(texts):
        return grams([(t or "").replace("\x00", " ") for t in texts])
    ends = np.flatnonzero(kinds == 2)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.r_[-1, ends]))
    letter = kinds == 1
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter | np.r_[True, letter[:-1] | (kinds[:-1] == 2) & (kinds[1:] != 2)]
    keep |= kinds == 2
    signs = np.where(letter, codes, 0).astype(np.uint64)[keep]
    owner = owner[keep]
    found = []
    for n in (1, 2, 3):
        if len(signs) < n:
            continue
        size = len(signs) - n + 1
        value, some = np.full(size, n, np.uint64), np.zeros(size, bool)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + signs[k : k + size]
            some |= signs[k : k + size] > 0
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        some &= owner[:size] == owner[n - 1 :]
        key = (owner[:size].astype(np.uint64) << np.uint64(32)) | (value >> np.uint64(48))
        found.append(key[some])
    keys = np.sort(np.concatenate(found)) if found else np.array([], np.uint64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], np.int64)
    counts = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts, lettered


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    present = np.bincount(codes)
    distinct = np.flatnonzero(present)
    place = np.zeros(len(present), np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[codes]


def blocks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts with about ``BLOCK_CHARS`` characters together, and where each starts."""
    start, held, size = 0, [], 0
    for at, text in enumerate(column):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= BLOCK_CHARS:
            yield start, held
            start, held, size = at + 1, [], 0
    if held:
        yield start, held


class MixtureModel:
    """Languages and the log-probabilities of their n-gram buckets."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.probs = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T) if languages else np.zeros((BUCKETS, 0))

    def infer(self, texts: list[str | None], penalty: float = 3.0) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of the largest proportion, that proportion, and all proportions (documents x languages)."""
        doc, bucket, count, lettered = grams(texts)
        n, k = len(texts), len(self.languages)
        if not k or not len(doc):
            return [UNDETERMINED] * n, np.zeros(n), np.zeros((n, k))
        probs = self.probs[bucket]
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows = doc[heads]
        place = np.repeat(np.arange(len(rows)), np.diff(np.r_[heads, len(doc)]))
        total = np.add.reduceat(count, heads)
        weight = count.astype(float)

        def fit(chosen: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions and log-likelihoods of the documents ``who`` with the languages ``chosen``."""
            inside = np.zeros(len(rows), bool)
            inside[who] = True
            mine = inside[place]
            p, w = probs[mine], weight[mine]
            local = np.cumsum(inside) - 1
            at = local[place[mine]]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            share = chosen / chosen.sum(1, keepdims=True)
            for _ in range(STEPS):
                joint = p * share[at]
                mix = joint.sum(1)
                share = np.add.reduceat(joint * (w / mix)[:, None], starts) / total[who][:, None]
            mix = (p * share[at]).sum(1)
            return share, np.add.reduceat(w * np.log(mix), starts)

        single = np.add.reduceat(weight[:, None] * np.log(probs), heads)
        best = single.argmax(1)
        chosen = np.zeros((len(rows), k))
        chosen[np.arange(len(rows)), best] = 1
        share, gained = chosen.copy(), single.max(1)
        growing = np.arange(len(rows))
        everything, _ = fit(np.ones((len(rows), k)), growing)
        for _ in range(k - 1):
            options = np.where(chosen[growing] > 0, -1.0, everything[growing])
            trial = chosen[growing].copy()
            trial[np.arange(len(growing)), options.argmax(1)] = 1
            tried, likelihood = fit(trial, growing)
            better = likelihood - gained[growing] > penalty * np.log(total[growing] + 1)
            growing, trial, tried, likelihood = growing[better], trial[better], tried[better], likelihood[better]
            chosen[growing], share[growing], gained[growing] = trial, tried, likelihood
            if not len(growing):
                break
        all_shares = np.zeros((n, k))
        all_shares[rows] = share
        names = [self.languages[i] if has else UNDETERMINED for i, has in zip(all_shares.argmax(1), lettered)]
        return names, np.where(lettered, np.clip(all_shares.max(1), 0, 1), 0.0), np.where(lettered[:, None], all_shares, 0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> MixtureModel:
    """Count the n-grams of all rows with a text and a language. The model's size depends on the number of languages only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, texts in blocks(batch.column(0)):
                doc, bucket, times, _ = grams(texts)
                own = langs[start : start + len(texts)]
                for lang in sorted(set(own)):
                    mine = np.array([x == lang for x in own])[doc]
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS)
                    sums[lang] += np.bincount(bucket[mine], times[mine], BUCKETS)
        for lang, cells in sums.items():
            full = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(cells[full].astype(np.int64))], ["lang", "bucket", "times"]
            )

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = known.mapInArrow(count, "lang string, bucket int, times long").groupBy("lang", "bucket").agg(F.sum("times").alias("times"))
    got = summed.toArrow()
    languages = sorted(got.column("lang").unique().to_pylist())
    counts = np.zeros((len(languages), BUCKETS))
    at = {lang: i for i, lang in enumerate(languages)}
    counts[[at[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("times").to_numpy()
    return MixtureModel(languages, counts)


def identify(docs: DataFrame, model: MixtureModel, keep: tuple[str | Column, ...] = ("doc_id",), text_col: str = "text", inside: str | None = None) -> DataFrame:
    """The columns of ``keep`` and lang_pred string, score double, shares map<string,double>, for each row of ``docs``.

    ``score`` is the proportion of the predicted language. Null texts and texts without a letter give ``und`` and 0, as
    does every text if the model has seen no language; equal proportions go to the language that sorts first. The text can
    also be a field of a struct ``inside`` that is kept, and then travels once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    taken = docs.select(*keep, *([] if inside else [F.col(text_col).alias("__text")]))
    own = taken.dtypes[: None if inside else -1]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in own), "lang_pred string, score double, shares map<string,double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start, texts in blocks(batch.column(inside).field(text_col) if inside else batch.column(batch.num_columns - 1)):
                names, score, shares = model.infer(texts)
                maps = [[(model.languages[i], float(row[i])) for i in np.flatnonzero(row > 0)] for row in shares]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(own)], pa.array(names, pa.string()), pa.array(score), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                    [*batch.schema.names[: len(own)], "lang_pred", "score", "shares"],
                )

    return taken.mapInArrow(run, schema)
