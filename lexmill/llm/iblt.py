"""Document fingerprints as invertible Bloom lookup sketches, with Spark functions only.

A text is cut into paragraphs, and each distinct paragraph into a digest. A sketch has three parts of ``width`` cells; a
digest falls into one cell of each part, and a cell holds how many digests fell into it, their exclusive or, and that of
their checks. Subtracting the sketches of two versions cancels what they share. Peeling recovers the rest: a cell with a
single digest gives it away, which is then taken out of its other cells, and so on.

The fingerprint of a text is its sketch of ``PRINTED`` cells a part, and the first comparison subtracts two fingerprints.
Where cells are left over, the versions are compared again with larger sketches, until all have been peeled. The number of
recovered digests gives the likeness: shared paragraphs over all paragraphs of both, repeated ones counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut_lineage

#: A paragraph is a line; one of more characters than LONG is cut after every word whose hash is 0 modulo EVERY.
LONG, EVERY = 400, 32
#: Cells in a part of a fingerprint; rounds of peeling fingerprints and larger sketches; sketches in a row that may fail, each at
#: least twice as large as the last.
PRINTED, FIRST_ROUNDS, ROUNDS, ATTEMPTS = 8, 6, 12, 24
#: Documents in a run of neighbouring ids, the largest number of runs, and ids of the sample for each bound.
RUN, RUNS, SAMPLE = 500, 65536, 8
#: Digests in a task while peeling.
DIGESTS = 250_000


def digests(text: Column) -> Column:
    """Digests of the distinct paragraphs of a text, in no order that means anything; empty lines are none."""
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")

    def cut(line: Column) -> Column:
        def pieces(words: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (F.pmod(F.xxhash64(F.element_at(words, i)), F.lit(EVERY)) == 0) | (i == F.size(words)))
            spans = F.arrays_zip(ends.alias("end"), F.concat(F.array(F.lit(0)), ends).alias("start"))
            # the last row has a start and no end
            return F.transform(F.filter(spans, lambda s: s["end"].isNotNull()), lambda s: F.xxhash64(F.slice(words, s["start"] + 1, s["end"] - s["start"])))

        # the outer transform only names the array of words, so that it is made once
        return F.element_at(F.transform(F.array(F.split(line, " ")), pieces), 1)

    return F.array_distinct(F.flatten(F.transform(lines, lambda line: F.when(F.length(line) <= LONG, F.array(F.xxhash64(line))).otherwise(cut(line)))))


def place(digest: Column, part: int, width: Column) -> Column:
    """The cell of a digest in a part of ``width`` cells, counted over all parts."""
    return F.lit(part) * width + F.pmod(F.xxhash64(digest, F.lit(part)), width)


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def small_sketch(found: Column, width: int = PRINTED) -> Column:
    """All cells of a sketch as array<struct<n, key, chk>>, cell by cell."""
    size = F.lit(width).cast("long")
    told = F.transform(found, lambda d: F.struct(d.alias("d"), check(d).alias("c"), *(place(d, part, size).alias(f"p{part}") for part in range(3))))

    def xor(rows: Column, name: str) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a.bitwiseXOR(r[name]))

    def cell(rows: Column) -> Column:
        return F.struct(F.size(rows).cast("long").alias("n"), xor(rows, "d").alias("key"), xor(rows, "c").alias("chk"))

    # the outer transforms only name the array of places and the rows of a cell, so that each is made once
    def rows_of(all: Column) -> Column:
        return F.array(*(in_cell(all, at) for at in range(3 * width)))

    def in_cell(all: Column, at: int) -> Column:
        return F.filter(all, lambda r: r[f"p{at // width}"] == at)

    return F.element_at(F.transform(F.array(told), lambda all: F.transform(rows_of(all), cell)), 1)


def printed(sketch: Column) -> Column:
    """A sketch as hexadecimal digits: for each cell eight of the count, 16 of the key and eight of the check."""
    low = lambda value: F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    one = lambda c: F.concat(low(c["n"]), F.lpad(F.hex(c["key"]), 16, "0"), low(c["chk"]))
    return F.lower(F.concat_ws("", F.transform(sketch, one)))


def differences(pairs: DataFrame, tasks: int, rounds: int = ROUNDS) -> DataFrame:
    """(pair long, found long, left_over long) from pairs (pair long, width long, ours, theirs array<long>).

    ``found`` digests were recovered from the difference of the two sketches; ``left_over`` cells could not be peeled. Pairs
    without any difference have no row.
    """
    signed = F.concat(
        F.transform("ours", lambda d: F.struct(d.alias("d"), F.lit(1).cast("long").alias("n"))),
        F.transform("theirs", lambda d: F.struct(d.alias("d"), F.lit(-1).cast("long").alias("n"))),
    )
    spread = pairs.repartition(tasks, "pair").select("pair", "width", F.explode(signed).alias("s"))
    cells = spread.select(
        "pair", "width", F.explode(F.array(*(place(F.col("s.d"), part, F.col("width")) for part in range(3)))).alias("cell"),
        F.col("s.n").alias("n"), F.col("s.d").alias("key"), check(F.col("s.d")).alias("chk"),
    )
    cells = summed(cells)
    for turn in range(rounds):
        cells = summed(peeled(cells, turn % 3))
    return cells.groupBy("pair").agg(
        F.coalesce(F.sum(F.when(F.col("cell") < 0, F.col("n"))), F.lit(0)).alias("found"), F.count(F.when(F.col("cell") >= 0, 1)).alias("left_over")
    )


def summed(cells: DataFrame) -> DataFrame:
    """Cells that are not empty, one row each. Cell -1 counts the digests found so far."""
    return cells.groupBy("pair", "width", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")).where("n <> 0 OR key <> 0 OR chk <> 0")


def peeled(cells: DataFrame, part: int) -> DataFrame:
    """Takes the digests that are alone in a cell of ``part`` out of all their cells; each has one cell there."""
    key, n = F.col("key"), F.col("n")
    alone = (F.floor(F.col("cell") / F.col("width")) == part) & (F.abs(n) == 1) & (F.col("chk") == check(key))
    row = lambda cell, n, key, chk: F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), key.alias("key"), chk.alias("chk"))
    zero = F.lit(0).cast("long")
    found = F.array(
        row(F.lit(-1), F.lit(1), zero, zero),
        *(row(place(key, other, F.col("width")), -n, key, F.col("chk")) for other in range(3) if other != part),
    )
    same = F.array(row(F.col("cell"), n, key, F.col("chk")))
    return cells.select("pair", "width", F.inline(F.when(alone, found).otherwise(same)))


def compare(pairs: DataFrame) -> DataFrame:
    """(pair, differing long): differing digests of each pair (pair long, ours, theirs array<long>); none: no row.

    The first sketches are the fingerprints. The second have room for all digests of a pair, each later one for twice as many.
    """
    size = (F.size("ours") + F.size("theirs")).cast("long")
    waiting, results = pairs.withColumn("width", F.lit(PRINTED).cast("long")), []
    whole = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("digests")).first()
    left = whole.n
    for attempt in range(ATTEMPTS):
        if not left:
            break
        tasks = max(1, -(-whole.digests * left // (whole.n * DIGESTS)))
        told = cut_lineage(differences(waiting.select("pair", "width", "ours", "theirs"), tasks, ROUNDS if attempt else FIRST_ROUNDS))
        results.append(told.where("left_over = 0").select("pair", F.col("found").alias("differing")))
        failed = told.where("left_over > 0").select("pair")
        left = failed.count()
        room = (F.ceil(size * 0.8) + 8).cast("long")
        waiting = pairs.join(failed, "pair", "left_semi").withColumn("width", F.greatest(room, F.lit(2 * PRINTED)) * 2**attempt)
    else:
        raise RuntimeError(f"{ATTEMPTS} sketches in a row could not be peeled")
    if not results:
        return pairs.select("pair", F.lit(0).cast("long").alias("differing"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def runs(rows: DataFrame) -> Column:
    """The run of each row (doc_id, ...): neighbouring ids have the same or the next; null ids are in the lowest.

    Bounds come from a sample of the ids by their hash. There is a run for every ``RUN`` rows, at most ``RUNS``: beyond 33
    million rows a run has more, which a task sorts, with spilling, and reads one after the other.
    """
    n = rows.count()
    count = min(RUNS, n // RUN + 1)
    share = min(1.0, SAMPLE * count / max(n, 1))
    picked = rows.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) <= int(share * 1_000_000)))
    sample = sorted({r[0] for r in picked.select("doc_id").distinct().collect()})
    bounds = sorted({sample[i * len(sample) // count] for i in range(1, count)}) if sample else []
    if not bounds:
        return F.lit(0)
    inner = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + inner] for i in range(0, len(bounds), inner)]
    above = lambda array: F.size(F.filter(array, lambda b: b < F.col("doc_id")))
    outer = F.greatest(above(F.lit([g[0] for g in groups])), F.lit(1))
    fine = above(F.element_at(F.array(*(F.lit(g) for g in groups)), outer))
    return F.when(F.col("doc_id").isNull(), 0).otherwise((outer * (inner + 1) + fine).cast("int"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, place, doc_id, text, own, next_text, follow): each row with the text that follows in descending order of the id.

    ``own`` and ``follow`` are the digests of both texts.

    After the last row comes the first. Null texts are empty; null ids come last; rows with equal ids are ordered by text. The
    texts are shuffled once, into runs of neighbouring ids, and each run gets a copy of the first row of the run that follows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("run", runs(rows)).withColumn("own", digests(F.col("text")))
    # the greatest id of each run, RUNS rows at most, and the run above it: there its text is the last
    tops = rows.groupBy("run").agg(F.max("doc_id").alias("top"))
    up = Window.orderBy("run")
    tops = cut_lineage(tops.select(F.col("run").alias("r"), "top", F.coalesce(F.lead("run").over(up), F.first("run").over(up)).alias("target")))
    heads = rows.drop("own").join(F.broadcast(tops), (F.col("run") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("target").agg(F.max("text").alias("text"))
    guests = heads.select(F.col("target").alias("run"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text", digests(F.col("text")).alias("own"), F.lit(1).alias("guest"))
    order = Window.partitionBy("run").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    told = both.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).withColumn("follow", F.lead("own").over(order))
    return told.where("guest = 0").select("run", "place", "doc_id", "text", "own", "next_text", "follow")


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars long, edited string digest, fingerprints and likenesses.

    The edited text replaces the last floor(n_chars / 2) characters by the first as many of the next document in descending
    order of the id, which may be of any type that can be ordered. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Two texts without paragraphs are alike (1); such a text is unlike any other
    (0). A single row is its own next document. Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) AS int))"), F.expr("left(next_text, cast(floor(length(text) / 2) AS int))"))
    told = with_next(docs, id_col, text_col).select(
        F.shiftleft(F.col("run").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"),
        edited.alias("edited"), "own", "follow",
    )
    base = cut_lineage(told.select("row", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("changed"), "follow"))
    against = F.array(F.struct(F.lit(0).alias("kind"), F.col("changed").alias("theirs")), F.struct(F.lit(1).alias("kind"), F.col("follow").alias("theirs")))
    pairs = base.select("row", F.col("own").alias("ours"), F.inline(against)).select((F.col("row") * 2 + F.col("kind")).alias("pair"), "ours", "theirs")
    found = compare(pairs)
    by_row = found.groupBy(F.shiftright("pair", 1).alias("row")).agg(
        F.max(F.when(F.col("pair") % 2 == 0, F.col("differing"))).alias("d0"), F.max(F.when(F.col("pair") % 2 == 1, F.col("differing"))).alias("d1")
    )
    # likeness = shared / all = ((a + b - d) / 2) / ((a + b + d) / 2)
    sized = base.select("row", "doc_id", "n_chars", "edited_sha256", "own", "changed", F.size("own").alias("a"), F.size("changed").alias("b"), F.size("follow").alias("c"))

    def likeness(other: str, d: str) -> Column:
        size, differing = F.col("a") + F.col(other), F.coalesce(F.col(d), F.lit(0))
        return F.when(size == 0, 1.0).otherwise((size - differing) / (size + differing)).cast("double")

    joined = sized.join(by_row, "row", "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", printed(small_sketch(F.col("own"))).alias("fingerprint"), printed(small_sketch(F.col("changed"))).alias("edited_fingerprint"),
        likeness("b", "d0").alias("near_edited"), likeness("c", "d1").alias("near_next"),
    )
