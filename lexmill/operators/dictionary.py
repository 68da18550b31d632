"""Matching of texts with dictionaries: phrases, synonyms, intents, entities, rewriting rules.

All phrases are looked for at once: a task compiles them into an Aho-Corasick automaton and reads each text once. The phrases are
broadcast only if they take up to ``limit`` bytes, checked by a sum before. Larger dictionaries meet the texts in a join on the
first ``GRAM`` characters of each phrase, and whole phrases are verified on the text; both ways give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of phrases that are broadcast, characters of a join key, and the bytes that one phrase takes besides its own.
LIMIT, GRAM, BESIDES = 32 << 20, 6, 64
#: Endings that queries drop before they are compared with triggers, and endings that follow desires and questions.
ENDINGS = (
    r"(어떻게돼\?*|어떻게해\?*|언제야\?*|뭐야\?*|인가요\?*|할까요\?*|하나요\?*|하려면\?*|신청하려면\?*|받으려면\?*|되려면\?*|가려면\?*|"
    r"싶은데|싶어요|싶습니다|싶어|습니다|니다|세요|줘|주세요|요|\?|!)$"
)
#: Words of two signs or more that are no keywords of a query.
PARTICLES = ("으로", "부터", "까지", "에서", "처럼", "어떻게", "무엇", "언제", "어디", "누구", "하는", "되는")


def _automaton(phrases: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(phrase, len(phrase))
    if phrases:
        found.make_automaton()
    return found


def _longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From left to right the longest span that starts behind the one before."""
    kept, last = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= last:
            kept.append((start, end))
            last = end
    return kept


def occurrences(texts: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", select: str = "all", limit: int = LIMIT) -> DataFrame:
    """(id_col, phrase, start int, end int): where the ``phrase`` column of ``phrases`` occurs in each text, in characters from 0.

    ``select``: "all" occurrences, overlapping ones too; "first" of each phrase; "longest", from left to right without overlap.
    Null and empty texts and phrases match nothing, repeated phrases count once, each row of ``texts`` is searched by itself.
    """
    if select not in ("all", "first", "longest"):
        raise ValueError(f"select: {select}")
    known = phrases.select("phrase").where("phrase <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("phrase") + BESIDES), F.lit(0))).first()[0]
    rows = texts.select(F.col(id_col), F.col(text_col).alias("text")).where("text <> ''")
    return (_by_automaton if size <= limit else _by_join)(rows, known, id_col, select)


def _by_automaton(rows: DataFrame, known: DataFrame, id_col: str, select: str) -> DataFrame:
    words = rows.sparkSession.sparkContext.broadcast([r.phrase for r in known.collect()])
    kind = to_arrow_type(rows.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(words.value)
        for batch in batches:
            row, phrase, start, stop = [], [], [], []
            for i, text in enumerate(batch.column(1) if len(automaton) else ()):
                text = text.as_py()
                spans = ((end + 1 - length, end + 1) for end, length in automaton.iter(text))
                spans = spans if select == "first" else list(spans)
                if select == "first":
                    least: dict[str, tuple[int, int]] = {}
                    for a, b in spans:
                        name = text[a:b]
                        if name not in least or a < least[name][0]:
                            least[name] = (a, b)
                    spans = list(least.values())
                elif select == "longest":
                    spans = _longest(spans)
                row += [i] * len(spans)
                phrase += [text[a:b] for a, b in spans]
                start += [a for a, _ in spans]
                stop += [b for _, b in spans]
                if len(row) > 200_000:
                    yield made(batch, row, phrase, start, stop)
                    row, phrase, start, stop = [], [], [], []
            yield made(batch, row, phrase, start, stop)

    def made(batch, row, phrase, start, stop) -> pa.RecordBatch:
        ids = batch.column(0).take(pa.array(row, pa.int64())).cast(kind)
        return pa.RecordBatch.from_arrays([ids, pa.array(phrase, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], [id_col, "phrase", "start", "end"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, phrase string, start int, end int")


def _by_join(rows: DataFrame, known: DataFrame, id_col: str, select: str) -> DataFrame:
    """Every place of a text meets the phrases that begin with its next characters, and the text is asked again for the whole phrase."""
    keyed = known.withColumn("gram", F.substring("phrase", 1, GRAM))
    sizes = [r.n for r in keyed.select(F.length("gram").alias("n")).distinct().collect()]
    # equal rows are searched once and counted again
    distinct = rows.groupBy(id_col, "text").agg(F.count("*").alias("times")).withColumn("__key", F.xxhash64(id_col, "text"))
    grams = F.filter(F.array(*(F.substring("text", F.col("at"), F.lit(n)) for n in sizes)), lambda g: F.length(g) > 0)
    places = distinct.select("__key", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at")).select("__key", "at", F.explode(F.array_distinct(grams)).alias("gram"))
    met = places.join(keyed, "gram").select("__key", "at", "phrase")
    whole = met.join(distinct, "__key").where(F.substring("text", F.col("at"), F.length("phrase")) == F.col("phrase"))
    found = whole.select(id_col, "__key", "times", "phrase", (F.col("at") - 1).cast("int").alias("start"), (F.col("at") - 1 + F.length("phrase")).cast("int").alias("end"))
    if select == "first":
        found = found.groupBy(id_col, "__key", "times", "phrase").agg(F.min("start").alias("start"), F.min("end").alias("end"))
    elif select == "longest":
        def kept(table: pa.Table) -> pa.Table:
            spans = list(zip(table.column("start").to_pylist(), table.column("end").to_pylist()))
            at = {span: i for i, span in enumerate(spans)}
            return table.take(pa.array([at[s] for s in _longest(spans)], pa.int64()))

        found = found.groupBy("__key").applyInArrow(kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema))
    return found.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(id_col, "phrase", "start", "end")


def synonym_expansions(queries: DataFrame, synonyms: DataFrame, id_col: str = "query_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, at, way, value): expansions of the words of each query, ``synonyms`` (term, rank from 0, synonym) read both ways.

    A word of two characters or more gives the first two synonyms of its term (way 0), then the terms that it is a synonym of, by
    name, unless the query has that value already (way 1). ``at`` numbers a query's expansions from 0; none for a null text.
    """
    return synonym_lists(queries, synonyms, id_col, text_col, limit).select(id_col, F.posexplode("all").alias("at", "e")).select(id_col, "at", "e.way", "e.value")


def synonym_lists(queries: DataFrame, synonyms: DataFrame, id_col: str = "query_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, all array<struct<way, value>>): `synonym_expansions` of each query in order; queries without any may have no row.

    Up to ``limit`` bytes of synonyms are looked up where the text is, if no id names two texts, so that no word is exchanged;
    otherwise words meet them in joins.
    """
    plain = F.trim(F.regexp_replace(text_col, r"\s+", " "))
    size = synonyms.agg(F.coalesce(F.sum(F.octet_length("term") + F.octet_length("synonym") + BESIDES), F.lit(0))).first()[0]
    if size <= limit and queries.groupBy(id_col).count().where("count > 1").isEmpty():
        return _expansions_by_row(queries.select(id_col, plain.alias("text")).where("text <> ''"), synonyms, id_col)
    words = queries.select(id_col, F.posexplode(F.split(plain, " ")).alias("word_at", "word")).where(F.length("word") >= 2)
    forward = words.join(synonyms.where("rank < 2"), words["word"] == synonyms["term"]).select(id_col, "word_at", F.lit(0).alias("way"), "rank", F.col("term").alias("of"), F.col("synonym").alias("value"))
    terms = synonyms.select("term", "synonym").distinct()
    back = words.join(terms, words["word"] == terms["synonym"]).select(id_col, "word_at", F.lit(1).alias("way"), F.lit(0).alias("rank"), F.col("term").alias("of"), F.col("term").alias("value"))
    order = ("word_at", "way", "rank", "of")
    first = F.row_number().over(Window.partitionBy(id_col, "value").orderBy(*order))
    # one exchange by id serves the windows
    kept = forward.unionByName(back).repartition(id_col).withColumn("nth", first).where("way = 0 OR nth = 1")
    ordered = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return kept.groupBy(id_col).agg(ordered.alias("all")).select(id_col, F.transform("all", lambda x: F.struct(x["way"].alias("way"), x["value"].alias("value"))).alias("all"))


def _expansions_by_row(rows: DataFrame, synonyms: DataFrame, id_col: str) -> DataFrame:
    table = synonyms.select("term", "rank", "synonym").where("term IS NOT NULL AND synonym IS NOT NULL").collect()
    ahead: dict[str, list[str]] = {}
    for r in sorted((r for r in table if r["rank"] is not None and r["rank"] < 2), key=lambda r: r["rank"]):
        ahead.setdefault(r.term, []).append(r.synonym)
    behind: dict[str, list[str]] = {}
    for term, synonym in sorted({(r.term, r.synonym) for r in table}):
        behind.setdefault(synonym, []).append(term)
    told, kind = rows.sparkSession.sparkContext.broadcast((ahead, behind)), to_arrow_type(rows.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, behind = told.value
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                ends, way, value = [0], [], []
                for text in part.column(1):
                    seen = set()
                    for word in text.as_py().split(" "):
                        if len(word) >= 2:
                            first = ahead.get(word, ())
                            seen.update(first)
                            other = [t for t in behind.get(word, ()) if t not in seen]
                            seen.update(other)
                            value += [*first, *other]
                            way += [0] * len(first) + [1] * len(other)
                    ends.append(len(value))
                made = pa.StructArray.from_arrays([pa.array(way, pa.int32()), pa.array(value, pa.string())], ["way", "value"])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], [id_col, "all"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, all array<struct<way: int, value: string>>")


#: White space that is left out before texts and triggers are compared; an ending at the very end, of fewer signs than REACH but for question marks.
BLANKS, REACH, _ENDING = " \t\n\f\r", 12, re.compile(ENDINGS[:-1] + r"\Z")


def for_matching(text: Column) -> Column:
    """Text without white space and one polite ending, as triggers are compared. Composed characters are expected as input."""
    return F.regexp_replace(F.regexp_replace(text, f"[{BLANKS}]+", ""), ENDINGS[:-1] + r"\z", "")


def prepared(text: str) -> str:
    """As `for_matching` of `composed`, of one text."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    for sign in BLANKS:
        text = text.replace(sign, "")
    ending = _ENDING.search(text, max(0, len(text.rstrip("?")) - REACH))
    return text[: ending.start()] if ending else text


def composed(text: Column) -> Column:
    """Text in canonical composition (NFC); ASCII texts do not leave the engine."""

    @F.pandas_udf("string")
    def nfc(values):
        return values.str.normalize("NFC")

    return F.when(F.octet_length(text) == F.length(text), text).otherwise(nfc(text))


def _points_by_row(queries: DataFrame, triggers: DataFrame, patterns: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """(id_col, intent_id, points): each text is prepared and searched once, where it is, and sends what its intents have."""
    intents: dict[str, list[str]] = {}
    for r in triggers.where("intent_id IS NOT NULL AND trigger IS NOT NULL").select("intent_id", "trigger").collect():
        intents.setdefault(prepared(r.trigger), []).append(r.intent_id)
    intents.pop("", None)
    told, kind = queries.sparkSession.sparkContext.broadcast(intents), to_arrow_type(queries.schema[id_col].dataType)
    fits = F.array_compact(F.array(*(F.when(F.col(text_col).rlike(p), F.lit(i)) for i, p in patterns)).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intents = told.value
        automaton = _automaton(list(intents))
        for batch in batches:
            row, names, points = [], [], []
            for i, (text, matched) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = Counter()
                for name in matched:
                    found[name] += 2
                text = prepared(text)
                for phrase in {text[end + 1 - length : end + 1] for end, length in automaton.iter(text)} if len(automaton) else ():
                    for name in intents[phrase]:
                        found[name] += 4 if phrase == text else 2
                row += [i] * len(found)
                names += found
                points += found.values()
            ids = batch.column(0).take(pa.array(row, pa.int64())).cast(kind)
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(points, pa.int32())], [id_col, "intent_id", "points"])

    return queries.select(F.col(id_col), F.col(text_col).alias("text"), fits.alias("fits")).where("text <> ''").mapInArrow(run, f"`{id_col}` {queries.schema[id_col].dataType.simpleString()}, intent_id string, points int")


def _points_by_join(queries: DataFrame, triggers: DataFrame, patterns: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    ready = queries.select(id_col, F.col(text_col).alias("raw"), for_matching(composed(F.col(text_col))).alias("text"))
    told = triggers.select("intent_id", for_matching(composed(F.col("trigger"))).alias("phrase")).where("phrase <> ''")
    held = occurrences(ready, told, id_col, select="first", limit=-1)
    whole = ready.select(id_col, F.length("text").alias("chars"))
    points = held.join(whole, id_col).join(told, "phrase").select(id_col, "intent_id", F.when(F.col("end") - F.col("start") == F.col("chars"), 4).otherwise(2).alias("points"))
    if patterns:
        fits = F.array(*(F.when(F.col("raw").rlike(p), F.lit(i)) for i, p in patterns))
        points = points.unionByName(ready.select(id_col, F.explode(F.array_compact(fits)).alias("intent_id"), F.lit(2).alias("points")))
    return points


def match_intents(
    queries: DataFrame, triggers: DataFrame, patterns: list[tuple[str, str]] = (), id_col: str = "query_id", text_col: str = "text", most: int = 3, limit: int = LIMIT
) -> DataFrame:
    """(id_col, intent_id, score, place): the best ``most`` intents of each query, by score, then intent_id.

    ``triggers`` (intent_id, trigger): 2 points for each that the text holds, 4 if it is the whole text, both prepared by
    `for_matching`. ``patterns`` (intent_id, regular expression): 2 points each. Intents whose id starts with ``legacy_`` lose one
    point. If the best has 2 points or more, those with fewer go. Queries without a match have no row; repeated triggers of an intent count once each.
    """
    size = triggers.agg(F.coalesce(F.sum(F.octet_length("trigger") + F.octet_length("intent_id") + BESIDES), F.lit(0))).first()[0]
    points = (_points_by_row if size <= limit else _points_by_join)(queries, triggers, patterns, id_col, text_col)
    penalty = F.when(F.col("intent_id").startswith("legacy_"), 1).otherwise(0)
    scores = points.groupBy(id_col, "intent_id").agg(F.sum("points").alias("score")).withColumn("score", F.col("score") - penalty)
    best = F.max("score").over(Window.partitionBy(id_col))
    ranked = scores.withColumn("best", best).where("best < 2 OR score >= 2")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "intent_id"))
    return ranked.withColumn("place", place).where(F.col("place") <= most).select(id_col, "intent_id", "score", "place")


def recognise_entities(texts: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, limit: int = LIMIT) -> DataFrame:
    """(id_col, kind, keyword, start, end, confidence, expansions): the first place of each keyword of ``dictionary`` in each text.

    ``dictionary`` (kind, keyword, confidence double, expansions array<string>); entries under ``least`` are not looked for. A
    keyword under two kinds gives both, and keywords inside others count too.
    """
    asked = dictionary.where(F.col("confidence") >= least)
    found = occurrences(texts, asked.select(F.col("keyword").alias("phrase")), id_col, text_col, "first", limit)
    return found.join(asked, F.col("phrase") == F.col("keyword")).select(id_col, "kind", "keyword", "start", "end", "confidence", "expansions")


def expand_by_rules(queries: DataFrame, rules: DataFrame, id_col: str = "query_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, intent, keywords, confidence, method): the first rule one of whose patterns the lower-cased query holds.

    ``rules`` (rule int, intent, patterns array<string>, keywords array<string>). Queries without one get the intent "unknown",
    their first five words (letters, digits) of two characters or more that are no particles as keywords, or themselves if they
    have none, and 0.5 in place of 0.7. One row per query.
    """
    lower = queries.select(id_col, F.coalesce(text_col, F.lit("")).alias("raw"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    patterns = rules.select("rule", F.explode("patterns").alias("phrase"))
    met = occurrences(lower, patterns, id_col, select="first", limit=limit).join(patterns, "phrase").groupBy(id_col).agg(F.min("rule").alias("rule"))
    words = F.slice(F.filter(F.regexp_extract_all("raw", F.lit("[가-힣A-Za-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*PARTICLES)), 1, 5)
    words = F.when(F.size(words) > 0, words).otherwise(F.array("raw"))
    told = lower.select(id_col, words.alias("own")).join(met, id_col, "left").join(rules.select("rule", "intent", "keywords"), "rule", "left")
    known = F.col("rule").isNotNull()
    return told.select(
        id_col, F.when(known, F.col("intent")).otherwise("unknown").alias("intent"), F.when(known, F.col("keywords")).otherwise(F.col("own")).alias("keywords"),
        F.when(known, 0.7).otherwise(0.5).alias("confidence"), F.when(known, "pattern").otherwise("basic").alias("method"),
    )


def rewrite_by_dictionary(texts: DataFrame, rules: DataFrame, id_col: str = "query_id", text_col: str = "text", formal: tuple[str, ...] = (), limit: int = LIMIT) -> DataFrame:
    """(id_col, rewritten, matched array<string>): ``rules`` (rule int, pattern, formal) applied in order, each to what the earlier ones made.

    Every occurrence of a pattern is replaced; ``matched`` names the patterns that applied. Texts that hold one of the ``formal``
    words (in lower case) stay as they are. Texts are trimmed; null becomes empty. The automaton is asked again only after a
    replacement, so a text costs one pass and one more for each rule that applies. Rules over ``limit`` bytes raise: an ordered
    rewriting needs them all where the text is.
    """
    size = rules.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("formal") + BESIDES), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"rules take {size} bytes of {limit}")
    ordered = rules.where("pattern <> ''").groupBy("pattern").agg(F.min("rule").alias("rule"), F.min_by("formal", "rule").alias("formal")).collect()
    told = texts.sparkSession.sparkContext.broadcast({r.pattern: (r.rule, r.formal) for r in ordered})
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pattern = told.value
        automaton = _automaton(list(by_pattern))
        for batch in batches:
            out, used = [], []
            for text in batch.column(1).to_pylist():
                text, names, done = (text or "").strip(), [], None
                while len(automaton) and not any(w in text.lower() for w in formal):
                    hits = {text[e + 1 - n : e + 1] for e, n in automaton.iter(text)}
                    left = sorted((by_pattern[h][0], h) for h in hits if done is None or (by_pattern[h][0], h) > done)
                    if not left:
                        break
                    done = left[0]
                    text = text.replace(done[1], by_pattern[done[1]][1])
                    names.append(done[1])
                out.append(text)
                used.append(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(used, pa.list_(pa.string()))], [id_col, "rewritten", "matched"])

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, rewritten string, matched array<string>")
