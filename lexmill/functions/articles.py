"""Column expressions over the text of articles: headings, paragraphs, amendments, keywords, dates, labels, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings above an article, by level.
HEADS = {"chapter": "장", "section": "절", "subsection": "관"}
#: Amendment notes with their kind, in the order in which they are looked for.
AMENDMENTS = (
    (r"\(개정\s*(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*\)", "개정"),
    (r"\(신설\s*(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*\)", "신설"),
    (r"\(삭제\s*(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*\)", "삭제"),
    (r"\[본조신설\s*(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*\]", "신설"),
)
#: Groups of keywords and their weights.
KEYWORDS = (
    ("이사|감사|위원|위원장|의장", 1.0),
    ("교원|교수|교직원|직원|강사", 0.9),
    ("학생|학과|학부|대학|대학원", 0.9),
    ("규정|규칙|학칙|정관|세칙", 0.8),
    ("심의|의결|승인|결정|허가", 0.8),
    ("임명|선임|해임|임기|보선", 0.7),
    ("장학금|등록금|수업료|입학금", 0.7),
    ("전형|입학|졸업|휴학|복학|제적", 0.8),
    ("시행일|시행|폐지|개정|신설", 0.6),
    ("예산|결산|회계|자산|재산", 0.7),
    ("연구|교육|강의|수업|학점", 0.8),
)
#: The signs of paragraphs, and references to articles and their parts.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
REFERENCE = r"제\s*\d+\s*조(?:의\s*\d+)?(?:제\s*\d+\s*[항호목])*|제\s*\d+\s*[항호목]"
#: Dates from which a text is in force, in the order in which they are looked for.
IN_FORCE = (r"(\d{4})\s*[년\.]\s*(\d{1,2})\s*[월\.]\s*(\d{1,2})\s*일?\s*부터\s*시행", r"(\d{4})\s*[년\.]\s*(\d{1,2})\s*[월\.]\s*(\d{1,2})\s*\.?\s*[부로부터]*\s*시행")
#: Fixed value: a title and its code at the end of a line of contents.
CONTENTS = r"^(.*)\s+(\d+[-—–]\d+[-—–]\d+)(?:\s*[~～]\s*\d+)?$"


def head(text: Column) -> Column:
    """struct<type, display_no, title> of a heading of a chapter, section or subsection; null for any other text."""
    text, made = F.trim(text), None
    for kind, sign in HEADS.items():
        pattern = rf"^제\s*(\d+)\s*{sign}\s+(.+)$"
        told = F.struct(F.lit(kind).alias("type"), F.concat(F.lit("제"), F.regexp_extract(text, pattern, 1), F.lit(sign)).alias("display_no"), F.trim(F.regexp_extract(text, pattern, 2)).alias("title"))
        made = F.when(text.rlike(pattern), told) if made is None else made.when(text.rlike(pattern), told)
    return made


def iso_date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def amendments(text: Column) -> Column:
    """array<struct<date, order, type>> without repeats, by date, equal dates by the order of the notes' patterns.

    Notes do not overlap, so one pass finds those of all patterns; a note's pattern is told by its first signs.
    """
    signs = [pattern[1 : pattern.index(r"\s")] for pattern, _ in AMENDMENTS]

    def told(note: Column) -> Column:
        order, kind = F.lit(len(signs) - 1), F.lit(AMENDMENTS[-1][1])
        for at in reversed(range(len(signs) - 1)):
            begins = note.startswith(signs[at].replace("\\", ""))
            order, kind = F.when(begins, at).otherwise(order), F.when(begins, AMENDMENTS[at][1]).otherwise(kind)
        numbers = F.regexp_extract_all(note, F.lit(r"\d+"), F.lit(0))
        return F.struct(iso_date(*(F.get(numbers, F.lit(k)) for k in range(3))).alias("date"), order.alias("order"), kind.alias("type"))

    notes = F.regexp_extract_all(text, F.lit("|".join(f"(?:{pattern})" for pattern, _ in AMENDMENTS)), F.lit(0))
    same = lambda a, b: (a["date"] == b["date"]) & (a["type"] == b["type"])
    # the array is named by a lambda, or it would be made again for each of its elements
    once = lambda every: F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: same(x, y)))
    return F.get(F.transform(F.array(F.sort_array(F.transform(notes, told))), once), F.lit(0))


def keywords(text: Column) -> Column:
    """array<struct<term, weight>>: each keyword once with its largest weight, by weight descending, then term.

    Keywords are Korean syllables throughout, so their groups are looked for in the runs of such syllables alone.
    """
    runs = F.array_join(F.regexp_extract_all(text, F.lit("[가-힣]+"), F.lit(0)), " ")

    def found(runs: Column, words: str, weight: float) -> Column:
        return F.transform(F.regexp_extract_all(runs, F.lit(f"(?:{words})"), F.lit(0)), lambda t: F.struct(F.lit(-weight).alias("order"), t.alias("term")))

    every = F.get(F.transform(F.array(runs), lambda r: F.concat(*(found(r, *group) for group in KEYWORDS))), F.lit(0))
    return F.transform(F.sort_array(F.array_distinct(every)), lambda k: F.struct(k["term"].alias("term"), (-k["order"]).alias("weight")))


def effective_date(text: Column) -> Column:
    """The first date from which a text says it is in force, as YYYY-MM-DD; null without one."""
    found = [F.when(text.rlike(p), iso_date(*(F.regexp_extract(text, p, k) for k in (1, 2, 3)))) for p in IN_FORCE]
    return F.coalesce(*found)


def path_label(display_no: Column, title: Column, text: Column) -> Column:
    """Number and title; without a title the text up to its first topic particle within 30 characters, or 25 characters of its first sentence."""
    topic = F.trim(F.regexp_extract(text, r"^(.{1,30}?)(?:은|는|이란|란|의)\s", 1))
    told = F.coalesce(F.nullif(title, F.lit("")), F.nullif(topic, F.lit("")), F.nullif(F.trim(F.regexp_extract(text, r"^([^.。\n]{1,25})", 1)), F.lit("")))
    return F.concat_ws(" ", F.nullif(display_no, F.lit("")), told)


def paragraphs(text: Column) -> tuple[Column, Column]:
    """The text before the first circled numeral, and array<struct<mark, content>> of what follows each.

    The numerals are one range of signs, which is a single comparison, as a list of them is not.
    """
    signs = f"{CIRCLED[0]}-{CIRCLED[-1]}"
    parts = F.regexp_extract_all(text, F.lit(f"[{signs}][^{signs}]*"), F.lit(0))
    parts = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).alias("mark"), F.trim(F.substring(p, 2, 1 << 30)).alias("content")))
    return F.trim(F.regexp_extract(text, f"^([^{signs}]*)", 1)), parts


def references(text: Column) -> Column:
    """References to articles, paragraphs and items, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), F.trim)


def contents_line(line: Column) -> Column:
    """struct<title, code> of a line of contents, the code with plain hyphens; null for any other line."""
    line = F.trim(F.btrim(F.trim(line), F.lit("|")))
    code = F.regexp_replace(F.regexp_extract(line, CONTENTS, 2), "[—–]", "-")
    return F.when(line.rlike(CONTENTS), F.struct(F.trim(F.regexp_extract(line, CONTENTS, 1)).alias("title"), code.alias("code")))


def index_kind(title: Column, preamble: Column) -> Column:
    title, preamble = F.trim(F.coalesce(title, F.lit(""))), F.coalesce(preamble, F.lit(""))
    index = F.when(preamble.contains("가나다순"), "index_alpha").when(preamble.contains("소관부서별"), "index_dept").otherwise("index")
    return F.when(title.isin("차례", "목차"), "toc").when(title == "찾아보기", index)


def document_type(title: Column, preamble: Column, code: Column, has_content: Column) -> tuple[Column, Column]:
    """Code, taken from the title where it is missing, and type: contents, index, regulation, note or unknown."""
    named = F.regexp_replace(F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), r"(\d+[-–—]\d+[-–—]\d+)", 1), F.lit("")), "[—–]", "-")
    kind = index_kind(title, preamble)
    known = F.when(kind.isNull(), F.coalesce(F.nullif(code, F.lit("")), named)).otherwise(code)
    return known, F.coalesce(kind, F.when(known.isNotNull(), "regulation").when(has_content, "note").otherwise("unknown"))


def list_pattern(text: Column) -> tuple[list[Column], Column]:
    """Lines that begin as "1.", "가.", a circled numeral and "1)", and the pattern they make together."""
    counts = [F.regexp_count(text, F.lit(p)) for p in (r"(?m)^\s*\d+\.", r"(?m)^\s*[가-힣]\.", rf"(?m)^\s*[{CIRCLED}]", r"(?m)^\s*\d+\)")]
    several = sum((c > 0).cast("int") for c in counts[:3])
    kind = F.when(several > 1, "mixed").when(counts[0] > 0, "numeric").when(counts[1] > 0, "korean").when(counts[2] > 0, "circled").when(counts[3] > 0, "bracket").otherwise("none")
    return counts, kind


def chunk_id(code: Column, kind: Column, display_no: Column, title: Column) -> Column:
    """The id of a chunk that has none: 16 hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws(":", code, kind, display_no, title).cast("binary")), 1, 16)
