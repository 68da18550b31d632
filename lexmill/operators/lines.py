"""Structure of texts read line by line: broken lines joined, regulations, headings, articles and their parts, list trees.

What a line means depends on the lines before it. The dependence is put as a machine of few states, as values carried forward and as
stacks, which `scan` runs over chunks of lines, so that a text with most of all lines is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import scan

#: The forms of lines.
PART, SECTION, SUBSECTION = r"^(제\s*\d+\s*편)\s*(.*)", r"^(제\s*\d+\s*절)\s*(.*)", r"^(제\s*\d+\s*관)\s*(.*)"
CHAPTER_WITH_HEADER, CHAPTER = r"^(제\s*\d+\s*[장편])\s*([^제]*?)(?:제\s*\d+\s*편|$)", r"^(제\s*\d+\s*[장편])\s*(.*)"
CONTENTS, INDEX = r"^(차\s*례|목\s*차)\s*$", r"^찾아보기"
ARTICLE, FIRST_ARTICLE = r"^(제\s*(\d+)\s*조(?:의\s*(\d+))?)\s*(?:\(([^)]+)\))?\s*(.*)", r"^(제\s*1\s*조)(?!\s*의)"
APPENDIX = r"^부\s*칙|^(?:\[\s*별\s*[표지].*?\]|<\s*별\s*[표지].*?>)"
PARAGRAPH, ITEM, SUBITEM = r"^([①-⑮])\s*(.*)", r"^(\d+\.)\s*(.*)", r"^([가-하]\.)\s*(.*)"
ADDENDUM, NUMBERED = r"^(제\s*\d+\s*조(?:의\s*\d+)?)\s*(?:\(([^)]+)\))?\s*(.*)", r"^(\d+\.)\s*(?:\(([^)]+)\))?\s*(.*)"
#: Ends of lines that can be titles, and lines that no broken line is joined with.
TITLE_ENDS = ("규정", "세칙", "지침", "요령", "강령", "내규", "학칙", "헌장", "기준", "수칙", "준칙", "요강", "운영", "정관")
HEADER, LIST_ITEM = r"^제\s*\d+\s*조|^부\s*칙|^제\s*\d+\s*[장절편]", r"^(\d+\.|[가-하]\.|\(\d+\)|\d+\))"
#: Marks of lists in the order in which they are tried.
MARKS = (("numeric", r"^(\d+)\.\s*(.*)$"), ("korean", r"^([가-하])[\.\)]\s*(.*)$"), ("circled", r"^([①-⑮])\s*(.*)$"), ("bracket", r"^(\d+)\)\s*(.*)$"))

# symbols: other line, end of a regulation, article, article with a paragraph, the same for article 1, appendix, paragraph, item
_OTHER, _END, _ARTICLE, _ARTICLE_P, _FIRST, _FIRST_P, _APPENDIX, _PARAGRAPH, _ITEM = range(9)
# states: preamble; appendices without and after articles; in an article; in its paragraph; in its item
_PREAMBLE, _BARE_APPENDIX, _LATE_APPENDIX, _IN_ARTICLE, _IN_PARAGRAPH, _IN_ITEM = range(6)
_MACHINE = [
    [0, 0, 3, 4, 3, 4, 1, 0, 0],
    [1, 0, 3, 4, 3, 4, 1, 1, 1],
    [2, 0, 3, 4, 3, 4, 2, 2, 2],
    [3, 0, 3, 4, 3, 4, 2, 4, 5],
    [4, 0, 3, 4, 3, 4, 2, 4, 5],
    [5, 0, 3, 4, 3, 4, 2, 4, 5],
]


def lines_of(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, at from 0, line): the lines of each text, trimmed; a null text has none. Ids name texts: texts with one id would mix."""
    return texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def joined_lines(lines: DataFrame, id_col: str = "doc_id", chunk: int = scan.CHUNK) -> DataFrame:
    """(id_col, n from 1, first_at, line): lines broken inside a sentence joined by spaces.

    A line is joined to those before it until one ends with ``.``, ``?`` or ``!``. Blank lines, headings and list items stand by
    themselves, and so does a table row that begins a run of lines.
    """
    line = F.col("line")
    alone = (line == "") | line.rlike(HEADER) | line.rlike(LIST_ITEM)
    ends = line.rlike(r"[.?!]$")
    # symbols: alone, ends a sentence, table row, other; states: nothing waits, a line waits
    symbol = F.when(alone, 0).when(ends, 1).when(line.startswith("|"), 2).otherwise(3)
    narrow = lines.select(id_col, "at", symbol.alias("symbol"))
    known = scan.states(narrow, [id_col], "at", F.col("symbol"), [[0, 0, 0, 1], [0, 0, 1, 1]], 0, chunk)
    starts = (F.col("state") == 0) | (F.col("symbol") == 0)
    numbered = scan.counted(known.select(id_col, "at", starts.alias("starts")), [id_col], "at", {"n": F.col("starts")}, chunk)
    rows = numbered.join(lines.select(id_col, "at", "line"), [id_col, "at"]).groupBy(id_col, "n").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("parts"))
    return rows.select(id_col, "n", F.col("parts")[0]["at"].alias("first_at"), F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("line"))


def parsed_lines(lines: DataFrame, id_col: str = "doc_id", chunk: int = scan.CHUNK) -> DataFrame:
    """Every line that is not blank, with its kind, where it stands and what it belongs to.

    Columns: id_col, at, line, kind (part, chapter, section, subsection, contents, index, article, appendix, paragraph, item,
    subitem, text), place (heading, preamble, article, appendix), regulation (numbered from 0 by the ends before the line),
    part, chapter, section, subsection, article, paragraph, item (the names of the nodes that the line belongs to, or null).

    A part, a table of contents or an index begins another regulation, and so does an article 1 after other articles. If such an
    article 1 follows appendices, the last line of them that can be a title goes to the new regulation with those behind it.
    """
    line, bare = F.col("line"), F.trim(F.replace(F.col("line"), F.lit("|"), F.lit("")))
    kind = (
        F.when(bare.rlike(PART), "part").when(line.rlike(CHAPTER), "chapter").when(line.rlike(SECTION), "section").when(line.rlike(SUBSECTION), "subsection").when(line.rlike(CONTENTS), "contents")
        .when(line.rlike(INDEX) & (F.length(line) < 20), "index").when(line.rlike(ARTICLE), "article").when(line.rlike(APPENDIX), "appendix").when(line.rlike(PARAGRAPH), "paragraph")
        .when(line.rlike(ITEM), "item").when(line.rlike(SUBITEM), "subitem").otherwise("text")
    )
    rows = lines.where("line <> ''").select(id_col, F.col("at").cast("long").alias("at"), "line", kind.alias("kind"))
    is_ = lambda *names: F.col("kind").isin(*names)
    with_p = F.regexp_extract("line", ARTICLE, 5).rlike("^[①-⑮]")
    first = F.col("line").rlike(FIRST_ARTICLE)
    article = F.when(first & with_p, _FIRST_P).when(first, _FIRST).when(with_p, _ARTICLE_P).otherwise(_ARTICLE)
    symbol = F.when(is_("part", "contents", "index"), _END).when(is_("article"), article).when(is_("appendix"), _APPENDIX).when(is_("paragraph"), _PARAGRAPH).when(is_("item"), _ITEM).otherwise(_OTHER)
    chapter = F.when(line.rlike(CHAPTER_WITH_HEADER), F.concat_ws(" ", F.trim(F.regexp_extract(line, CHAPTER_WITH_HEADER, 1)), F.nullif(F.trim(F.regexp_extract(line, CHAPTER_WITH_HEADER, 2)), F.lit(""))))
    chapter = F.coalesce(chapter, F.concat_ws(" ", F.trim(F.regexp_extract(line, CHAPTER, 1)), F.nullif(F.trim(F.regexp_extract(line, CHAPTER, 2)), F.lit(""))))
    part = F.trim(F.concat_ws(" ", F.trim(F.regexp_extract(bare, PART, 1)), F.trim(F.regexp_extract(bare, PART, 2))))
    named = line.rlike(f"({'|'.join(TITLE_ENDS)})$") | (line.contains("규정") & ~line.contains("시행한다") & ~line.rlike(r"^\d+\.") & ~line.startswith("부"))
    # texts of lines stay behind: only what headings say goes through the scans
    says = F.when(is_("part"), part).when(is_("chapter"), chapter).when(is_("section", "subsection"), line)
    rows = rows.select(id_col, "at", "kind", symbol.alias("symbol"), says.alias("says"), (named & (F.length(line) < 100)).alias("title"))
    known = scan.states(rows, [id_col], "at", F.col("symbol"), _MACHINE, _PREAMBLE, chunk)
    splits = F.col("symbol").isin(_FIRST, _FIRST_P) & (F.col("state") >= _LATE_APPENDIX)
    known = known.withColumn("ends", (F.col("symbol") == _END) | splits)
    known = scan.counted(known, [id_col], "at", {"regulation": F.col("ends")}, chunk)

    headings = is_("part", "chapter", "section", "subsection")
    in_article = F.col("state") >= _IN_ARTICLE
    place = F.when(headings, "heading").when(is_("contents", "index"), "preamble").when(is_("article"), "article").when(is_("appendix") | F.col("state").isin(_BARE_APPENDIX, _LATE_APPENDIX), "appendix").when(in_article, "article").otherwise("preamble")
    known = known.withColumn("place", place)
    known = _titles_to_the_next(known, id_col)

    out = F.col("ends") | is_("appendix")
    node = lambda k: F.col("at") * 4 + k
    begins_p = F.col("symbol").isin(_ARTICLE_P, _FIRST_P)
    own_p, implied = is_("paragraph") & in_article, is_("item") & (F.col("state") == _IN_ARTICLE)
    fields = {
        "part": (is_("part"), F.col("says")),
        "chapter": (out | is_("chapter"), F.when(is_("chapter"), F.col("says"))),
        "section": (out | is_("chapter", "section"), F.when(is_("section"), F.col("says"))),
        "subsection": (out | is_("chapter", "section", "subsection"), F.when(is_("subsection"), F.col("says"))),
        "article": (out | is_("article"), F.when(is_("article"), node(0))),
        "paragraph": (out | is_("article") | own_p | implied, F.when(begins_p | own_p | implied, node(1))),
        "item": (out | is_("article") | own_p | (is_("item") & in_article), F.when(is_("item"), node(2))),
    }
    told = scan.carried(known, [id_col], "at", fields, chunk).join(lines.select(id_col, F.col("at").cast("long").alias("at"), "line"), [id_col, "at"])
    inside = F.col("place") == "article"
    return told.select(id_col, "at", "line", "kind", "place", "regulation", "part", "chapter", "section", "subsection", *(F.when(inside, F.col(n)).alias(n) for n in ("article", "paragraph", "item")))


def _titles_to_the_next(known: DataFrame, id_col: str) -> DataFrame:
    """Appendix lines from the last that can be a title on, where an article 1 comes next, go to the next regulation's preamble."""
    appended = F.col("place") == "appendix"
    found = known.groupBy(F.col(id_col).alias("__id"), F.col("regulation").alias("__of")).agg(F.max(F.when(appended & F.col("title"), F.col("at"))).alias("__title"))
    late = known.where(F.col("ends") & F.col("symbol").isin(_FIRST, _FIRST_P) & (F.col("state") == _LATE_APPENDIX)).select(F.col(id_col).alias("__id"), (F.col("regulation") - 1).alias("__of"))
    moved = found.where("__title IS NOT NULL").join(late, ["__id", "__of"])
    rows = known.join(moved, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("regulation") == F.col("__of")), "left")
    goes = appended & (F.col("at") >= F.col("__title"))
    return rows.select(
        *(c for c in known.columns if c not in ("regulation", "place")), F.when(goes, F.col("regulation") + 1).otherwise(F.col("regulation")).alias("regulation"),
        F.when(goes, "preamble").otherwise(F.col("place")).alias("place"),
    )


def article_nodes(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, regulation, node, parent, kind, display_no, title, text): articles, paragraphs, items and subitems of `parsed_lines`.

    A node's name grows with its place in the text. A line that begins no node goes to the last paragraph of its article, behind
    a space, or a line break if it is a table row; without a paragraph to the article. Items without a paragraph hang on the article.
    """
    line, is_ = F.col("line"), lambda name: F.col("kind") == name
    inside = parsed.where("article IS NOT NULL")
    content = F.ltrim(F.regexp_extract(line, ARTICLE, 5))
    begins = is_("article") & content.rlike(PARAGRAPH)
    sub = is_("subitem") & F.col("item").isNotNull()
    loose = ~F.col("kind").isin("article", "paragraph", "item") & ~sub
    name = lambda k: F.col("at") * 4 + k

    def node(n, kind: str, display: Column, title: Column, text: Column, parent, when: Column, keep: Column = F.lit(True)) -> Column:
        return F.when(when, F.struct(n.alias("node"), F.lit(kind).alias("kind"), display.alias("display_no"), title.alias("title"), text.alias("text"), parent.cast("long").alias("parent"), keep.alias("opens")))

    none, empty = F.lit(None).cast("string"), F.lit("")
    group = lambda p, i: F.regexp_extract(line, p, i)
    to_paragraph = loose & F.col("paragraph").isNotNull()
    made = F.array_compact(F.array(
        node(name(0), "article", group(ARTICLE, 1), F.regexp_extract(line, ARTICLE, 4), F.when(begins, none).otherwise(F.nullif(content, empty)), F.lit(None), is_("article")),
        node(name(1), "paragraph", F.regexp_extract(content, PARAGRAPH, 1), none, F.regexp_extract(content, PARAGRAPH, 2), F.col("article"), begins),
        node(name(1), "paragraph", group(PARAGRAPH, 1), none, group(PARAGRAPH, 2), F.col("article"), is_("paragraph")),
        node(name(1), "paragraph", empty, none, empty, F.col("article"), is_("item") & (F.col("paragraph") == name(1))),
        node(name(2), "item", group(ITEM, 1), none, group(ITEM, 2), F.col("paragraph"), is_("item")),
        node(name(3), "subitem", group(SUBITEM, 1), none, group(SUBITEM, 2), F.col("item"), sub),
        node(F.col("paragraph"), "paragraph", none, none, F.concat(F.when(line.startswith("|"), "\n").otherwise(" "), line), F.col("article"), to_paragraph, F.lit(False)),
        node(F.col("article"), "article", none, none, line, F.lit(None), loose & F.col("paragraph").isNull(), F.lit(False)),
    ))
    pieces = inside.select(id_col, "regulation", "at", F.inline(made))
    grouped = pieces.groupBy(id_col, "node").agg(
        F.min("regulation").alias("regulation"), F.first("kind").alias("kind"), F.max(F.when(F.col("opens"), F.col("display_no"))).alias("display_no"), F.max(F.when(F.col("opens"), F.col("title"))).alias("title"),
        F.max("parent").alias("parent"), F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "opens", "text")))).alias("parts"),
    )
    texts = F.transform("parts", lambda p: p["text"])
    text = F.when(F.col("kind") == "article", F.array_join(texts, "\n")).when(F.col("kind") == "paragraph", F.trim(F.array_join(texts, ""))).otherwise(F.array_join(texts, ""))
    nodes = grouped.select(id_col, "regulation", "node", "parent", "kind", F.coalesce("display_no", empty).alias("display_no"), F.coalesce("title", empty).alias("title"), text.alias("text"))
    hollow = nodes.where("kind = 'paragraph' AND display_no = '' AND text = ''").select(F.col(id_col).alias("__id"), F.col("node").alias("__node"), F.col("parent").alias("__parent"))
    kept = nodes.where("NOT (kind = 'paragraph' AND display_no = '' AND text = '')").join(hollow, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("parent") == F.col("__node")), "left")
    return kept.select(id_col, "regulation", "node", F.coalesce("__parent", "parent").alias("parent"), "kind", "display_no", "title", "text")


def addenda_nodes(lines: DataFrame, id_col: str = "doc_id", chunk: int = scan.CHUNK) -> DataFrame:
    """(id_col, node, parent, kind, display_no, title, text): the lines of addenda as items, paragraphs and loose texts.

    A line that begins as an article or with a number opens an item. A paragraph hangs on the item before it, and is an item of its
    own where none is open. Other lines go on with the text of the open node, behind a space, or a line break if they are a table
    row; without an open node they make one. A node's name is the place of its line.
    """
    line = F.col("line")
    kind = F.when(line.rlike(ADDENDUM), "article").when(line.rlike(NUMBERED), "number").when(line.rlike(PARAGRAPH), "paragraph").otherwise("text")
    rows = lines.where("line <> ''").select(id_col, F.col("at").cast("long").alias("at"), kind.alias("kind"))
    symbol = F.when(F.col("kind") == "paragraph", 1).otherwise(0)
    known = scan.states(rows.withColumn("symbol", symbol), [id_col], "at", F.col("symbol"), [[1, 0], [1, 1]], 0, chunk)
    opens = F.col("kind").isin("article", "number") | ((F.col("kind") == "text") & (F.col("state") == 0))
    told = scan.carried(known, [id_col], "at", {"open": (opens, F.col("at"))}, chunk).join(lines.select(id_col, F.col("at").cast("long").alias("at"), "line"), [id_col, "at"])
    none, at, is_ = F.lit(None).cast("string"), F.col("at"), lambda name: F.col("kind") == name
    group = lambda pattern, i: F.regexp_extract(line, pattern, i)
    hangs = is_("paragraph") & F.col("open").isNotNull()
    goes_on = is_("text") & (F.col("open") != at)
    pick = lambda article, number, paragraph, other: F.when(is_("article"), article).when(is_("number"), number).when(is_("paragraph"), paragraph).otherwise(other)
    own = pick(group(ADDENDUM, 3), group(NUMBERED, 3), group(PARAGRAPH, 2), line)
    pieces = told.select(
        id_col, "at", F.when(goes_on, F.col("open")).otherwise(at).alias("node"), F.when(hangs, F.col("open")).alias("parent"), (~goes_on).alias("own"),
        F.when(hangs, "paragraph").when(is_("text"), "text").otherwise("addendum_item").alias("type"), pick(group(ADDENDUM, 1), group(NUMBERED, 1), group(PARAGRAPH, 1), F.lit("")).alias("display_no"),
        pick(group(ADDENDUM, 2), group(NUMBERED, 2), none, none).alias("title"), F.when(goes_on, F.concat(F.when(line.startswith("|"), "\n").otherwise(" "), line)).otherwise(own).alias("text"),
    )
    first = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    rest = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("own"), F.struct("at", "text")))), lambda p: p["text"]), "")
    nodes = pieces.groupBy(id_col, "node").agg(first("parent"), first("type"), first("display_no"), first("title"), first("text"), rest.alias("rest"))
    text = F.when(F.col("text") == "", F.substring("rest", 2, 1 << 30)).otherwise(F.concat("text", "rest"))
    return nodes.select(id_col, "node", "parent", F.col("type").alias("kind"), "display_no", F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))


def heading_edges(parsed: DataFrame, id_col: str = "doc_id", chunk: int = scan.CHUNK) -> DataFrame:
    """(id_col, regulation, node, kind, name, parent): chapters, sections, subsections and articles as a tree, by its edges.

    A heading is a node where an article has another one than the article before it in its regulation; its name is that of the
    article with a letter. Articles before a first chapter of number 2 or more belong to a chapter 1 without a line of its own.
    """
    articles = parsed.where("kind = 'article' AND place = 'article'").select(id_col, "regulation", "at", "chapter", "section", "subsection", F.col("article").alias("node"), F.col("line").alias("name"))
    firsts = articles.where("chapter IS NOT NULL").groupBy(F.col(id_col).alias("__id"), F.col("regulation").alias("__of")).agg(F.min_by("chapter", "at").alias("__chapter"), F.min("at").alias("__from"))
    late = F.try_element_at(F.regexp_extract_all("__chapter", F.lit(r"제\s*(\d+)\s*장"), F.lit(1)), F.lit(1)).cast("long") >= 2
    rows = articles.join(firsts, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("regulation") == F.col("__of")), "left")
    rows = rows.withColumn("chapter", F.when((F.col("at") < F.col("__from")) & late, "제1장 총칙").otherwise(F.col("chapter"))).drop("__id", "__of", "__chapter", "__from")
    levels = ("chapter", "section", "subsection")
    every = F.lit(True)
    old = scan.carried(rows, [id_col], "at", {f"old_{n}": (every, F.col(n)) for n in (*levels, "regulation")}, chunk, after=False)
    # null at the first article of a text, as for the first of a regulation
    fresh = ~F.col("regulation").eqNullSafe(F.col("old_regulation"))
    changed, flags = fresh, {}
    for n in levels:
        changed = changed | ~F.col(n).eqNullSafe(F.col(f"old_{n}"))
        flags[n] = changed
    marked = old.withColumns({f"new_{n}": flag for n, flag in flags.items()})
    nodes = {f"{n}_node": (F.col(f"new_{n}"), F.when(F.col(n).isNotNull(), F.concat(F.lit(n[:3]), F.col("node").cast("string")))) for n in levels}
    told = scan.carried(marked, [id_col], "at", nodes, chunk)
    chapter, section, subsection = (F.col(f"{n}_node") for n in levels)
    parents = {"chapter": F.lit(None).cast("string"), "section": chapter, "subsection": F.coalesce(section, chapter)}
    edge = lambda node, kind, name, parent: F.struct(node.alias("node"), F.lit(kind).alias("kind"), name.alias("name"), parent.alias("parent"))
    made = [F.when(F.col(f"new_{n}") & F.col(n).isNotNull(), edge(F.col(f"{n}_node"), n, F.col(n), parents[n])) for n in levels]
    made.append(edge(F.concat(F.lit("art"), F.col("node").cast("string")), "article", F.col("name"), F.coalesce(subsection, section, chapter)))
    return told.select(id_col, "regulation", F.inline(F.array_compact(F.array(*made))))


def list_items(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = scan.CHUNK) -> DataFrame:
    """(id_col, at, pattern, marker, content, level, parent_at, depth): list items of each text as a tree by their indents.

    A line whose first sign is a mark is an item; two blanks of indent are one level. An item's parent is the last item before it
    with a smaller level. Trees of any depth; a null text has none.
    """
    rows = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "raw"))
    line = F.regexp_replace("raw", r"^\s+", "")
    found = None
    for name, pattern in MARKS:
        item = F.struct(F.lit(name).alias("pattern"), F.regexp_extract(line, pattern, 1).alias("marker"), F.regexp_extract(line, pattern, 2).alias("content"))
        found = F.when(line.rlike(pattern), item) if found is None else found.when(line.rlike(pattern), item)
    level = F.floor(F.length(F.regexp_extract("raw", r"^(\s*)", 1)) / 2)
    items = rows.select(id_col, F.col("at").cast("long").alias("at"), found.alias("m"), level.alias("level")).where("m IS NOT NULL").select(id_col, "at", "m.pattern", "m.marker", "m.content", "level")
    return scan.parents(items, [id_col], "at", "level", chunk)
