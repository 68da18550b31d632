"""Main text of web pages by differencing against the page with the nearest URL.

Pages are ordered by host and URL path, so that a page's neighbour on the same host is the one with the longest common
path. The lines of both are aligned by longest common subsequence, and lines that both share are template: they go.

Differencing alone cannot give the article: a menu drawn afresh for each page differs, and a passage that two articles
share is no template. So the markup speaks first where it is plain. Lines in elements that never hold an article (menus,
headers, footers, sidebars, notices, adverts, forms, comments) go; lines inside the article element stay, shared or not; the
alignment decides over every other line.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut_lineage

#: Pages in a run of neighbouring URLs, the largest number of runs, and keys of the sample for each bound.
RUN, RUNS, SAMPLE = 200, 65536, 8
#: Elements whose content is no text at all; elements that never hold the article; elements that start a new line.
SILENT = frozenset("script style noscript template iframe object svg math head title canvas audio video".split())
ASIDE = frozenset("nav header footer aside form button select textarea dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Words in a class, id or role that name something else than the article.
NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary contentinfo search".split()
)
HEADINGS = frozenset(("header", "masthead", "banner"))
#: Names of elements whose articles, if any, are never the page's own.
OTHERS = re.compile(r"comment|disqus|repl(?:y|ies)|respond|related|newsletter|cookie|consent|promo|sponsor", re.I)
#: Elements that a head can hold; any other ends it.
IN_HEAD = frozenset("title meta link script style base noscript template head".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: What the markup says of a line.
OPEN, KEEP, DROP = 0, 1, 2
#: Until the end of the page is read: lines of an article in an element that is dropped for its class or id alone.
DOUBTFUL = 3


def named_aside(attributes: str, inside: bool = False) -> bool:
    """Whether the class, id or role of an element names something else than the article; an article has its own header."""
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for found in _NAMED.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", found[2] or found[3] or found[4] or "").lower()
        if found_names := NAMES.intersection(_WORDS.findall(value)):
            if not inside or found_names - HEADINGS:
                return True
    return False


def lines_of(html: str) -> list[tuple[str, int]]:
    """The text lines of a page in order, with character references decoded, and what the markup says of each."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    state, inside, at, silent = OPEN, False, 0, ""
    by_name = False  # dropped for the name of an element alone
    head = False

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append((text, state))
            held.clear()

    lower, size = None, len(html)
    while at < size:
        if silent:
            # raw text up to its own end tag
            lower = lower or html.lower()
            end = lower.find(f"</{silent}", at)
            at = size if end < 0 else end
            silent = ""
            continue
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            held.append(html[at:start])
        if start == size:
            break
        found = _TOKEN.match(html, start)
        if not found:
            held.append("<")
            at = start + 1
            continue
        at = found.end()
        if not found[2]:
            if html.startswith("<![CDATA[", start):
                held.append(" ")
            continue
        name = found[2].lower()
        if name in BLOCKS:
            if name == "br":
                held.append("\n")
                continue
            flush()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    _, state, inside = stack[k]
                    del stack[k:]
                    break
            continue
        if name in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):
            if not found[3].rstrip().endswith("/"):
                silent = name
        if head and name not in IN_HEAD:
            flush()
            head = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "head":
                    _, state, inside = stack[k]
                    del stack[k:]
                    break
        head = head or name == "head"
        if name in VOID or found[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and any(s[0] == name for s in stack[-6:]):
            # such an element ends where the next of its kind begins, if nothing but inline elements lies between
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, state, inside = stack[k]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        stack.append((name, state, inside))
        named, before = False, state
        if name in SILENT or (named := named_aside(found[3], inside) and name not in ("html", "body") and (name not in MAIN or inside)):
            state = DROP
            if before != DROP:
                by_name = named and before == OPEN and not OTHERS.search(found[3]) and not _HIDDEN.search(found[3]) and name not in SILENT and name not in ASIDE
        elif name in ASIDE and not (name == "header" and inside):
            state = DROP
            if before != DROP:
                by_name = False
        elif name in MAIN and state == DROP and by_name:
            state, inside = DOUBTFUL, True
        elif name in MAIN and state not in (DROP, DOUBTFUL):
            state, inside = KEEP, True
    flush()
    # such an article is the page's own if there is no other
    doubt = DROP if any(s == KEEP for _, s in out) else KEEP
    return [(text, doubt if s == DOUBTFUL else s) for text, s in out]


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Positions of ``mine`` in a longest common subsequence of both lists of lines."""
    shared: set[int] = set()
    start, m, n = 0, len(mine), len(other)
    while start < m and start < n and mine[start] == other[start]:
        shared.add(start)
        start += 1
    while m > start and n > start and mine[m - 1] == other[n - 1]:
        m, n = m - 1, n - 1
        shared.add(m)
    # lines that the other side lacks are in no common subsequence
    there, here = set(other[start:n]), set(mine[start:m])
    rows = [i for i in range(start, m) if mine[i] in there]
    columns = [x for x in other[start:n] if x in here]
    if not rows or not columns:
        return shared
    number = {line: i for i, line in enumerate(here)}
    a, b = np.array([number[mine[i]] for i in rows]), np.array([number[x] for x in columns])
    return shared.union(rows[i] for i in common_subsequence(a, b))


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each start of ``b`` (none of it first) the length of its longest common subsequence with ``a``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, in space that grows with the lengths and not with their product."""
    found, todo = [], [(a, b, 0)]
    while todo:
        a, b, start = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) == 1:
            found += [start] * bool((b == a[0]).any())
            continue
        half = len(a) // 2
        split = int(np.argmax(lengths(a[:half], b) + lengths(a[half:][::-1], b[::-1])[::-1]))
        todo += [(a[:half], b[:split], start), (a[half:], b[split:], start + half)]
    return sorted(found)


def article(lines: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """The lines that stay, joined by a space."""
    has_main = any(state == KEEP for _, state in lines)
    if neighbour is None or neighbour == lines:
        # a copy of its neighbour has no template to tell; lines beside an article element are then not the article
        return " ".join(text for text, state in lines if state == KEEP or state == OPEN and not has_main)
    open_lines = [i for i, (_, state) in enumerate(lines) if state == OPEN]
    gone: set[int] = set()
    if open_lines:
        gone = shared_lines([text for text, _ in lines], [text for text, _ in neighbour]).intersection(open_lines)
        if len(gone) == len(open_lines) and not has_main:
            # nothing would be left of the page
            gone = set()
    return " ".join(text for i, (text, state) in enumerate(lines) if state == KEEP or state == OPEN and i not in gone)


def common_path(a: str, b: str) -> int:
    """How many leading characters two paths share."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; empty where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    host = F.lower(F.regexp_extract(rest, r"//([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"//[^/?#]*([^?#]*)", 1)


def runs(rows: DataFrame) -> Column:
    """The run of each row by its ``key``: pages with neighbouring keys have the same or the next.

    Bounds come from a sample of the keys by their hash, so that the same pages make the same runs: one for every ``RUN`` pages,
    at most ``RUNS``; beyond 13 million pages a run has more, which a task sorts, with spilling, and reads one after the other.
    """
    n = rows.count()
    count = min(RUNS, n // RUN + 1)
    share = min(1.0, SAMPLE * count / max(n, 1))
    sample = sorted(r.key for r in rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1_000_000)) <= int(share * 1_000_000)).select("key").distinct().collect())
    bounds = sorted({sample[i * len(sample) // count] for i in range(1, count)}) if sample else []
    if not bounds:
        return F.lit(0)
    inner = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + inner] for i in range(0, len(bounds), inner)]
    above = lambda array: F.size(F.filter(array, lambda b: b < F.col("key")))
    outer = F.greatest(above(F.lit([g[0] for g in groups])), F.lit(1))
    return (outer * (inner + 1) + above(F.element_at(F.array(*(F.lit(g) for g in groups)), outer))).cast("int")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): one row for each row of ``pages``; a null page is empty, a page without article gives "".

    Pages are ordered by host, path and a hash of the id. One shuffle brings runs of neighbours together, each with the page
    before and the page after it, and a task holds three pages at a time. The neighbour is the different page before or after
    on the host whose path shares the longer start; a page without one is decided by the markup. Repeated pages and ids
    are kept as they are, and other columns are not read; a null URL counts as a host of its own. At the edge of a run, a
    page whose copies fill the page handed over has no neighbour on that side. Equal tables give equal results.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat_ws("\x01", "host", "path", F.hex(F.xxhash64("page_id"))))
    rows = rows.withColumn("run", runs(rows)).withColumn("guest", F.lit(False))
    # the first and the last key of each run, RUNS rows at most, and the runs beside it, to which their pages are handed
    up = Window.orderBy("run")
    ends = rows.groupBy("run").agg(F.min("key").alias("low"), F.max("key").alias("high")).select("*", F.lag("run").over(up).alias("under"), F.lead("run").over(up).alias("over"))
    ends = cut_lineage(ends.select(F.explode(F.array(F.struct(F.col("low").alias("end"), F.col("under").alias("to")), F.struct(F.col("high").alias("end"), F.col("over").alias("to")))).alias("e")).where("e.to IS NOT NULL").select("e.*"))
    handed = rows.join(F.broadcast(ends), F.col("key") == F.col("end")).dropDuplicates(["end", "to"]).withColumn("run", F.col("to")).withColumn("guest", F.lit(True))
    both = rows.unionByName(handed.select(*rows.columns))
    order = ["run", "key", "page_id", F.xxhash64("html")]
    names = ("page_id", "url", "html", "host", "path", "guest", "run")
    ids = ", ".join(f"{c} {k}" for c, k in rows.dtypes[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (path, lines) of the last different page of the host
        held: list[tuple] = []  # (id, url, path, guest) of equal pages in a row, until the page after them is read
        held_of, held_lines = None, None
        ids, urls, texts, kind = [], [], [], None

        def tell(after: tuple | None) -> None:
            made: dict[bool, str] = {}
            for page_id, url, path, guest in held:
                if guest:
                    continue
                later = before is None or after is not None and common_path(path, after[0]) > common_path(path, before[0])
                if later not in made:
                    side = after if later else before
                    made[later] = article(held_lines, side and side[1])
                ids.append(page_id), urls.append(url), texts.append(made[later])

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])
            ids.clear(), urls.clear(), texts.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for page_id, url, html, host, path, guest, of_run in zip(*(part.column(c).to_pylist() for c in range(len(names)))):
                    lines = lines_of(html)
                    if held and not ((of_run, host) == held_of and lines == held_lines):
                        same = (of_run, host) == held_of
                        tell((path, lines) if same else None)
                        before = (held[-1][2], held_lines) if same else None
                        held = []
                    held.append((page_id, url, path, guest))
                    held_of, held_lines = (of_run, host), lines
                if ids:
                    yield told()
        if held:
            tell(None)
        if ids:
            yield told()

    return both.repartition("run").sortWithinPartitions(*order).select(*names).mapInArrow(run, f"{ids}, text string")
