"""Lines beside an article, both neighbours, and pages whose whole text was lost."""

from lexmill.llm import page_diff


def text_of(page, neighbour=None):
    return page_diff.article(page_diff.lines_of(page), neighbour and page_diff.lines_of(neighbour))


def test_alignment_decides_beside_articles():
    page = "<div>Site</div><p>{}</p><article>{}</article><div>End</div>"
    assert text_of(page.format("story one", "teaser"), page.format("story two", "teaser")) == "story one teaser"


def test_nearer_of_both_neighbours(spark):
    page = "<div>{}</div><p>{}</p>"
    rows = [(1, "http://h.org/a/1", page.format("A", "one")), (2, "http://h.org/b/1", page.format("B", "two")), (3, "http://h.org/b/2", page.format("B", "three"))]
    found = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    ranged = {r.page_id: r.text for r in found.collect()}
    lines = [page_diff.lines_of(h) for _, _, h in rows]
    assert page_diff.common_path("/b/1", "/b/2") > page_diff.common_path("/b/1", "/a/1")
    assert len(ranged) == 3 and page_diff.article(lines[1], lines[2]) == "two"


def test_copies_keep_their_text():
    page = "<nav>Menu</nav><p>all the text</p>"
    assert text_of(page, page) == "all the text"
    assert text_of(page, "<nav>Other</nav><p>all the text</p>") == "all the text"


def test_names_of_containers_and_open_heads():
    for name in ("content with-sidebar", "no-ads", "social-sciences"):
        assert text_of(f'<body><div class="{name}"><nav>m</nav><article><p>x</p></article></div></body>') == "x"
    assert text_of('<article>own</article><div class="comments"><article>reply</article></div>') == "own"
    assert text_of('<p>own</p><div class="comments"><article>reply</article></div>') == "own"
    assert text_of("<html><head><title>T</title><body><article>x</article>") == "x"
    assert text_of("<head><meta charset=utf-8><article>x</article>") == "x"


TEMPLATES = (
    "<div><a>Home</a><a>News {h}</a></div><div>Sections of {h}</div><p>{one}</p><div>{two}</div><div>All rights with {h}</div>",
    "<table><tr><td>Menu {h}<td>Archive</table><h1>{one}</h1><p>{two}</p><p>Write to {h}</p>",
    "<nav>{n}</nav><div>Top of {h}</div><p>{one}<p>{two}<footer>{n}</footer><div>Bottom of {h}</div>",
)


def generated():
    rows, truth = [], {}
    for i in range(240):
        host = i % 6 if i % 3 else 0  # one host has a third of the pages and more
        one, two = f"story {i} of {host} begins", f"and {i * 7} ends &amp; rests"
        rows.append((i, f"http://h{host}.org/{'abc'[i % 2]}/{i:03d}?x=1", TEMPLATES[host % 3].format(h=f"h{host}", n=f"menu {i}", one=one, two=two), "x", 1))
        truth[i] = f"{one} {two}".replace("&amp;", "&")
    return rows, truth


def slow_extract(rows):
    """The whole query by definition: sort by host, path and hash of the id, then look to both sides for a different page."""
    from urllib.parse import urlsplit

    import xxhash

    def signed(n):
        return xxhash.xxh64_intdigest(n.to_bytes(8, "little"), 42)

    pages = sorted((urlsplit(url).netloc, urlsplit(url).path, f"{signed(i):X}", i, page_diff.lines_of(html)) for i, url, html, *_ in rows)
    out = {}
    for at, (host, path, _, i, lines) in enumerate(pages):
        before = next((p for p in pages[at::-1] if p[0] != host or p[4] != lines), None)
        after = next((p for p in pages[at:] if p[0] != host or p[4] != lines), None)
        sides = [p for p in (before, after) if p and p[0] == host]
        side = max(sides, key=lambda p: page_diff.common_path(path, p[1]), default=None)
        out[i] = page_diff.article(lines, side and side[4])
    return out


def test_query_equals_its_definition_and_the_truth(spark, monkeypatch):
    monkeypatch.setattr(page_diff, "RUN", 7)
    rows, truth = generated()
    rows += [(1000 + i, f"http://h0.org/a/{i:03d}", rows[0][2], "x", 1) for i in range(5)]
    found = {r.page_id: r.text for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, run int").repartition(5)).collect()}
    assert found == slow_extract(rows)
    assert {i: found[i] for i in truth} == truth
    alone = {i: text_of(html) for i, _, html, *_ in rows}
    assert all(alone[i] != truth[i] for i in truth)


def test_equal_tables_give_equal_results(spark):
    rows, _ = generated()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, run int")
    assert sorted(map(tuple, page_diff.extract(frame.repartition(3)).collect())) == sorted(map(tuple, page_diff.extract(frame.repartition(8)).collect()))


def test_long_pages_are_aligned_in_little_space():
    lines = [f"line {i}" for i in range(6000)]
    assert page_diff.shared_lines(["own", *lines[::-1], "x", *lines], [*lines, "other"]).issuperset(range(6002, 12002))
