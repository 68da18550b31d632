import random
import re

import pytest

from lexmill.operators import lines as module


def texts(seed=11, n=25):
    rng = random.Random(seed)
    forms = [
        "제{i}편 행정", "| 제{i}편 | 학사 |", "제{i}장  총  칙", "제{i}장 총칙제3편 행정 3—1—1", "제{i}장", "제{i}절 운영", "제{i}관 세부", "차 례", "찾아보기", "찾아보기라는 말로 시작하는 아주 긴 줄은 색인이 아니다",
        "제{i}조(목적) 이 규정은 목적을 정한다.", "제{i}조의2(정의) ① 뜻은 다음과 같다", "제 1 조 (목적) ① 첫째", "제1조(목적)", "제1조의3 본문", "제{i}조", "부 칙", "[별표 {i}] 서식", "<별지 제{i}호>",
        "① 위원회를 둔다", "② 위원장은", "{i}. 첫 항목", "{i}. ", "가. 작은 항목", "나. 다음", "| 표 | 행 |", "이어지는 문장", "끝난 문장이다.", "물음?", "", "  ", "학교 운영 규정", "규정은 시행한다", "사무 내규", "(1) 괄호", "3) 번호",
    ]
    out = [(i, "\n".join(rng.choice(forms).format(i=rng.choice([1, 2, 3, 12])) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return out + [(100, None), (101, ""), (102, "\n".join(forms * 20).format(i=1))]


def slow_join(text):
    out, buffer = [], []
    for at, line in enumerate((text or "").split("\n") if text is not None else []):
        line = line.strip()
        alone = not line or re.match(module.HEADER, line) or re.match(module.LIST_ITEM, line)
        if alone and buffer:
            out.append(buffer)
            buffer = []
        if alone:
            out.append([(at, line)])
            continue
        buffer.append((at, line))
        if line[-1] in ".?!" or buffer[0][1].startswith("|"):
            out.append(buffer)
            buffer = []
    return [(b[0][0], " ".join(x for _, x in b)) for b in [*out, *([buffer] if buffer else [])]]


@pytest.mark.parametrize("chunk", [3, 256])
def test_joined_lines(spark, chunk):
    rows = spark.createDataFrame(texts(), "doc_id long, text string")
    found = {}
    for r in sorted(module.joined_lines(module.lines_of(rows), chunk=chunk).collect(), key=lambda r: (r.doc_id, r.n)):
        found.setdefault(r.doc_id, []).append((r.first_at, r.line))
    assert found == {i: slow_join(t) for i, t in texts() if t is not None}


def slow_parse(text):
    """Regulations of one text by a loop that keeps all of its state: nodes of articles, and where every other line went."""
    regs, lines = [], [line.strip() for line in (text or "").split("\n")]
    now = None

    def fresh(part):
        return {"part": part, "preamble": [], "articles": [], "appendix": []}

    part = chapter = section = subsection = article = paragraph = item = None
    now, mode = fresh(None), "preamble"

    def flush():
        nonlocal now, mode, chapter, section, subsection, article, paragraph, item
        regs.append(now)
        now, mode = fresh(part), "preamble"
        chapter = section = subsection = article = paragraph = item = None

    for at, line in enumerate(lines):
        if not line:
            continue
        bare = line.replace("|", "").strip()
        if m := re.match(module.PART, bare):
            flush()
            part = now["part"] = f"{m[1].strip()} {m[2].strip()}".strip()
        elif m := re.match(module.CHAPTER_WITH_HEADER, line) or re.match(module.CHAPTER, line):
            chapter, section, subsection = f"{m[1].strip()} {m[2].strip()}".strip(), None, None
        elif re.match(module.SECTION, line):
            section, subsection = line, None
        elif re.match(module.SUBSECTION, line):
            subsection = line
        elif re.match(module.CONTENTS, line) or re.match(module.INDEX, line) and len(line) < 20:
            flush()
            now["preamble"].append(at)
        elif m := re.match(module.ARTICLE, line):
            if re.match(module.FIRST_ARTICLE, line) and now["articles"]:
                moved = []
                if mode == "appendix":
                    for k in range(len(now["appendix"]) - 1, -1, -1):
                        x = lines[now["appendix"][k]]
                        can = x.endswith(module.TITLE_ENDS) or "규정" in x and "시행한다" not in x and not re.match(r"^\d+\.", x) and not x.startswith("부")
                        if can and len(x) < 100:
                            now["appendix"], moved = now["appendix"][:k], now["appendix"][k:]
                            break
                flush()
                now["preamble"] = moved
            mode, paragraph, item = "article", None, None
            article = {"at": at, "no": m[1], "title": m[4] or "", "heads": (chapter, section, subsection), "content": [], "paragraphs": []}
            now["articles"].append(article)
            content = m[5].lstrip()
            if p := re.match(module.PARAGRAPH, content):
                paragraph = {"at": at, "no": p[1], "text": p[2], "items": []}
                article["paragraphs"].append(paragraph)
            elif content:
                article["content"].append(content)
        elif re.match(module.APPENDIX, line):
            mode = "appendix"
            chapter = section = subsection = article = paragraph = item = None
            now["appendix"].append(at)
        elif mode == "article":
            if m := re.match(module.PARAGRAPH, line):
                paragraph, item = {"at": at, "no": m[1], "text": m[2], "items": []}, None
                article["paragraphs"].append(paragraph)
            elif m := re.match(module.ITEM, line):
                if not paragraph:
                    paragraph = {"at": at, "no": "", "text": "", "items": []}
                    article["paragraphs"].append(paragraph)
                item = {"at": at, "no": m[1], "text": m[2], "subs": []}
                paragraph["items"].append(item)
            elif (m := re.match(module.SUBITEM, line)) and item:
                item["subs"].append((at, m[1], m[2]))
            elif paragraph:
                paragraph["text"] += ("\n" if line.startswith("|") else " ") + line
            else:
                article["content"].append(line)
        else:
            now[mode].append(at)
    flush()
    return regs


def slow_nodes(text):
    out = []
    for number, reg in enumerate(slow_parse(text)):
        for a in reg["articles"]:
            top = a["at"] * 4
            out.append((number, top, None, "article", a["no"], a["title"], "\n".join(a["content"])))
            for p in a["paragraphs"]:
                hollow, above = not p["no"] and not p["text"].strip(), p["at"] * 4 + 1
                if hollow:
                    above = top
                else:
                    out.append((number, above, top, "paragraph", p["no"], "", p["text"].strip()))
                for i in p["items"]:
                    out.append((number, i["at"] * 4 + 2, above, "item", i["no"], "", i["text"]))
                    out += [(number, at * 4 + 3, i["at"] * 4 + 2, "subitem", no, "", t) for at, no, t in i["subs"]]
    return sorted(out, key=str)


def slow_edges(text):
    out = []
    for number, reg in enumerate(slow_parse(text)):
        heads = [list(a["heads"]) for a in reg["articles"]]
        first = next((i for i, h in enumerate(heads) if h[0]), 0)
        if first and (m := re.search(r"제\s*(\d+)\s*장", heads[first][0])) and int(m[1]) >= 2:
            for h in heads[:first]:
                h[0] = "제1장 총칙"
        now, nodes = [None] * 3, [None] * 3
        for a, h in zip(reg["articles"], heads):
            node = a["at"] * 4
            for level, kind in enumerate(("chapter", "section", "subsection")):
                if h[level] != now[level]:
                    now[level:], nodes[level:] = [h[level]] + [None] * (2 - level), [None] * (3 - level)
                    if h[level] is not None:
                        nodes[level] = f"{kind[:3]}{node}"
                        out.append((number, nodes[level], kind, h[level], next((x for x in reversed(nodes[:level]) if x), None)))
            out.append((number, f"art{node}", "article", None, next((x for x in reversed(nodes) if x), None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [32, 256])
def test_regulations_articles_and_headings(spark, chunk):
    rows = spark.createDataFrame(texts(), "doc_id long, text string")
    parsed = module.parsed_lines(module.lines_of(rows), chunk=chunk).cache()
    got = parsed.collect()
    nodes = {}
    for r in module.article_nodes(parsed).collect():
        nodes.setdefault(r.doc_id, []).append((r.regulation, r.node, r.parent, r.kind, r.display_no, r.title, r.text))
    edges = {}
    for r in module.heading_edges(parsed, chunk=chunk).collect():
        edges.setdefault(r.doc_id, []).append((r.regulation, r.node, r.kind, None if r.kind == "article" else r.name, r.parent))
    for doc, text in texts():
        regs = slow_parse(text)
        for place in ("preamble", "appendix"):
            want = {at: n for n, reg in enumerate(regs) for at in reg[place]}
            assert {r["at"]: r.regulation for r in got if r.doc_id == doc and r.place == place} == want
        assert {r.part for r in got if r.doc_id == doc and r.kind == "article"} == {reg["part"] for reg in regs if reg["articles"]}
        assert sorted(nodes.get(doc, []), key=str) == slow_nodes(text)
        assert sorted(edges.get(doc, []), key=str) == slow_edges(text)
    parsed.unpersist()


def slow_addenda(text):
    nodes, now = [], None
    for at, line in enumerate(x.strip() for x in (text or "").split("\n")):
        if not line:
            continue
        m = re.match(module.ADDENDUM, line) or re.match(module.NUMBERED, line)
        p = re.match(module.PARAGRAPH, line)
        if m:
            now = [at, None, "addendum_item", m[1], m[2] or "", m[3]]
            nodes.append(now)
        elif p:
            nodes.append([at, now[0] if now else None, "paragraph" if now else "addendum_item", p[1], "", p[2]])
        elif now:
            now[5] = now[5] + ("\n" if line.startswith("|") else " ") + line if now[5] else line
        else:
            now = [at, None, "text", "", "", line]
            nodes.append(now)
    return sorted(map(tuple, nodes))


def test_addenda(spark):
    rows = [(i, "\n".join(random.Random(i).choices(["제1조(시행일) 이 규정은", "제2조의3", "1. (경과) 조치", "2.", "① 문단", "② ", "이어서", "| 표 |", "", "부칙"], k=i * 3))) for i in range(14)] + [(50, None)]
    found = {}
    for r in module.addenda_nodes(module.lines_of(spark.createDataFrame(rows, "doc_id long, text string")), chunk=8).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for doc, text in rows:
        assert sorted(found.get(doc, [])) == slow_addenda(text)


def test_list_trees(spark):
    rng = random.Random(6)
    deep = [(1, "\n".join("  " * i + f"{i}. level" for i in range(30))), (2, None), (3, "plain\n\n1) a\n    가. b\n  ① c\n나) d\n -  x\n12. "), (4, "\n".join("  " * rng.randint(0, 6) + rng.choice(["1. a", "가) b", "② c", "3) d", "no"]) for _ in range(300)))]

    def slow(text):
        stack, out = [], []
        for at, raw in enumerate((text or "").split("\n")):
            line = raw.lstrip()
            for name, pattern in module.MARKS:
                if m := re.match(pattern, line):
                    level = (len(raw) - len(line)) // 2
                    while stack and stack[-1][1] >= level:
                        stack.pop()
                    out.append((at, name, m[1], m[2], level, stack[-1][0] if stack else None, len(stack) + 1))
                    stack.append((at, level))
                    break
        return out

    rows = module.list_items(spark.createDataFrame(deep, "doc_id long, text string"), chunk=16).collect()
    for doc, text in deep:
        assert sorted(tuple(r)[1:] for r in rows if r.doc_id == doc) == slow(text)
