from __future__ import annotations

import random
from itertools import combinations

import pytest

boilerplate = pytest.importorskip("siftwire.llm.boilerplate")

STORY = ["The bank said on {} May that it had completed a deal worth {} million.", "Funding costs climbed by {} basis points, and analysts in town {} see little relief.", "Late fees may not exceed {}% of the instalment, the supervisor of area {} said.", "Executives travelled to branch {} in June to meet {} funds with an interest."]
NOISE = ["Accept all | Manage choices", "{} shares  {} views", "This site uses cookies to remember you.", "Home  Markets  Video  Archive"]


def pages(n=40, marked=False):
    r = random.Random(1)
    out = []
    for i in range(n):
        body = [s.replace("{}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}", 1).replace("{}", str(r.randrange(99))) for s in r.sample(STORY, 3)]
        if marked:
            lines = [f'<p class="share">{NOISE[2]}</p>', "<article>", *[f"<p>{b}</p>" for b in body], "<h2>Outlook</h2>", f"<p>{body[0]} Again.</p>", "</article>", f'<footer class="x">{NOISE[0]}</footer>', "<script>var a=1;</script>"]
            noise = {1, 9, 10}
        else:
            lines = [NOISE[0], NOISE[1].replace("{}", str(i)), NOISE[2], "", body[0], "Outlook", body[1], body[2], NOISE[3]]
            noise = {1, 2, 3, 9}
        out.append((f"id{i}", f"https://h{i % 2}.example/a/2025/{i:03x}", "\n".join(lines), noise))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r[:3], "clash", 0) for r in rows], "id string, url string, content string, host string, line int")
    got = {}
    for r in boilerplate.furniture_lines(df).collect():
        got.setdefault(r.article_id, set()).add(r.line_no)
    return got


def test_plain_and_marked_pages(spark):
    rows = [(f"p{i}", *p[1:]) for i, p in enumerate(pages())] + [(f"m{i}", *p[1:]) for i, p in enumerate(pages(marked=True))]
    got = run(spark, rows)
    assert {r[0]: got.get(r[0], set()) for r in rows} == {r[0]: r[3] for r in rows}


def test_odd_rows(spark):
    rows = [("a", None, "One line only.", None), ("b", "x", "", None), ("c", "x", None, None), (None, "x", "y", None), ("d", None, "\n \n", None), ("e", "u", "Story line one is here and long enough.\n" * 3000, None)]
    got = run(spark, rows)
    assert "a" not in got and "b" not in got and "c" not in got and "d" not in got
    assert run(spark, []) == {}


def brute(a, b):
    for k in range(min(len(a), len(b)), 0, -1):
        for x in combinations(range(len(a)), k):
            it = iter(b)
            if all(a[i] in it for i in x):
                return k
    return 0


@pytest.mark.parametrize("seed", range(6))
def test_common_lines(seed):
    r = random.Random(seed)
    a, b = [[r.randrange(5) for _ in range(8)] for _ in range(2)]
    x, y = boilerplate.common_lines(a, b)
    assert [a[i] for i in x] == [b[i] for i in y] and len(x) == brute(a, b)


def test_digits_are_masked():
    assert boilerplate.line_key("27 shares") == boilerplate.line_key("9  Shares") != boilerplate.line_key("9 views")


def test_a_unique_sentence_without_end_mark_is_story(spark):
    rows = [(f"p{i}", *p[1:]) for i, p in enumerate(pages())]
    tail = "Funding costs climbed by nine basis points since the merger of Qal and Wam. m²"
    url, content = rows[7][1:3]
    rows[7] = ("p7", url, content + "\nRelated stories\nBoard of Lazokir approves a capital call\n" + tail, None)
    rows[8] = ("p8", rows[8][1], rows[8][2] + "\nRelated stories\nGiza opens a desk for loans with a budget of Omar", None)
    assert run(spark, rows)["p7"] == {1, 2, 3, 9, 10, 11}
    assert run(spark, rows)["p8"] == {1, 2, 3, 9, 10, 11}


def test_a_line_between_story_lines_is_story_without_candidates(spark):
    rows = [("a", "https://x.example/1", "The bank closed its deal in May.\nA plain note on what Lazokir and its owners said of the deal\nLate fees may not exceed a tenth.", None)]
    assert run(spark, rows) == {}


@pytest.mark.parametrize("text, found", [("It fell to 5.8% of the total. m²", True), ('"Margins," she said, "show it." ½', True), ("Lazokir schließt Verbriefung über 51.3 Mio. ab", False), ("Board of Lazokir and Dr. Omar approve it", False), ("Board of Lazokir approves a capital call", False)])
def test_has_sentence(text, found):
    assert boilerplate.has_sentence(text) == found


def test_a_run_of_copies_does_not_hide_the_pages_around_it(spark):
    first, copy, last = (p[2] for p in (pages()[0], pages()[7], pages()[12]))
    rows = [("a", "https://h.example/a/1", first), *[(f"c{i}", "https://h.example/a/2", copy) for i in range(10)], ("z", "https://h.example/a/3", last)]
    df = spark.createDataFrame(rows, "id string, url string, content string")
    got = {r.id: {n for n, f in zip(r.line, r["flags"]) if f & boilerplate.SHARED} for r in boilerplate.difference(boilerplate.pages(df)).collect()}
    assert all({1, 2, 3, 9} <= got[r[0]] for r in rows) and len({frozenset(got[f"c{i}"]) for i in range(10)}) == 1


def test_stories_in_classed_paragraphs_and_lists_are_kept(spark):
    rows = []
    for i, (_, url, content, _) in enumerate(pages(60, marked=True)):
        lines = content.split("\n")
        lines[2:5] = [x.replace("<p>", '<p class="story-text" id="par">') for x in lines[2:5]]
        item = f"{chr(97 + i % 26)}{chr(97 + i // 26)}"
        lines[7:7] = ["<ul>", f"<li>Branch {item} opens in the old town with a desk for loans.</li>", f"<li>Branch {item} sells no cards before the end of June.</li>", "</ul>"]
        rows.append((f"m{i}", url, "\n".join(lines), {1, 13, 14}))
    assert {k: v for k, v in run(spark, rows).items() if v != {1, 13, 14}} == {}


def test_differencing_decides(spark, monkeypatch):
    rows = pages()
    assert run(spark, rows) == {r[0]: r[3] for r in rows}
    monkeypatch.setattr(boilerplate, "difference", lambda paged: paged)
    assert run(spark, rows) == {}


def _plain_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


@pytest.mark.parametrize("seed, kinds, table", [(1, 3, 1 << 27), (2, 40, 1 << 27), (3, 3, 50), (4, 40, 500), (5, 400, 1)])
def test_alignment_in_halves(seed, kinds, table, monkeypatch):
    monkeypatch.setattr(boilerplate, "TABLE", table)
    r = random.Random(seed)
    a, b = [[r.randrange(kinds) for _ in range(n)] for n in (120, 90)]
    x, y = boilerplate.common_lines(a, b)
    assert x == sorted(set(x)) and y == sorted(set(y))
    assert [a[i] for i in x] == [b[i] for i in y] and len(x) == _plain_lcs(a, b)


def test_long_pages_align_quickly():
    import time

    r = random.Random(1)
    a, b = [[r.randrange(50) for _ in range(20_000)] for _ in range(2)]
    start = time.time()
    assert len(boilerplate.common_lines(a, b)[0]) > 3000
    assert time.time() - start < 20


def test_scripts_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "HOT", 3)
    rows = [(f"p{i}", *p[1:]) for i, p in enumerate(pages())] + [(f"m{i}", *p[1:]) for i, p in enumerate(pages(marked=True))]
    got = run(spark, rows)
    assert {r[0]: got.get(r[0], set()) for r in rows} == {r[0]: r[3] for r in rows}
