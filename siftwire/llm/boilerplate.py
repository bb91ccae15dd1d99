"""Page furniture mixed with the story: nearest-URL page differencing.

Pages are range-sorted by host and URL path; each page is aligned with its nearest neighbours on the same host, line by line, by
longest common subsequence, and the shared lines are deleted.  Lines are compared by a key of their text without markup, with
digits masked, so that "27 shares" and "9 shares" are one line.  Neighbours that share most of their text are copies of one story
and count as one neighbour, whose shared lines are shared lines of all copies.

A key that some alignment shares is a candidate wherever it stands.  A story also shares lines with its neighbours (subheads, stock
sentences), so the corpus confirms or vetoes each candidate: how often its key is shared, how often it stands in furniture markup
(link lists, blocks outside the story's container) against story markup, and whether it is a subhead.  These counts cover
all pages and are summed per task before they are shuffled.

Lines that no alignment shares (lists of other stories) are furniture only beside the shared ones: where the page's own markup sets
them apart, or, on plain pages, where a line has neither an end mark nor a full sentence and stands in an unbroken run of such
lines beside a candidate that was confirmed.  Any other unshared line belongs to the story.

Defined results: null, blank and markup-only lines are no furniture; a page of one single text line has none; pages without a URL
are aligned with one another; repeated rows give one row per line; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import cut
from .encoding import SUSPECT, repair
from .lookalike import fold

#: Flags of a line.  MARKED: the page has markup; INSIDE: in the story's container, or no container is known.
TERMINAL, MARKED, INSIDE, LINKED, HEAD, SHORT, BETWEEN, SCRIPT, ALONE, SHARED, SENTENCE = (1 << i for i in range(11))

_SUSPECT_RE = re.compile(SUSPECT)
_TAG = re.compile(r"<[^<>]*>")
_HTML = re.compile(r"<(?:p|div|html|body|article|main|h[1-6]|ul|li|section)\b", re.I)
_SCRIPT = re.compile(r"<(script|style)\b.*?(?:</\1>|$)", re.I)
_OPEN = re.compile(r"<(div|article|main|section|aside|ul|ol|nav|footer|header|table)\b[^<>]*>", re.I)
_CLOSE = re.compile(r"</(div|article|main|section|aside|ul|ol|nav|footer|header|table)\s*>", re.I)
#: Elements that HTML itself sets apart from the main content.  Classes, ids and roles decide nothing: stories have them as well.
_APART = re.compile(r"^\s*<(?:footer|aside|nav|form|button)\b", re.I)
_LINK = re.compile(r"<a\b[^<>]*>.*?</a>", re.I | re.S)
_H2 = re.compile(r"<h[12]\b", re.I)
_ODD = re.compile("[ ­؜​-‏ - ‪- ⁠　ﬀ-﻿＀-￯Ͱ-ԯ]")
_END = re.compile(r"[.!?؟…。»”\"’)]$|\.[\"”»’)]$")
_MARK = re.compile("(\\d\\s)?([^\\W\\d_]*|[\\d%٪]+)[\"”»’')\\]]*(。|[.!?؟…]+[\"”»’')\\]�]*(?=\\s|$))")
_DIGITS = re.compile(r"[0-9٠-٩۰-۹]+")


def line_key(text: str) -> int:
    """64-bit key of a line's text with digits masked."""
    masked = _DIGITS.sub("0", text.casefold())
    return int.from_bytes(blake2b(" ".join(masked.split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def has_sentence(text: str) -> bool:
    """Whether a sentence of at least four words ends in a text, whatever follows it ("... of the total. m²").

    A mark ends no sentence after an initial or a title ("Dr."), after a short unit of a number ("51 Mio.") or before a word in lower case.
    """
    for m in _MARK.finditer(text):
        word, after = m[2], text[m.end() :].split(None, 1)
        if m[3] == "。":
            return True
        if word.isalpha() and len(word) < (5 if m[1] else 3 if word[0].isupper() else 2) or after and after[0].isalpha() and after[0][0].islower():
            continue
        if len(text[: m.end()].split()) >= 4:
            return True
    return False


def _container(lines: list[str]) -> list[bool]:
    """Whether each line stands in the story's block: the innermost block with the most prose, and the lists right within it."""
    stack, blocks, prose = [0], [], [0]
    within, listed = [0], [False]  # the block around each block, and whether it is a list
    for raw in lines:
        opens, closes = _OPEN.findall(raw), len(_CLOSE.findall(raw))
        text = len(_TAG.sub("", _LINK.sub("", raw)).strip())
        if not text and len(opens) > closes:
            for tag in opens[closes:]:
                within.append(stack[-1])
                listed.append(tag.lower() in ("ul", "ol", "table"))
                stack.append(len(prose))
                prose.append(0)
            blocks.append(stack[-1])
            continue
        blocks.append(stack[-1])
        if text > 40:
            prose[stack[-1]] += text
        for _ in range(max(0, closes - len(opens))):
            if len(stack) > 1:
                stack.pop()
    story = max(range(len(prose)), key=lambda b: (prose[b], -b))
    return [b == story or listed[b] and within[b] == story for b in blocks]


def text_lines(content: str) -> list[tuple[int, str, int]]:
    """(line_no, text, flags) of every line of a content that has text; garbled and look-alike characters are put right first."""
    if _SUSPECT_RE.search(content):
        content = repair(content)[0]
    if _ODD.search(content):
        content = fold(content)
    lines = content.split("\n")
    marked = bool(_HTML.search(content))
    if marked:
        inside = _container(lines)
    out = []
    for i, raw in enumerate(lines):
        flags = 0
        if marked:
            flags |= MARKED
            bare = _SCRIPT.sub(" ", raw)
            text = unescape(_TAG.sub(" ", bare)).strip()
            if not text and bare != raw and re.sub(r"</?(?:script|style)[^<>]*>", "", raw).strip():
                out.append((i + 1, "", flags | SCRIPT))
                continue
            if inside[i] and not _APART.search(raw):
                flags |= INSIDE
            if text and _LINK.search(bare) and not unescape(_TAG.sub(" ", _LINK.sub(" ", bare))).strip(" |/>·•-\t"):
                flags |= LINKED
            if _H2.search(raw):
                flags |= HEAD
        else:
            text = raw.strip()
            flags |= INSIDE
        if not text:
            continue
        if _END.search(text):
            flags |= TERMINAL
        if has_sentence(text):
            flags |= SENTENCE
        if len(text) <= 60 and len(text.split()) <= 6:
            flags |= SHORT
        out.append((i + 1, text, flags))
    if len(out) == 1 and not out[0][2] & SCRIPT:
        return [(out[0][0], out[0][1], out[0][2] | ALONE)]
    for j in range(1, len(out) - 1):
        if out[j - 1][2] & TERMINAL and out[j + 1][2] & TERMINAL:
            out[j] = (out[j][0], out[j][1], out[j][2] | BETWEEN)
    return out


def read_lines(content: str) -> list[tuple[int, int, int]]:
    """(line_no, key, flags) of every line of a content that has text."""
    return [(i, line_key(t) if t else 0, f) for i, t, f in text_lines(content)]


#: Bits of the table of one alignment, at most; longer pages are aligned in halves.
TABLE = 1 << 27


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions of a longest common subsequence in both lists.

    Common ends are cut off, lines of one side alone left out, and the rest is aligned bit-parallel: a page of n lines costs n steps
    on integers of m bits, and the path is read off the kept rows.
    """
    n, m, lead = len(a), len(b), 0
    while lead < n and lead < m and a[lead] == b[lead]:
        lead += 1
    while n > lead and m > lead and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    both = set(a[lead:n]) & set(b[lead:m])
    at_a, at_b = list(range(lead)), list(range(lead))
    if both:
        ia, ib = [i for i in range(lead, n) if a[i] in both], [i for i in range(lead, m) if b[i] in both]
        for x, y in _aligned([a[i] for i in ia], [b[i] for i in ib]):
            at_a.append(ia[x])
            at_b.append(ib[y])
    return at_a + list(range(n, len(a))), at_b + list(range(m, len(b)))


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each item of ``a``: bit j is 0 where item j of ``b`` makes the longest common subsequence longer."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE:
        half = len(a) // 2
        for up in _rows(a[:half], b):
            pass
        for down in _rows(a[:half - 1:-1], b[::-1]):
            pass
        # Length of the first half with b[:j] and of the second with b[j:], for every j.
        grown = lambda v: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), count=len(b), bitorder="little").astype(np.int64))])
        cut_ = int((grown(up) + grown(down)[::-1]).argmax())
        return _aligned(a[:half], b[:cut_]) + [(x + half, y + cut_) for x, y in _aligned(a[half:], b[cut_:])]
    kept = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if kept[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not kept[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.append((i, j))
    return out[::-1]


#: How many neighbouring stories along the URL path a page is aligned with; all copies of a story are one.
NEAREST = 3

_PAGE = "id {kind}, host string, path string, line array<int>, key array<bigint>, flags array<int>"


def pages(articles: DataFrame, key: str = "id", url: str = "url", content: str = "content") -> DataFrame:
    """(id, host, path, line, key, flags): each page as its line keys; the texts themselves are not shuffled."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z]+://(?:www\\.)?([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    rows = articles.filter(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("id"), host.alias("host"), path.alias("path"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [list(zip(*read_lines(t))) or [(), (), ()] for t in b.column(3).to_pylist()]
            cols = [pa.array([list(p[i]) for p in parts], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["id", "host", "path", "line", "key", "flags"])

    return rows.mapInArrow(run, _PAGE.format(kind=articles.schema[key].dataType.simpleString()))


def difference(paged: DataFrame) -> DataFrame:
    """``pages`` with SHARED set on the lines that a page has in common with its nearest neighbours on the host.

    A host of any size spreads over many parts of the range sort; where two parts meet, a page has its neighbours on one side.
    """
    kind = paged.schema["id"].dataType.simpleString()
    # An alignment needs the keys alone; exact copies of a row say the same and follow each other.
    ordered = paged.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[list] = []  # [host, keys, flags, shared keys, copies of this batch] of the last stories

        for b in batches:
            hosts, keys, flags = b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()
            copied = []
            for h, k, f in zip(hosts, keys, flags):
                if near and near[-1][0] != h:
                    near = []
                story, shared = None, set()
                prose = sum(1 for x in f if x & TERMINAL and not x & SHORT)
                for entry in near:
                    at, at2 = common_lines(k, entry[1])
                    if 2 * sum(1 for i in at if f[i] & TERMINAL and not f[i] & SHORT) > prose:
                        story = entry  # this page is a copy of it
                        continue
                    for i in at:
                        f[i] |= SHARED
                        shared.add(k[i])
                    for i in at2:
                        entry[2][i] |= SHARED
                        entry[3].add(entry[1][i])
                if story is None:
                    near = [*near[1 - NEAREST :], [h, k, f, shared, []]]
                else:  # the nearest copy stands for the story: another template has other furniture
                    if not story[4]:
                        copied.append(story)
                    story[4].append((story[1], story[2]))
                    story[1], story[2] = k, f
                    story[3].update(shared)
                    near = [*[x for x in near if x is not story], story]
            for story in copied:
                for k, f in [(story[1], story[2]), *story[4]]:
                    for i, x in enumerate(k):
                        if x in story[3]:
                            f[i] |= SHARED
                story[4].clear()
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(flags, pa.list_(pa.int32()))], b.schema.names)

    return ordered.mapInArrow(run, _PAGE.format(kind=kind))


#: Keys that a share of the lines above 1 / HOT has, of which there are at most HOT, meet their counts without a shuffle.
HOT = 10_000


def _has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(flag) != 0


def furniture_lines(articles: DataFrame, key: str = "id", url: str = "url", content: str = "content") -> DataFrame:
    """(article_id, line_no): the lines of each page that have text, none of which belongs to the story."""
    lines = difference(cut(pages(articles, key, url, content))).select("id", F.inline(F.arrays_zip("line", "key", "flags")))
    lines = cut(lines.dropDuplicates(["id", "line"]))
    scripts, told = lines.filter(_has(SCRIPT)), lines.filter(~_has(SCRIPT))
    outer = _has(MARKED) & (_has(LINKED) | ~_has(INSIDE))
    n = lambda c: F.sum(c.cast("bigint"))
    known = told.groupBy("key").agg(
        F.count("*").alias("n"),
        n(outer).alias("in_furniture"),
        n(_has(MARKED) & ~outer & ~_has(HEAD)).alias("in_story"),
        n(_has(HEAD) & _has(INSIDE)).alias("as_head"),
        n(_has(SHARED)).alias("shared"),
        n(_has(SHORT) & _has(BETWEEN) & ~_has(TERMINAL)).alias("between"),
    ).filter("n > 1")
    known = cut(known)
    # What recurs is hot by nature.  No more than HOT keys can have that share of all lines: their counts are broadcast, and only the
    # lines of rarer keys are shuffled.
    often = F.col("n") > max(1, lines.count() // HOT)
    hot = F.broadcast(known.filter(often))
    j = told.join(hot, "key").unionByName(told.join(hot.select("key"), "key", "left_anti").join(known.filter(~often), "key", "left"), allowMissingColumns=True)
    marks = F.coalesce(F.col("in_furniture") + F.col("in_story"), F.lit(0))
    usual = F.coalesce(F.col("in_furniture") / F.greatest(marks, F.lit(1)), F.lit(0.0))
    head = F.coalesce(F.col("as_head"), F.lit(0)) > F.coalesce(F.col("in_furniture"), F.lit(0))
    shared = F.coalesce(F.col("shared") / F.col("n"), F.lit(0.0))
    subhead = _has(SHORT) & ~_has(TERMINAL) & (head | (marks == 0) & (F.coalesce(F.col("between") / F.col("n"), _has(BETWEEN).cast("int")) >= 0.5))
    candidate = F.coalesce(F.col("shared"), F.lit(0)) > 0
    stock = F.when(marks >= 3, usual >= 0.15).otherwise(F.when(_has(TERMINAL), (shared >= 0.5) & (F.col("n") >= 4) & (usual >= 0.15) | (marks == 0) & (shared >= 0.6) & (F.col("n") >= 4)).otherwise(True))
    furniture = (
        F.when(_has(ALONE), False)
        .when(_has(HEAD) & _has(INSIDE) | head, False)
        .when(outer, True)
        .when(_has(MARKED) & ~_has(TERMINAL) & ~_has(SHORT) & (marks < 3), False)
        .when(subhead, False)
        .otherwise(candidate & stock)
    )
    open_ = ~_has(MARKED) & ~_has(ALONE) & ~candidate & ~head & ~subhead & ~_has(TERMINAL) & ~_has(SENTENCE) & ((marks < 3) | (usual >= 0.15))
    listed = open_ & ~furniture
    j = j.select("id", "line", _has(MARKED).alias("marked"), F.coalesce(furniture, F.lit(False)).alias("furniture"), F.coalesce(listed, F.lit(False)).alias("listed"))
    # Of plain pages, the nearest line before and after that is not itself in question; each frame ends at the row, so a page costs linear time.
    w = lambda line: Window.partitionBy("id").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    sure = F.when(~F.col("listed"), F.col("furniture"))
    beside = [F.coalesce(F.last(sure, ignorenulls=True).over(w(o)), F.lit(False)) for o in (F.col("line").asc(), F.col("line").desc())]
    plain = j.filter("not marked").withColumn("before", beside[0]).withColumn("after", beside[1]).filter("furniture or listed and (before or after)")
    return j.filter("marked and furniture").select("id", "line").unionByName(plain.select("id", "line")).unionByName(scripts.select("id", "line")).select(F.col("id").alias("article_id"), F.col("line").cast("bigint").alias("line_no"))
