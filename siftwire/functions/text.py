"""Text functions: Catalyst expressions, and Arrow functions where Catalyst has none."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases from which on a text is boilerplate.  The compatible form cuts anywhere and to the end; the default
#: asks for a word boundary before the phrase and cuts to the end of the line.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of (?:use|service)", "subscribe (?:now|to|for)", "sign (?:in|up) to",
    "follow us on", "share this article", "read more", "advertisement", "sponsored content",
)
WORD = "\\p{L}\\p{N}_"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Every blank, line breaks too: Java's \\s alone is ASCII.
_BLANKS = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, f"^{_BLANKS}+|{_BLANKS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), "[\\s\\u00a0\\u2000-\\u200a\\u3000]+", " "))


def strip_tags(c: Column) -> Column:
    """Every tag as a space, then squeezed."""
    return squeeze(F.regexp_replace(text_or_empty(c), "<[^>]+>", " "))


#: Elements that go with all that they hold.
HOLLOW = ("script", "style", "nav", "header", "footer", "aside", "form", "button", "iframe")
#: Elements that hold nothing in HTML, so they open nothing.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def page_text(page: str) -> tuple[str, str, list[str]]:
    """(text, text of the main container, its paragraphs) of a page, by the standard parser: whatever HOLLOW elements hold is left out,
    however they nest; entities are decoded; what is never closed ends with the element around it.

    The main container is the first ``article``, else the first ``main``, else the first ``div`` whose class names a body of text, else
    the page.
    """
    from html.parser import HTMLParser

    said: list[tuple[str, int, int]] = []  # (text, its paragraph or 0, its containers as bits)
    stack: list[str] = []
    hollow = paragraph = number = 0
    opened: list[tuple[int, str]] = []  # (depth, kind) of open containers
    kinds = {"article": 1, "main": 2, "body": 4}
    first: set[str] = set()

    class Reader(HTMLParser):
        CDATA_CONTENT_ELEMENTS = ("script", "style")

        def handle_starttag(self, tag, attrs):  # noqa: ANN001
            nonlocal hollow, paragraph, number
            if tag in _VOID:
                return
            if tag == "p" and "p" in stack:  # a paragraph ends where the next begins
                self.handle_endtag("p")
            stack.append(tag)
            hollow += tag in HOLLOW
            if hollow:
                return
            kind = tag if tag in ("article", "main") else "body" if tag == "div" and re.search("content|article|entry|post|story|detail", (dict(attrs).get("class") or "").lower()) else ""
            if kind and kind not in first:
                first.add(kind)
                opened.append((len(stack), kind))
            if tag == "p":
                number += 1
                paragraph = number

        def handle_endtag(self, tag):  # noqa: ANN001
            nonlocal hollow, paragraph
            if tag not in stack:
                return
            while stack:
                last = stack.pop()
                hollow -= last in HOLLOW
                if last == "p":
                    paragraph = 0
                while opened and opened[-1][0] > len(stack):
                    opened.pop()
                if last == tag:
                    return

        def handle_data(self, data):  # noqa: ANN001
            if not hollow and data.strip():
                said.append((data, paragraph, sum(kinds[k] for _, k in opened)))

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    joined = lambda parts: " ".join(" ".join(parts).split())
    bit = next((kinds[k] for k in ("article", "main", "body") if k in first), 0)
    within = [x for x in said if not bit or x[2] & bit]
    paragraphs: dict[int, list[str]] = {}
    for t, n, _ in within:
        if n:
            paragraphs.setdefault(n, []).append(t)
    return joined([t for t, _, _ in said]), joined([t for t, _, _ in within]), [joined(p) for p in paragraphs.values()]


def strip_html(c: Column) -> Column:
    """Text of a page without the elements that hold no prose (``page_text``); null gives an empty text.

    Texts without markup or entities stay in the JVM.
    """

    @F.pandas_udf("string")
    def read(pages):
        return pages.map(lambda t: t if t is None else page_text(t)[0])

    t = text_or_empty(c)
    marked = t.rlike("[<&]")
    return squeeze(F.when(marked, read(F.when(marked, t))).otherwise(t))


def main_text(c: Column, paragraph: int = 25, least: int = 100) -> Column:
    """The paragraphs of a page's main container that are longer than ``paragraph``; those of the whole page where they make less than
    ``least`` characters and the page has more."""

    def choose(t: str) -> str:
        _, _, own = page_text(t)
        own = [x for x in own if len(x) > paragraph]
        if sum(map(len, own)) < least:
            every = [x for x in page_text(re.sub("(?i)</?(?:article|main|div)[^>]*>", " ", t))[2] if len(x) > paragraph]
            own = every if len(" ".join(every)) > len(" ".join(own)) else own
        return " ".join(own)

    @F.pandas_udf("string")
    def read(pages):
        return pages.map(lambda t: t if t is None else choose(t))

    return read(text_or_empty(c))


def strip_boilerplate(c: Column, compat: bool = False) -> Column:
    phrases = "|".join(BOILERPLATE)
    pattern = f"(?is)(?:{phrases}).*|\\[?\\.\\.\\.\\]?" if compat else f"(?i)\\b(?:{phrases})\\b[^\\n]*|\\[?\\.\\.\\.\\]?"
    return F.regexp_replace(text_or_empty(c), pattern, "")


def distinct_sentences(c: Column) -> Column:
    """The sentences of a text, each once (the first, whatever the case), joined by a space.

    An Arrow function: higher-order functions would search the list of sentences anew for each of them, which long texts make slow.
    """
    cut = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
    blanks = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def one(t: str) -> str:
        kept: dict[str, str] = {}
        for s in cut.split(t):
            s = s.strip(blanks)
            if s:
                kept.setdefault(s.lower(), s)
        return " ".join(kept.values())

    @F.pandas_udf("string")
    def distinct(texts):
        return texts.map(one)

    return distinct(text_or_empty(c))


def clean(c: Column) -> Column:
    """Encoding repaired; markup, boilerplate, repeated sentences and blanks removed, in this order; null gives an empty text."""
    return squeeze(distinct_sentences(strip_boilerplate(strip_html(repair_encoding(c)))))


def title_key(c: Column, compat: bool = False) -> Column:
    """A title without its publisher's suffix, punctuation and case.  The compatible form cuts at the first hyphen, the default asks
    for blanks round the dash."""
    t = F.lower(text_or_empty(c))
    t = F.regexp_replace(t, "\\s*[-|–—]\\s*[^|–—]+$" if compat else "\\s+[-|–—]\\s+[^|–—]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, f"[^{WORD}\\s]", " "), "\\s+", " "))


def title_words(c: Column) -> Column:
    """A title in lower case with punctuation deleted."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), f"[^{WORD}\\s]", ""))


def fold_arabic(c: Column) -> Column:
    """Quotes and brackets as blanks, hamza carriers as bare alef, final forms unified, squeezed, lower case."""
    t = F.regexp_replace(text_or_empty(c), "[\"'“”‘’«»()\\[\\]{}]", " ")
    return F.lower(F.trim(F.regexp_replace(F.translate(t, "أإآىة", "ااايه"), "\\s+", " ")))


def script_language(title: Column, content: Column) -> Column:
    """``ar`` if title or content hold a letter of the Arabic block, else ``en``."""
    return F.when(F.concat_ws(" ", title, content).rlike("[\\u0600-\\u06FF]"), "ar").otherwise("en")


def is_english(title: Column, language: Column) -> Column:
    return F.when(title.rlike("[\\u0600-\\u06FF]"), False).when(title.rlike("[A-Za-z]"), True).otherwise(F.coalesce(language == "en", F.lit(False)))


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.lower(F.trim(text_or_empty(title))), F.lit("|"), F.lower(F.trim(text_or_empty(content)))), 256)


def publisher_suffix(title: Column) -> Column:
    """The publisher that stands after the last ``" - "`` of a title, if it is shorter than 40 characters; else null."""
    tail = F.regexp_extract(text_or_empty(title), "^.* - (.*)$", 1)
    return F.when((F.trim(tail) != "") & (F.length(tail) < 40), F.trim(tail))


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules (pattern, replacement) applied in order."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def recipients(c: Column) -> Column:
    """Addresses of a list separated by commas and semicolons, without display names."""
    parts = F.filter(F.transform(F.split(text_or_empty(c), "[,;]+"), lambda x: F.trim(x)), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike("<[^>]+>"), F.regexp_extract(p, "<([^>]+)>", 1)).otherwise(p))


#: Headings that a model puts before its summary.
HEADINGS = ("final polish", "executive summary", "factual summary", "summary", "overview", "draft")


def scrub_summary(c: Column) -> Column:
    """The prose of a model's reply.

    A line is no prose if it is blank, a fence, or asks a question and answers it with yes or no.  From the opening of what is left, all
    that comes before the prose goes, in any order and number: marks, HEADINGS, numbered titles that end in a colon, a bare verdict.
    """
    lines = F.transform(F.split(text_or_empty(c), "\\R"), lambda x: F.trim(x))
    prose = F.filter(lines, lambda x: (x != "") & ~x.startswith("```") & ~x.rlike("(?i)\\?\\W*(?:yes|no)\\b"))
    before = "|".join((
        "[\\s#*_>)(\\]\\[?-]+",
        "(?:" + "|".join(HEADINGS) + ")[*_\\s]*[:-]+",
        "[0-9]+[.)][*_\\s]*[\\p{L} ]+[*_]*:",
        "(?:yes|no)\\b\\s*[),.:;-]+",
    ))
    return F.trim(F.regexp_replace(F.array_join(prose, "\n"), f"(?i)^(?:{before})+", ""))


#: Signs of a reply that is no summary, and phrases of one that says nothing.
MALFORMED = ("?* yes", "?* no", "professional english? yes", "concrete facts? yes")
STUBS = (
    "no_substance", "contains only the title", "without disclosing any concrete figures", "no specific figures",
    "no specific dates, rates, or institutional decisions", "metadata and date of this listing committee", "provides only the metadata",
)


def valid_summary(c: Column, least: int = 50) -> Column:
    """Whether a summary can be sent: long enough, no Arabic letter, no sign of MALFORMED or STUBS; null cannot."""
    t = F.lower(c)
    signs = [t.contains(x) for x in (*MALFORMED, *STUBS)]
    bad = c.rlike("[\\u0600-\\u06FF]") | c.startswith(")") | c.startswith("?*")
    for x in signs:
        bad = bad | x
    return F.coalesce((F.length(c) >= least) & ~bad, F.lit(False))


def strip_fence(c: Column) -> Column:
    """The body of a fenced block, or the text itself."""
    return F.trim(F.regexp_replace(text_or_empty(c), "^\\s*```[a-zA-Z]*\\s*|\\s*```\\s*$", ""))


def wrap_untrusted(c: Column, limit: int) -> Column:
    """Foreign text for a prompt: between marks, cut to ``limit`` characters, the marks themselves taken out."""
    t = F.regexp_replace(text_or_empty(c), "</?untrusted>", "")
    return F.concat(F.lit("<untrusted>\n"), F.substring(t, 1, limit), F.lit("\n</untrusted>"))


def unwrapped(prompt: str) -> str:
    """What ``wrap_untrusted`` wrapped."""
    return prompt.removeprefix("<untrusted>\n").removesuffix("\n</untrusted>")


# --- Arrow ---------------------------------------------------------------------------------------------------------------


def token_sort_ratio(a: str | None, b: str | None) -> int:
    """100 times the normalised indel similarity of the sorted tokens, rounded."""
    x, y = (" ".join(sorted(re.sub(r"\W+", " ", (t or "").lower()).split())) for t in (a, b))
    if not x or not y:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = v = (1 << len(x)) - 1
    for c in y:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return round(200 * (len(x) - v.bit_count()) / (len(x) + len(y)))


def token_sort_ratio_column(a: Column, b: Column) -> Column:
    import pandas as pd

    @F.pandas_udf("int")
    def ratio(x, y):
        return pd.Series([token_sort_ratio(p, q) for p, q in zip(x, y)], dtype="int32")

    return ratio(a, b)


def repair_encoding(c: Column) -> Column:
    """NFC, and UTF-8 that was read as Latin-1 read again where the whole text allows it."""
    import unicodedata

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFC", t)
        try:
            return t.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return t

    @F.pandas_udf("string")
    def repair(x):
        return x.map(one)

    return repair(c)
