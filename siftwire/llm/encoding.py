"""Text decoded with the wrong character encoding: find it and restore it.

Characters are mapped back to the bytes of a legacy encoding, a byte-structure automaton (a regular expression over the
characters of lead and continuation bytes) finds the maximal spans of well-formed multibyte sequences, and only those spans are
decoded; text read wrongly several times is decoded as often.  East Asian two-byte encodings have automata of their own.  Single-byte
text read as another single-byte encoding has no such structure: there, the words that only the wrong reading explains are decoded.
Where the bytes alone prove nothing, a decoding is taken only if the letters that are usual in its language make up as much of it
as of any text; else the text stays as it is.  What is left of replacement characters is found, but stays.

Defined results: null and blank texts are not garbled; a text of any length is searched whole; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 is taken for; for some, one sequence alone is no proof.
READERS = {"cp1252": 1, "latin-1": 1, "cp850": 1, "cp437": 1, "mac_roman": 1, "cp1254": 1, "cp1256": 2, "cp1251": 3}
#: A cheap sign in the JVM that a text may be garbled: it decides only which texts are searched.
SUSPECT = (
    "[\\u00ef][\\u00bb\\u00bc\\u00bd]|[\\uff01-\\uff5e]|\\u2248|[\\u00ac][\\u00b4\\u00aa]|[ldnscjmLDNSCJM]\\?[a-z\\u00e0-\\u00ff]|[\\u0410-\\u044f]{4}|[\\u4e00-\\u9fff]{3}|[\\u0080-\\u009f\\ufffd\\u2500-\\u259f\\u221a\\u2202\\u0192\\u02c6\\u02dc\\u2030\\u0152\\u0178\\u0160\\u017d\\u00c0-\\u00df\\u00f0\\u00fd\\u00fe]"
    "|[\\u00e2\\u00e3\\u00e5][\\u0080-\\u00bf\\u2018-\\u203a\\u20ac\\u2122]|[\\u00c0-\\u00ff]{3}|[\\u0637\\u0638][^\\u0621-\\u064a\\s][\\u0637\\u0638]|[\\u0420\\u0421][^\\u0430-\\u044f\\s][\\u0420\\u0421]|[A-Za-z][\\u00f7\\u00f5\\u00b3][a-z]|\\?\\?|[a-z\\u00e0-\\u00ff]\\?[a-z]"
)


def _byte_chars(codec: str) -> dict[int, str]:
    """The character of each byte from 0x80; bytes without one pass as the control character of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(None)
def _reader(codec: str):
    """(automaton over characters, translation back to bytes as latin-1 characters)."""
    chars = _byte_chars(codec)
    cls = lambda a, b: "[" + "".join(re.escape(chars[i]) for i in range(a, b)) + "]"
    cont = cls(0x80, 0xC0)
    spans = re.compile(f"(?:{cls(0xC2, 0xE0)}{cont}|{cls(0xE0, 0xF0)}{cont}{{2}}|{cls(0xF0, 0xF5)}{cont}{{3}})+")
    return spans, {ord(c): b for b, c in chars.items()}


def _plausible(c: str) -> bool:
    """Characters that texts hold: letters of the common scripts, marks, currency and typographic signs."""
    o = ord(c)
    return (
        0x80 <= o <= 0x17F or 0x386 <= o <= 0x45F or 0x5D0 <= o <= 0x5EA or 0x600 <= o <= 0x6FF or 0x2010 <= o <= 0x2044 or 0x20A0 <= o <= 0x20BF
        or o in (0x192, 0x2C6, 0x2DC, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202B, 0x202C, 0x2122, 0x2212, 0xFEFF, 0xFFFD)
        or 0x4E00 <= o <= 0x9FFF or 0x3040 <= o <= 0x30FF or 0xFB50 <= o <= 0xFEFC or 0x1F300 <= o <= 0x1FAFF or 0xFF01 <= o <= 0xFF5E or 0x300 <= o <= 0x36F
    )


def _decode_spans(text: str) -> tuple[str, int]:
    """The text with the spans of the reading that explains most of it decoded, and how many characters they held."""
    best, gain = text, 0
    for codec, least in READERS.items():
        spans, back = _reader(codec)
        got = 0

        def fix(m: re.Match) -> str:
            nonlocal got
            try:
                out = m[0].translate(back).encode("latin-1").decode("utf-8")
            except UnicodeError:
                return m[0]
            if len(out) < least or not all(map(_plausible, out)) or (codec == "cp1251" and not re.fullmatch("[Ѐ-џ]+", out)):
                return m[0]
            got += len(m[0])
            return out

        fixed = spans.sub(fix, text)
        if got >= 16 and least == 2:  # proven by longer spans, single sequences count as well
            least = 1
            fixed = spans.sub(fix, fixed)
        if got > gain:
            best, gain = fixed, got
    return best, gain


#: The characters that make up about half of any running text, by script.
USUAL = {
    "arabic": "اليمونرتب", "cyrillic": "оеаинтсрвл", "hangul": "이다는에의을가고한지로하사도리기인",
    "han": "的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没日于起还发成事只作当想看文无开手用主行方又如前所本见经公同三已老从动两长行分工產業經國會來對這時個們說為學過發與",
}
#: East Asian encodings: lead bytes, trail bytes, and what proves a decoding.
TWO_BYTES = {
    "shift_jis": ((0x81, 0xA0, 0xE0, 0xF0), (0x40, 0x7F, 0x80, 0xFD), "kana"),
    "euc_kr": ((0xA1, 0xFE), (0xA1, 0xFF), "hangul"),
    "gbk": ((0x81, 0xFF), (0x40, 0x7F, 0x80, 0xFF), "han"),
    "big5": ((0xA1, 0xFA), (0x40, 0x7F, 0xA1, 0xFF), "han"),
}
_HIGH = "À-ÿ"
#: Words that hold nothing but letters of the upper half of Latin-1, as Arabic read as Latin does.
_ARABIC_AS_LATIN = re.compile(f"(?<![A-Za-z{_HIGH}])[{_HIGH}ªŒœŠšŸŽžƒ]{{3,}}(?![A-Za-z])")
#: Letters that Turkish read as western Latin holds in place of its own.
_TURKISH_AS_LATIN = re.compile("[A-Za-zÀ-ÿ]*[ðýþÐÝÞ][A-Za-zÀ-ÿ]*")
#: Capitals within lower-case words, as western Latin read as a DOS code page holds.
_LATIN_AS_DOS = re.compile("[a-z][ÚÞÓÛÆÔÙÒÕØÍÊËÎ][a-z]|[A-Za-z][÷▀õ³][a-z]|[a-z]{2}[ÚÞÓÛ](?![A-Za-zÀ-ÿ])")
#: Question marks in place of letters: inside a word, and words of nothing else.
_MARK_IN_WORD = re.compile("[a-zà-ÿ]{2}\\?[a-z]{2}|\\b[ldnscjm]\\?[a-zà-ÿ]{2}")
_MARK_WORDS = re.compile("(?:(?<=\\s)|^)\\?{2,}(?=[\\s,.:]|$)")
#: Six two-byte sequences in a row, or Han that bytes of UTF-8 may hide in; and words that may be Cyrillic read wrongly.
_PAIRS = re.compile("(?:[\u0080-\u00ff‚-›€™Œ-žƒˆ˜][\x40-\x7e\u0080-\u00ff‚-›€™Œ-žƒˆ˜]){6}|[㐀-鿿]{3}")
_CYRILLIC_RUN = re.compile(f"[{_HIGH}]{{4}}|[А-яЁё]{{4}}")
_URL = re.compile("https?:\\S+|www\\.\\S+|[\\w-]+/\\S*\\?\\S+")


@lru_cache(1024)
def _from_dos(c: str) -> str:
    """The character of Windows-1252 whose byte the DOS code page 850 shows as ``c``."""
    try:
        return c if c.isascii() else c.encode("cp850").decode("cp1252")
    except UnicodeError:
        return c


def _recode(text: str, pattern: re.Pattern, written: str, read: str) -> str:
    def fix(m: re.Match) -> str:
        try:
            return m[0].encode(read).decode(written)
        except UnicodeError:
            return m[0]

    return pattern.sub(fix, text)


@lru_cache(None)
def _two_byte_spans(written: str, read: str):  # noqa: ANN202
    """Automaton over the characters of ``read`` for maximal runs of at least three two-byte sequences of ``written``."""
    chars = _byte_chars(read) | {b: chr(b) for b in range(0x80)}
    cls = lambda edges: "[" + "".join(re.escape(chars[b]) for a, z in zip(edges[::2], edges[1::2]) for b in range(a, z)) + "]"
    lead, trail, proof = TWO_BYTES[written]
    return re.compile(f"(?:{cls(lead)}{cls(trail)}){{3,}}"), {ord(c): b for b, c in chars.items()}, proof


def _usual(text: str, proof: str) -> float:
    """The share of a decoding's letters that are usual where ``proof`` is; 0 if too few are of that script at all."""
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return 0.0
    if proof == "kana":
        kana = sum("ぁ" <= c <= "ヿ" for c in letters) / len(letters)
        return kana if all("ぁ" <= c <= "ヿ" or "一" <= c <= "鿿" or c == "々" for c in letters) else 0.0
    if proof == "hangul" and sum("가" <= c <= "힣" for c in letters) < 0.9 * len(letters):
        return 0.0
    if proof == "han" and sum("一" <= c <= "鿿" for c in letters) < 0.9 * len(letters):
        return 0.0
    return sum(c in USUAL[proof] for c in letters) / len(letters)


#: Usual letters that prove a decoding, as a share: a third to a half of what running text has.
PROOF = {"kana": 0.3, "hangul": 0.12, "han": 0.12}


def _east_asian(text: str) -> tuple[str, bool]:
    """Two-byte text that was read as western Latin, by the encoding that explains most of it, if its usual characters prove it."""
    best, most = text, 0
    for written in TWO_BYTES:
        for read in ("latin-1", "cp1252"):
            spans, back, proof = _two_byte_spans(written, read)
            got: list[str] = []

            def fix(m: re.Match) -> str:
                try:
                    out = m[0].translate(back).encode("latin-1").decode(written)
                except UnicodeError:
                    return m[0]
                got.append(out)
                return out

            fixed = spans.sub(fix, text)
            told = "".join(got)
            if len(told) >= 6 and len(told) > most and _usual(told, proof) >= PROOF[proof]:
                best, most = fixed, len(told)
    # UTF-8 that was read as GBK: its characters go back to bytes that are well-formed again.
    def again(m: re.Match) -> str:
        try:
            return m[0].encode("gb18030").decode("utf-8")
        except UnicodeError:
            return m[0]

    fixed = re.sub("[㐀-鿿-]{3,}", again, text) if not most else text
    return (best, True) if most else (fixed, fixed != text)


def _cyrillic(text: str) -> tuple[str, bool]:
    """KOI8-R that was read as Windows-1251, and either read as western Latin: taken if usual letters become the rule."""
    now = _usual("".join(re.findall("[Ѐ-ӿ]", text)).lower(), "cyrillic")
    for written, read, pattern in (("koi8-r", "cp1251", "[А-яЁё]{2,}"), ("koi8-r", "latin-1", f"[{_HIGH}]{{3,}}"), ("cp1251", "latin-1", f"[{_HIGH}]{{3,}}")):
        words = re.findall(pattern, text)
        try:
            told = "".join(words).encode(read).decode(written)
        except UnicodeError:
            continue
        lower = sum(c.islower() for c in told)
        if len(told) >= 12 and all("Ѐ" <= c <= "ӿ" for c in told) and lower >= 0.7 * len(told) and _usual(told.lower(), "cyrillic") >= max(0.5, now + 0.15):
            return _recode(text, re.compile(pattern), written, read), True
    return text, False


def _arabic(text: str) -> tuple[str, int]:
    """Arabic that was read as western Latin, by the encoding that gives the better letters, and how many letters it holds."""
    best, most = text, 0
    for written, read in (("cp1256", "cp1252"), ("iso8859-6", "latin-1")):
        total = common = 0
        for m in _ARABIC_AS_LATIN.finditer(text):
            try:
                w = m[0].encode(read).decode(written)
            except UnicodeError:
                continue
            if all("ء" <= c <= "ے" for c in w):
                total += len(w)
                common += sum(c in USUAL["arabic"] for c in w)
        if total >= 4 and common * (2.5 if total >= 24 else 4) >= total and common > most:
            pattern = re.compile(f"[{_HIGH}¡ªº¿ŒœŠšŸŽžƒ]+")
            best, most = _recode(text, pattern, written, read), common
    return best, most


def repair(text: str | None) -> tuple[str | None, bool]:
    """(restored text as far as it can be, whether it was garbled)."""
    if not text or text.isascii() and "??" not in text and "?" not in text:
        return text, False
    found = False
    fixed, gain = _decode_spans(text)
    # Bytes that are UTF-8 prove themselves; what they leave unexplained is tried by what is usual.
    if _PAIRS.search(text) or _CYRILLIC_RUN.search(text):
        if 3 * gain < sum(c > "\x7f" for c in text):
            told, sure = _east_asian(text)
            if not sure:
                told, sure = _cyrillic(text)
            if sure:
                return told, True
    while True:  # each round makes the text shorter
        if not gain or gain < 2 * _arabic(text)[1]:
            break
        text, found = fixed, True
        fixed, gain = _decode_spans(text)
    if "�" in text or re.search("[\u0080-\u0084\u0086-\u009f]", text):
        found = True
    fixed, letters = _arabic(text)
    if letters:
        text, found = fixed, True
    hits = sum(len(re.findall("[ðýþÐÝÞ]", m[0])) for m in _TURKISH_AS_LATIN.finditer(text) if not _LATIN_AS_DOS.search(m[0])) if re.search("[ðýþÐÝÞ]", text) else 0
    if _LATIN_AS_DOS.search(text) and "ã" not in text:
        trial = "".join(_from_dos(c) for c in text)
        if re.search("[à-ü’ß]", trial) and not _LATIN_AS_DOS.search(trial):
            text, found, hits = trial, True, 0
    if hits >= 2 or hits and re.search("[a-z]ý|ý[a-z]|þ[a-z]|[a-z]ð", text) and re.search("ü|ö|ç", text):
        text, found = text.translate({0xF0: "ğ", 0xFD: "ı", 0xFE: "ş", 0xD0: "Ğ", 0xDD: "İ", 0xDE: "Ş"}), True
    if not found and "?" in text:
        bare = _URL.sub(" ", text)
        words = _MARK_WORDS.findall(bare)
        if len(_MARK_IN_WORD.findall(bare)) >= 1 or len(words) >= 3 and len({len(w) for w in words}) > 1:
            found = True
    return text, found


def suspect(value: Column) -> Column:
    return F.coalesce(value.rlike(SUSPECT), F.lit(False))


def garbled_fields(articles: DataFrame, fields: tuple[str, ...] = ("title", "content"), key: str = "id") -> DataFrame:
    """(article_id, field, restored): the garbled fields of each article, and their text restored as far as possible.

    Only texts with a sign of it leave the JVM; one pass, then the few hits are made distinct.
    """
    # One row per suspect field; the unsuspected ones become null before the texts are copied.
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.when(suspect(F.col(f)), F.col(f)).alias("value")) for f in fields])
    rows = articles.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.inline(F.filter(parts, lambda p: p["value"].isNotNull())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                fixed, bad = repair(t)
                if bad:
                    at.append(i)
                    out.append(fixed)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(out, pa.string())], ["article_id", "field", "restored"])

    kind = articles.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"article_id {kind}, field string, restored string").dropDuplicates(["article_id", "field"])
