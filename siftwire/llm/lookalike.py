"""Text that looks the same but differs in its characters, brought to one form.

Compatibility normalisation (what a reader cannot tell apart only: widths, presentation forms, ligatures, blanks, composed and
combining accents), deletion of ignorable characters, then a look-alike lattice: every letter of a token that has doubles in
another script stands for all of them, and Viterbi picks the path that a script-consistent character bigram model likes best.
The score of a path never depends on which of the doubles was written, so tokens that look the same come out the same.

Defined results: null and blank texts have no form; raised digits, digits of other scripts, case, accents and hamza are kept;
line breaks are kept, every other blank becomes a space; texts of any length are handled whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters drawn alike, as strings of (Latin, Cyrillic, Greek); a blank where a script has none.
DOUBLES = (
    "A\u0410\u0391 B\u0412\u0392 C\u0421\u03f9 E\u0415\u0395 H\u041d\u0397 I\u0406\u0399 J\u0408\u037f K\u041a\u039a M\u041c\u039c N_\u039d O\u041e\u039f P\u0420\u03a1 S\u0405_ T\u0422\u03a4 X\u0425\u03a7 Y\u04ae\u03a5 Z_\u0396 G\u050c_ Q\u051a_ W\u051c_ "
    "a\u0430\u03b1 c\u0441\u03f2 e\u0435_ i\u0456\u03b9 j\u0458\u03f3 o\u043e\u03bf p\u0440\u03c1 s\u0455_ x\u0445\u03c7 y\u0443\u03b3 v\u0475\u03bd d\u0501_ h\u04bb_ q\u051b_ w\u051d_ l\u04cf_ g\u0261_ "
).split()
_SCRIPTS = 3
#: Ignorable characters: no width, no ink.
_GONE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
_GONE_RE = re.compile(f"[{_GONE}]")
#: Every blank that takes room, except line breaks.
_BLANK_RE = re.compile("[\t\u000b\u000c\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_BREAK_RE = re.compile("\r\n?|[\u0085\u2028\u2029]")
#: Characters whose compatibility form looks the same: full and half width, Arabic presentation forms, Latin ligatures,
#: the dot leader and the letters of mathematical fonts are left to the table of Unicode; raised and lowered ones are not.
_FORM_RE = re.compile("[\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\ufb00-\ufb06\ufb50-\ufdff\ufe70-\ufefc\uff01-\uffdc\uffe0-\uffee\u2024-\u2026\u2000-\u200a\u0675-\u0678]+")
#: Persian yeh and kaf, which are drawn as the Arabic ones wherever they join the next letter.
_JOINED_RE = re.compile("[\\u06cc\\u06a9](?=[\\u0621-\\u064a\\u066e-\\u06d3])")
#: Texts of these characters alone are their own form.
_PLAIN_RE = re.compile("[\\n -~\\u00a1-\\u00ac\\u00ae-\\u00b6\\u00b8-\\u017f\\u060c\\u061b\\u061f\\u0621-\\u063a\\u0641-\\u064a\\u0660-\\u0669\\u067e\\u0686\\u0698\\u06af\\u06f0-\\u06f9\\u2013\\u2014\\u2018\\u2019\\u201c-\\u201e\\u20ac]*")
_ALT: dict[str, tuple[str, str, str]] = {}
for _d in DOUBLES:
    for _c in _d:
        if _c not in "_":
            _ALT.setdefault(_c, tuple(_d))
_FOREIGN = "".join(sorted({c for d in DOUBLES for c in d[1:] if c != "_"}))
_FOREIGN_RE = re.compile(f"[{re.escape(_FOREIGN)}]")
_TOKEN_RE = re.compile("[A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u052f\u0261]+")
#: The model's alphabet: Latin to Cyrillic.
ALPHABET = 0x530
#: Bits that a change of script within a word costs, and that a word costs which is not in the script of its text.
SWITCH, ALIEN = 24.0, 6.0


def fold(text: str) -> str:
    """The text without what no reader can see: composed, one kind of blank, no ignorable characters, no presentation forms,
    Arabic yeh and kaf for the Persian ones within words."""
    t = _GONE_RE.sub("", text)
    t = _FORM_RE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
    t = unicodedata.normalize("NFC", _BLANK_RE.sub(" ", _BREAK_RE.sub("\n", t)))
    return _JOINED_RE.sub(lambda m: "\u064a" if m[0] == "\u06cc" else "\u0643", t)


def _script(c: str) -> int:
    o = ord(c)
    return 1 if 0x400 <= o < 0x530 else 2 if 0x370 <= o < 0x400 else 0


class Lattice:
    """Viterbi over the doubles of a token's letters."""

    def __init__(self, bigrams: dict[tuple[int, int], int]):
        """``bigrams``: counts of character pairs within words of the corpus; character 0 stands for the word's edge."""
        total: dict[int, int] = {}
        for (a, _), n in bigrams.items():
            total[a] = total.get(a, 0) + n
        self._cost = {k: math.log2((total[k[0]] + ALPHABET / 8) / (n + 1 / 8)) for k, n in bigrams.items()}
        self._new = {a: math.log2((n + ALPHABET / 8) * 8) for a, n in total.items()}
        self._unseen = math.log2(ALPHABET)
        self._done: dict[tuple[str, int], str] = {}

    def _step(self, a: str, b: str) -> float:
        x, y = ord(a) if a else 0, ord(b) if b else 0
        cost = self._cost.get((x, y))
        return cost if cost is not None else self._new.get(x, self._unseen)

    def best(self, token: str, home: int) -> str:
        """The form of a token in a text whose script is ``home``."""
        # The doubles of each letter decide, not the letter: the key is the first of them.
        key = ("".join(next(x for x in _ALT[c] if x != "_") if c in _ALT else c for c in token), home)
        out = self._done.get(key)
        if out is None:
            if len(self._done) > 200_000:
                self._done.clear()
            out = self._done[key] = self._viterbi(key[0], home)
        return out

    def _viterbi(self, token: str, home: int) -> str:
        layer = {("", home): (0.0, "")}
        for at, c in enumerate(token):
            options = [(x, s) for s, x in enumerate(_ALT[c]) if x != "_"] if c in _ALT else [(c, _script(c))]
            nxt = {}
            for x, s in options:
                nxt[x, s] = min(
                    (cost + self._step(a, x) + (0 if s == sa else ALIEN if not at else SWITCH), path + x)
                    for (a, sa), (cost, path) in layer.items()
                )
            layer = nxt
        return min((cost + self._step(a, ""), path) for (a, _), (cost, path) in layer.items())[1]

    def form(self, text: str) -> str:
        """``text`` in the one form of all texts that look like it."""
        if _PLAIN_RE.fullmatch(text):
            return text
        t = fold(text)
        if not _FOREIGN_RE.search(t):
            return t
        # The text's script: that of the letters which have no double.
        sure = [0] * _SCRIPTS
        for m in _TOKEN_RE.finditer(t):
            for c in m[0]:
                if c not in _ALT:
                    sure[_script(c)] += 1
        home = max(range(_SCRIPTS), key=lambda s: (sure[s], -s))  # Latin where nothing tells
        return _TOKEN_RE.sub(lambda m: self.best(m[0], home), t)


def bigram_counts(rows: DataFrame, fields: tuple[str, ...]) -> dict[tuple[int, int], int]:
    """Counts of the character pairs within words over all texts; at most ALPHABET^2 numbers, summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET * ALPHABET, np.int64)
        letter = np.zeros(0x110000, bool)
        letter[[i for i in range(ALPHABET) if chr(i).isalpha()]] = True
        for b in batches:
            for col in b.columns:
                texts = [t for t in col.to_pylist() if t]
                for at in range(0, len(texts), 512):
                    codes = np.frombuffer("\n".join(texts[at : at + 512]).encode("utf-32-le", "surrogatepass"), np.uint32)
                    codes = np.where(letter[codes], codes, 0).astype(np.int64)
                    pairs = codes[:-1] * ALPHABET + codes[1:]
                    total += np.bincount(pairs[pairs > 0], minlength=total.size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    got = rows.select(*fields).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {divmod(r.pair, ALPHABET): r.n for r in got.collect()}


#: Rows of one spelling that are expanded together, about.
SPLIT = 10_000


def forms(articles: DataFrame, fields: tuple[str, ...] = ("title", "content"), key: str = "id") -> DataFrame:
    """(key, field, form, same, raw): hashes of the form and of the text as written, of every field that is not blank.

    ``form`` and ``raw`` are the first 16 bytes of SHA-256; texts with equal ``form`` look the same.
    """
    rows = articles.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(f).alias(f"t{i}") for i, f in enumerate(fields)])
    counts = rows.sparkSession.sparkContext.broadcast(bigram_counts(rows, tuple(f"t{i}" for i in range(len(fields)))))
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        lattice = Lattice(counts.value)
        digest = lambda t: sha256(t.encode("utf-8", "surrogatepass")).digest()[:16]
        for b in batches:
            keys, field, at, form, raw = b.column(0), [], [], [], []
            for f, name in enumerate(names):
                for i, t in enumerate(b.column(1 + f).to_pylist()):
                    if t is None or not t.strip():
                        continue
                    out = lattice.form(t)
                    if not out.strip():
                        continue
                    at.append(i)
                    field.append(name)
                    raw.append(digest(t))
                    form.append(raw[-1] if out == t else digest(out))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], ["key", "field", "form", "raw"])

    kind = articles.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, field string, form binary, raw binary")


def lookalike_pairs(articles: DataFrame, fields: tuple[str, ...] = ("title", "content"), key: str = "id") -> DataFrame:
    """(field, id_a, id_b): articles whose values in a field look the same but are not the same characters.

    Spellings of one form are paired first, each pair once; only then does a pair become pairs of its rows.  Rows equal in their
    characters never meet, not even as candidates, so a form with a million equal rows and an odd one costs a million steps.  Rows
    are spread by their own hash before the second step, not by the spelling, so a hot spelling is no hot task.
    """
    from ..context import cut

    f = cut(forms(articles, fields, key).dropDuplicates(["key", "field", "raw"]))
    spelt = f.groupBy("field", "form", "raw").agg(F.count("*").alias("n"))
    mixed = spelt.groupBy("field", "form").agg(F.count("*").alias("k")).filter("k > 1").select("field", "form")
    # Written: the few rows of forms with several spellings are all that is needed from here on.
    g = cut(f.join(mixed, ["field", "form"], "left_semi"))
    s = g.groupBy("field", "form", "raw").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    a, b = (s.select("field", "form", F.col("raw").alias(f"raw_{x}"), F.col("parts").alias(f"parts_{x}")) for x in "ab")
    pairs = a.join(b, ["field", "form"]).filter("raw_a < raw_b")
    # Each pair of spellings as pairs of parts of at most about SPLIT rows.
    pairs = pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    rows = g.join(s, ["field", "form", "raw"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    x, y = (rows.select("field", "form", F.col("raw").alias(f"raw_{i}"), F.col("part").alias(f"part_{i}"), F.col("key").alias(f"id_{i}")) for i in "ab")
    out = pairs.join(x, ["field", "form", "raw_a", "part_a"]).join(y, ["field", "form", "raw_b", "part_b"])
    return out.select("field", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).filter("id_a < id_b").distinct()
