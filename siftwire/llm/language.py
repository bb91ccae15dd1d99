"""Missing and wrong language labels: prediction by partial matching.

One byte context tree per language, of variable order within a word, holds frozen counts; the exact code length of a word is the sum
over its bytes of the escape from the longest known context and of the byte in the context that knows it (method C, order -1 is
uniform).  Contexts do not reach over the edge of a word, so the code length of a line is the sum over its words, and each worker
remembers those of recurring words.  Code lengths are exact, whatever a word weighs; so that foreign names and short quotations do not
turn a line, most of its words must be shorter in the other language as well.

The trees are fitted on a bounded sample of labelled rows: the SAMPLE articles of each language with the smallest hash of their
id.  As labels are partly wrong, the trees are fitted twice, the second time on the articles and lines that the first trees confirm.

Defined results: null and blank contents, texts without letters and texts that have lost most of them have no language; repeated rows give one row; contents of any
length are read whole; labels of unknown languages are wrong if the text is of a known one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boilerplate import ALONE, INSIDE, LINKED, SCRIPT, TERMINAL, text_lines

LANGUAGES = ("ar", "de", "en", "fa", "fr", "tr")
#: Notations of language labels beside the ISO 639-1 code, by language.
NOTATIONS = {
    "ar": "ara arabic arabe arabisch عربي عربى العربية arapça عربی",
    "de": "deu ger german allemand deutsch almanca آلمانی",
    "en": "eng english anglais englisch إنجليزي انجليزي الإنجليزية ingilizce انگلیسی",
    "fa": "fas per persian farsi persan persisch فارسي فارسی farsça",
    "fr": "fra fre french français francais französisch فرنسي الفرنسية fransızca فرانسوی",
    "tr": "tur turkish turc türkisch تركي التركية türkçe turkce ترکی",
}
#: Articles of each language that the trees are fitted on, at most.
SAMPLE = 300
#: Bytes of context, at most.
ORDER = 5
#: Bits per word, and for a line in all, by which another language must be shorter than the article's for a line to be in it.
MARGIN, LEAST = 4.0, 24.0
#: Share of a line's words that must be shorter in another language, by a bit at least, for the line to be in it.
MOST = 0.5
_REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def label_language(label: Column) -> Column:
    """The language that a label names, in any usual notation; null for none and for languages not in LANGUAGES."""
    main = F.lower(F.trim(F.regexp_replace(label, "[-_].*$", "")))
    known = {n: k for k, names in NOTATIONS.items() for n in (k, *names.split())}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), main)


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def damaged(text: str) -> bool:
    """Whether a text holds more lost letters (question marks, replacement characters) than letters: its language cannot be told."""
    lost = text.count("?") + text.count("\ufffd")
    return lost >= 8 and lost > sum(map(str.isalpha, text))


class Tree:
    """Byte contexts of one language with their counts, frozen after fitting."""

    def __init__(self) -> None:
        self.counts: dict[bytes, dict[int, int]] = {}

    def add(self, word: bytes, n: int = 1) -> None:
        w = b" " + word + b" "
        for i in range(1, len(w)):
            for k in range(min(ORDER, i) + 1):
                seen = self.counts.setdefault(w[i - k : i], {})
                seen[w[i]] = seen.get(w[i], 0) + n

    def freeze(self) -> dict[bytes, tuple[float, dict[int, float]]]:
        """By context: bits of an escape, bits of each byte seen."""
        out = {}
        for c, seen in self.counts.items():
            total = sum(seen.values()) + len(seen)
            out[c] = (math.log2(total / len(seen)), {b: math.log2(total / n) for b, n in seen.items()})
        return out


def code_length(tree: dict[bytes, tuple[float, dict[int, float]]], word: bytes) -> float:
    """Bits of a word, its end included."""
    w, bits = b" " + word + b" ", 0.0
    for i in range(1, len(w)):
        for k in range(min(ORDER, i), -1, -1):
            node = tree.get(w[i - k : i])
            if node is None:
                continue
            b = node[1].get(w[i])
            if b is not None:
                bits += b
                break
            bits += node[0]
        else:
            bits += 8.0
    return bits


class Scorer:
    """Code lengths of lines in all languages."""

    def __init__(self, trees: dict[str, dict]):
        self.names = list(trees)
        self._trees = [trees[n] for n in self.names]
        self._known: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        v = self._known.get(w)
        if v is None:
            b = w.encode("utf-8", "surrogatepass")
            bits = np.array([code_length(t, b) for t in self._trees])
            v = bits - bits.min()
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            self._known[w] = v
        return v

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits by line and language above the best of each word, words by line, the same bits by word)."""
        parts = [words(t) for t in texts]
        n = np.array([len(p) for p in parts], np.int64)
        flat = [w for p in parts for w in p]
        out, per = np.zeros((len(texts), len(self.names))), np.zeros((0, len(self.names)))
        if flat:
            coded = pa.array(flat, pa.string()).dictionary_encode()
            costs = np.stack([self.word(w) for w in coded.dictionary.to_pylist()])
            per = costs[coded.indices.to_numpy()]
            some = np.flatnonzero(n)
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            out[some] = np.add.reduceat(per, starts, axis=0)
        return out, n, per


def _posterior(bits: np.ndarray) -> np.ndarray:
    p = np.exp2(-(bits - bits.min(axis=-1, keepdims=True)))
    return p / p.sum(axis=-1, keepdims=True)


def fit(articles: DataFrame, key: str = "id", label: str = "language", content: str = "content", sample: int = SAMPLE) -> dict[str, dict]:
    """Frozen trees of LANGUAGES, from at most ``sample`` labelled articles of each."""
    named = articles.filter(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("key"), label_language(F.col(label)).alias("said")).filter("said is not null").distinct()
    first = named.withColumn("at", F.row_number().over(Window.partitionBy("said").orderBy(F.xxhash64("key"), "key"))).filter(F.col("at") <= sample).select("key", "said")
    # At most ``sample`` ids a language: small enough to broadcast, whatever the table's size.
    got = articles.select(F.col(key).alias("key"), F.col(content).alias("content")).join(F.broadcast(first), "key").select("key", "said", "content").collect()
    told: dict[tuple[str, str], list[str]] = {}
    for r in sorted(got, key=lambda r: (r.said, r.key)):
        told[r.said, r.key] = [t for _, t, f in text_lines(r.content) if f & TERMINAL and f & INSIDE and not f & (LINKED | SCRIPT)]
    trees = _grow({(said, t): None for (said, _), ts in told.items() for t in ts})
    scorer = Scorer(trees)
    right: dict[tuple[str, str], None] = {}
    for (said, _), ts in told.items():
        bits, n, _ = scorer.lines(ts)
        if n.sum() and scorer.names[bits.sum(axis=0).argmin()] == said:
            own = bits[:, scorer.names.index(said)]
            right |= {(said, t): None for t, b, best, m in zip(ts, own, bits.min(axis=1), n) if b - best < MARGIN / 2 * m}
    return _grow(right) if {s for s, _ in right} == {s for s, _ in told} else trees


def _grow(lines: dict[tuple[str, str], None]) -> dict[str, dict]:
    """Trees of the lines of each language.  Words that stand in the lines of several scripts (names) count once each."""
    trees = {n: Tree() for n in LANGUAGES}
    counted: dict[tuple[str, str], int] = {}
    for said, t in lines:
        for w in words(t):
            counted[said, w] = counted.get((said, w), 0) + 1
    for (said, w), n in counted.items():
        trees[said].add(w.encode("utf-8", "surrogatepass"), n)
    return {n: t.freeze() for n, t in trees.items() if t.counts} or {"und": {}}


def segments(articles: DataFrame, key: str = "id", label: str = "language", content: str = "content") -> DataFrame:
    """(article_id, line_no, lang, confidence, label): the main language of each article (line_no 0), and each line of its story
    that is mainly in another one (line_no from 1).  ``label`` is the language that the label names, null where it names none.

    A line's language is the one with the shortest code; the main one is that of most words.  Confidence is the posterior of the
    code lengths, for an article averaged over its words.
    """
    trees = articles.sparkSession.sparkContext.broadcast(fit(articles, key, label, content))
    rows = articles.filter(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"), label_language(F.col(label)).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(trees.value)
        names = np.array(scorer.names)
        for b in batches:
            at, no, flags, texts = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if damaged(t):
                    continue
                for n, text, f in text_lines(t):
                    if text:
                        at.append(i)
                        no.append(n)
                        flags.append(f)
                        texts.append(text)
            bits, n_words, per = scorer.lines(texts)
            at, no, flags = np.array(at, np.int64), np.array(no, np.int64), np.array(flags, np.int64)
            post = _posterior(bits) if len(texts) else bits
            best = bits.argmin(axis=1) if len(texts) else np.zeros(0, np.int64)
            story = ((flags & TERMINAL) != 0) & ((flags & INSIDE) != 0) & ((flags & (LINKED | SCRIPT)) == 0)
            # The story's lines decide; an article without any is judged by all its lines.
            told = np.bincount(at[story & (n_words > 0)], minlength=b.num_rows) > 0
            counts = np.where(story | ~told[at], n_words, 0) if len(at) else n_words
            weight = np.zeros((b.num_rows, len(names)))
            np.add.at(weight, (at, best), counts)
            belief = np.zeros((b.num_rows, len(names)))
            np.add.at(belief, at, post * counts[:, None])
            total = weight.sum(axis=1)
            main = weight.argmax(axis=1)
            own = np.flatnonzero(total > 0)
            lead = bits[np.arange(len(at)), main[at]] - bits.min(axis=1) if len(at) else n_words
            # Words of each line that the best language has shorter than the article's.
            line = np.repeat(np.arange(len(n_words)), n_words)
            votes = np.bincount(line[per[np.arange(len(line)), best[line]] + 1 <= per[np.arange(len(line)), main[at[line]]]], minlength=len(n_words)) if len(line) else n_words
            other = np.flatnonzero(story & (n_words >= 3) & (lead >= LEAST) & (lead >= MARGIN * n_words) & (votes >= MOST * n_words) & ((flags & ALONE) == 0))
            index = np.concatenate([own, at[other]]).astype(np.int64)
            lang = np.concatenate([names[main[own]], names[best[other]]])
            sure = np.concatenate([belief[own, main[own]] / total[own], post[other, best[other]] if len(other) else np.zeros(0)])
            take = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(np.concatenate([np.zeros(len(own), np.int64), no[other]])), pa.array(lang.tolist(), pa.string()), pa.array(sure, pa.float64()), b.column(2).take(take)],
                ["article_id", "line_no", "lang", "confidence", "label"],
            )

    kind = articles.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"article_id {kind}, line_no bigint, lang string, confidence double, label string").dropDuplicates(["article_id", "line_no"])


def mislabelled(articles: DataFrame, key: str = "id", label: str = "language", content: str = "content") -> DataFrame:
    """(article_id, line_no, lang): articles whose label is missing or wrong (line_no 0), and lines in another language."""
    return segments(articles, key, label, content).filter("lang != 'und' and (line_no > 0 or label is null or label != lang)").select("article_id", "line_no", "lang")
