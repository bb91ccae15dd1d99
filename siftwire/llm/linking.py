"""Variant spellings of organisations and people, linked to a register.

Suffix blocking: every token of a name is indexed by its suffixes of at least MIN_SUFFIX characters, read forwards and backwards, so
that one slip anywhere leaves a common suffix; suffixes shared by more than COMMON entries are kept only together with the initial
of another field (the brand, the given name).  Mentions are made distinct first; those that share a key with an entry are compared
with it by longest-common-subsequence ratios, field by field: brand and line of business of an organisation, given name and
surname of a person.  A mention that fits several entries equally well is linked to none, unless they are one entity.

Short and pet forms of given names are an optional dimension (``nicknames``, by default NICKNAMES); without it, only forms that
are written or sound alike are linked.

Defined results: null and blank mentions and entries are no names; repeated rows and elements give one row; names of any length are
compared whole; an empty register links nothing.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import cut
from .lookalike import fold

MIN_SUFFIX, COMMON = 3, 8
#: Ratios from which fields are taken for the same.
SAME_BRAND, SAME_WORD, SAME_SURNAME, SAME_GIVEN = 0.75, 0.8, 0.78, 0.74
#: Scores this close to the best are as good.
NEAR = 0.015
#: Words that say nothing about which organisation is meant.
GENERIC = set("the al el co company grp group egypt llc sae inc ltd plc corp jsc شركه مجموعه ش م".split())
#: Forms of address.
ADDRESS = set("dr eng mr mrs ms miss prof sir د م ا أ دكتور الدكتور مهندس المهندس استاذ الاستاذ السيد السيده دكتوره الدكتوره".split())
#: Short and pet forms of given names, by name.
NICKNAMES = {
    "ahmed": "hamada ahmad meedo mido", "alexander": "alex sandy sasha", "elizabeth": "liz beth lizzie betty eliza", "fatma": "fatema fatemah fatima fatimah batta tota",
    "heba": "hiba hoba bibo", "hossam": "husam hosam hos", "ibrahim": "hima heema ebrahim", "katherine": "kate kathy katie catherine kat", "khaled": "khalid loodi lolo",
    "mahmoud": "mahmood hoda hooda", "mariam": "maryam mero miriam mimi", "michael": "mike mikey mick", "mohamed": "muhammad mohammed mohammad moody hamo hamada mido meedo", "mostafa": "moustafa mustafa sasa darsh",
    "nourhan": "nour nora nony nona", "robert": "rob bob bobby robbie", "salma": "soly sally", "sherif": "shereef shero sharif shico", "tarek": "tariq tarik tito roka", "william": "will bill billy liam",
    "yasmine": "yasmin jasmine yassy", "youssef": "joe jo yousef yusuf yosef joseph",
}


def lcs_ratio(a: str, b: str) -> float:
    """2 |LCS| / (|a| + |b|), bit-parallel."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 2 * _lcs(a, b) / (len(a) + len(b))


def _lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = masks.get(c, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


_SOUND = [("ph", "f"), ("kh", "k"), ("ch", "k"), ("sh", "s"), ("ee", "i"), ("oo", "u"), ("ou", "u"), ("q", "k"), ("c", "k"), ("w", "u"), ("v", "f"), ("z", "s"), ("y", "i"), ("e", "i"), ("o", "u")]


@lru_cache(100_000)
def _sound(w: str) -> str:
    for a, b in _SOUND:
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


@lru_cache(400_000)
def alike(a: str, b: str) -> float:
    """How alike two words are, as written or as they sound.  What only sounds alike counts a little less."""
    r = lcs_ratio(a, b)
    return r if r > 0.9 or not a.isascii() else max(r, 0.97 * lcs_ratio(_sound(a), _sound(b)))


@lru_cache(100_000)
def tokens(name: str) -> tuple[str, ...]:
    """Words of a name: folded, without accents and hyphens; dotted letters are one word from three on, else initials."""
    t = fold(name)
    if re.search("[a-z][A-Z]", t) and " " not in t.strip():
        t = re.sub("(?<=[a-z])(?=[A-Z])", " ", t)
    t = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c) and c != "ـ")
    t = t.translate(str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ه", "ی": "ي", "ک": "ك", "ؤ": "و", "ئ": "ي", "'": "", "’": "", "`": ""}))
    t = re.sub(r"\b((?:[^\W\d_]\.){2,})", lambda m: m[1].replace(".", " " if len(m[1]) == 4 else "") + " ", t)
    return tuple(re.findall(r"\w+", t))


def suffix_keys(words: tuple[str, ...], longest: int | None = None) -> set[str]:
    """Suffixes of each word, and of each word read backwards, marked by direction; none beyond ``longest`` characters, if given."""
    out = set()
    for w in words:
        most = len(w) if longest is None else min(len(w), longest)
        for k in range(min(MIN_SUFFIX, len(w)), most + 1):
            out.add(">" + w[-k:])
            out.add("<" + w[:k])
    return out


def initials(words: tuple[str, ...]) -> set[str]:
    return {w[0] for w in words}


def acronym_of(name: str) -> str | None:
    """The letters of a mention that is an acronym."""
    bare = re.sub(r"[.\s]", "", fold(name))
    return bare.lower() if re.fullmatch("[A-Z]{3,6}", bare) else None


# --- Entries -----------------------------------------------------------------------------------------------------------


def organisation(names: list[str], lines: set[str]) -> dict:
    """An entry from an organisation's name and aliases.  ``lines``: words of lines of business."""
    out = {"kind": "c", "brand": "", "line": [], "ar": [], "acronyms": [], "initials": ""}
    first = names[0]
    words = tokens(first)
    latin = [w for w in words if w.isascii()]
    if latin:
        rest = [w for w in latin if w not in GENERIC]
        brand = [w for w in rest if not _of_line(w, lines)] or rest[:1] or latin[:1]
        out["brand"] = brand[0]
        out["line"] = [w for w in rest if w != brand[0]]
        ordered = [brand[0], *[w for w in latin if w != brand[0]]]
        out["initials"] = "".join(w[0] for w in ordered)
    for n in names:
        a = acronym_of(n)
        if a:
            out["acronyms"].append(a)
        w = [x for x in tokens(n) if x not in GENERIC]
        if w and not w[0].isascii():
            out["ar"].append([w[0], "".join(w[1:])])
    return out


def person(full: str, arabic: str | None, nicknames: dict[str, str] = NICKNAMES) -> dict:
    w = _joined(tokens(full))
    out = {"kind": "p", "given": w[0] if len(w) > 1 else "", "middle": w[1:-1], "surname": w[-1] if w else "", "ar": []}
    out["short"] = nicknames.get(out["given"], "").split()
    a = _joined(tokens(arabic or ""))
    if a:
        out["ar"] = [a[0] if len(a) > 1 else "", a[-1]]
    return out


def _joined(words) -> list[str]:
    """Words with a detached article put back to its name."""
    out: list[str] = []
    for w in words:
        if out and out[-1] in ("el", "al", "ال"):
            out[-1] += w
        else:
            out.append(w)
    return out


@lru_cache(100_000)
def _abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is ``word`` with letters left out."""
    return 2 <= len(short) < len(word) and short[0] == word[0] and _lcs(short, word) == len(short)


def _of_line(w: str, lines: set[str]) -> bool:
    return w in lines or any(_abbreviates(w, x) and len(w) <= 6 or alike(w, x) >= 0.85 for x in lines)


# --- Comparison --------------------------------------------------------------------------------------------------------


def _line_score(words: list[str], line: list[str]) -> float:
    """How well the words of a mention cover a line of business, each word once; 0 if one is left over or most are missing."""
    left, got = list(line), []
    for w in words:
        best = max(((1.0 if _abbreviates(w, x) else alike(w, x), x) for x in left), default=(0.0, ""))
        if best[0] < SAME_WORD:
            return _squashed("".join(words), "".join(line))
        got.append(best[0])
        left.remove(best[1])
    covered = sum(map(len, line)) - sum(map(len, left))
    if 2 * covered < sum(map(len, line)):
        return 0.0
    return sum(got) / len(got) - 0.02 * len(left)


def _squashed(a: str, b: str) -> float:
    r = lcs_ratio(a, b)
    return r if r >= 0.87 else 0.9 if a and b and _abbreviates(a, b) and len(a) >= 5 else 0.0


def _split_score(s: str, head: str, tail: str, least: float) -> float:
    """How well ``s`` is ``head`` and ``tail`` run together, wherever the seam is."""
    if not head:
        return 0.0
    best = 0.0
    for k in range(max(1, len(head) - 2), min(len(s), len(head) + 2) + 1):
        h = alike(s[:k], head)
        if h < least:
            continue
        if not tail:
            best = max(best, h if k == len(s) else 0.0)
        elif k < len(s):
            t = lcs_ratio(s[k:], tail)
            if t >= 0.8:
                best = max(best, (h * len(head) + t * len(tail)) / (len(head) + len(tail)))
    return best


def score_organisation(mention: str, e: dict) -> float:
    acr = acronym_of(mention)
    if acr:
        if acr in e["acronyms"]:
            return 0.95
        if len(acr) >= 3 and acr == e["initials"]:
            return 0.9
    words = [w for w in tokens(mention) if w not in GENERIC] or list(tokens(mention))
    if not words:
        return 0.0
    best = 0.0
    if e["brand"] and any(w.isascii() for w in words):
        for i, w in enumerate(words):
            b = alike(w, e["brand"])
            if b < SAME_BRAND:
                continue
            rest = words[:i] + words[i + 1 :]
            if not rest:
                best = max(best, 0.9 * b)
            elif e["line"]:
                line = _line_score(rest, e["line"])
                if line:
                    best = max(best, 0.5 * b + 0.5 * line)
        if not best:
            s, line = "".join(words), "".join(e["line"])
            best = max(_split_score(s, e["brand"], line, SAME_BRAND) if line else 0.0, _split_score(s[::-1], e["brand"][::-1], line[::-1], SAME_BRAND) if line else 0.0) * 0.98
    if not all(w.isascii() for w in words):
        s = "".join(words)
        for brand, rest in e["ar"]:
            whole = _split_score(s, brand, rest, SAME_BRAND)
            turned = _split_score(s[::-1], brand[::-1], rest[::-1], SAME_BRAND) if rest else 0.0
            alone = 0.9 * alike(s, brand) if alike(s, brand) >= 0.8 and not rest else 0.0
            best = max(best, whole, turned, alone)
        if not best and e["ar"]:
            best = max((0.88 * alike(s, b) for b, _ in e["ar"] if alike(s, b) >= 0.82), default=0.0)
    return best


def _given_score(w: str, given: str, names: list[str]) -> float:
    if not given:
        return 0.0
    if len(w) == 1:
        return 0.85 if w == given[0] else 0.0
    if w in names:
        return 0.95
    r = max([alike(w, given), *[0.95 * lcs_ratio(w, n) for n in names if len(n) > 4]])
    return r if r >= SAME_GIVEN else 0.0


def score_person(mention: str, e: dict) -> float:
    raw = _joined(tokens(mention))
    words = [w for w in raw if w not in ADDRESS or (len(w) == 1 and w.isascii())]
    addressed = len(words) < len(raw)
    if not words:
        return 0.0
    if not words[-1].isascii():
        if not e["ar"]:
            return 0.0
        given, surname = e["ar"]
        s = "".join(words)
        best = max(_split_score(s, given, surname, SAME_GIVEN), _split_score(s[::-1], given[::-1], surname[::-1], SAME_GIVEN))
        if not best and len(words) == 1 and addressed and alike(words[0], surname) >= SAME_SURNAME:
            best = 0.8 * alike(words[0], surname)
        return best
    best = 0.0
    for i, w in enumerate(words):
        s = alike(w, e["surname"])
        if s < SAME_SURNAME or len(w) < 3:
            continue
        rest = [x for x in words[:i] + words[i + 1 :]]
        # Dotted initials came as one word.
        rest = [y for x in rest for y in (x if len(x) == 2 and x[0] == e["given"][:1] and not _given_score(x, e["given"], e["short"]) else [x])]
        if not rest:
            if addressed:
                best = max(best, 0.8 * s)
            continue
        g, at = max((_given_score(x, e["given"], e["short"]), -j) for j, x in enumerate(rest))
        if not g:
            continue
        others = rest[:-at] + rest[-at + 1 :]
        if all(len(x) == 1 or any(alike(x, m) >= 0.7 for m in e["middle"]) for x in others):
            best = max(best, 0.5 * s + 0.5 * g)
    if not best and len(words) == 1 and e["given"]:
        best = 0.97 * _split_score(words[0], e["given"], e["surname"], SAME_GIVEN)
    return best


def score(mention: str, e: dict) -> float:
    return score_organisation(mention, e) if e["kind"] == "c" else score_person(mention, e)


# --- Plans -------------------------------------------------------------------------------------------------------------


def line_words(competitors: DataFrame, least: int = 3) -> set[str]:
    """Words that stand in the names of at least ``least`` organisations and lead few of them: their lines of business.

    Organisations are told apart by the beginnings of their other words, so one that is entered again, misspelled or not, counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n in b.column(0).to_pylist():
                own = [w for w in dict.fromkeys(tokens(n or "")) if w not in GENERIC]
                out += [(w, " ".join(sorted(x[:2] for x in own if x != w)), i == 0) for i, w in enumerate(own)]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())], ["word", "others", "leads"])

    got = competitors.select("name").mapInArrow(run, "word string, others string, leads boolean").groupBy("word", "others").agg(F.min("leads").alias("leads"))
    got = got.groupBy("word").agg(F.count("*").alias("n"), F.count_if("leads").alias("leading")).filter((F.col("n") >= least) & (2 * F.col("leading") <= F.col("n")))
    return {r.word for r in got.collect()}


def entries(competitors: DataFrame, people: DataFrame | None, lines: set[str], nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(entity, rank, entry, keys, initial): the register's rows, prepared for comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for entity, rank, names in zip(*[c.to_pylist() for c in b.columns]):
                names = [n for n in names if n and n.strip()]
                if not names:
                    continue
                if entity[0] == "c":
                    e = organisation(names, lines)
                    words = tuple(w for n in names for w in tokens(n))
                    first = {e["brand"][:1], *[x[0][:1] for x in e["ar"]]} - {""}
                    keys = suffix_keys(words) | {"@" + a for a in {*e["acronyms"], e["initials"]} if a}
                else:
                    e = person(names[0], names[1] if len(names) > 1 else None, nicknames)
                    words = tuple(_joined(tokens(names[0]))) + tuple(_joined(tokens(names[1])) if len(names) > 1 else ())
                    first = initials(words)
                    keys = suffix_keys(words)
                rows.append((entity, rank, json.dumps(e, ensure_ascii=False), sorted(keys), sorted(first)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["entity", "rank", "entry", "keys", "first"])

    rows = competitors.filter("id is not null").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("entity"), F.col("id").cast("bigint").alias("rank"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    if people is not None:
        rows = rows.unionByName(people.filter("id is not null").select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("entity"), F.col("id").cast("bigint").alias("rank"), F.array("full_name", "full_name_ar").alias("names")))
    return rows.mapInArrow(run, "entity string, rank bigint, entry string, keys array<string>, first array<string>")


def tops(mentions: DataFrame, register: DataFrame, ranked: bool = False) -> DataFrame:
    """(mention, score, entities): the best entries of each distinct mention that has one, those within NEAR of the best score.

    With ``ranked``, mentions carry ``rank`` and meet only entries of a smaller one.
    """
    index = register.select("entity", "first", F.explode("keys").alias("key"))
    common = index.groupBy("key").agg(F.count_distinct("entity").alias("n")).filter(F.col("n") > COMMON).select("key")
    plain = index.join(common, "key", "left_anti").select("key", "entity")
    refined = index.join(common, "key").select(F.explode(F.transform("first", lambda c: F.concat_ws("|", "key", c))).alias("key"), "entity")
    index = plain.unionByName(refined).distinct()
    often = frozenset(r.key for r in common.collect())  # at most the register's own keys
    longest = (register.select(F.max(F.array_max(F.transform("keys", lambda k: F.length(k)))).alias("n")).first().n or 1) - 1  # no longer suffix can be in the index

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, m in enumerate(b.column(0).to_pylist()):
                words = tokens(m)
                acr = acronym_of(m)
                for k in suffix_keys(tuple(dict.fromkeys([*words, *_joined(words)])), longest) | ({"@" + acr} if acr else set()):
                    for key in [f"{k}|{c}" for c in initials(words)] if k in often else [k]:
                        at.append(i)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in b.columns], pa.array(keys, pa.string())], [*b.schema.names, "key"])

    given = mentions.select("mention", *["rank"] * ranked)
    kinds = "mention string, " + "rank bigint, " * ranked
    keyed = given.mapInArrow(block, kinds + "key string")
    pairs = keyed.join(index, "key").select("mention", *["rank"] * ranked, "entity").distinct()
    payload = register.select("entity", F.col("rank").alias("other"), "entry")
    pairs = pairs.join(payload, "entity")
    if ranked:
        pairs = pairs.filter("other < rank")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            at, scores = [], []
            for i, (m, e) in enumerate(zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                entry = known.get(e)
                if entry is None:
                    if len(known) > 50_000:
                        known.clear()
                    entry = known[e] = json.loads(e)
                s = score(m, entry)
                if s > 0:
                    at.append(i)
                    scores.append(s)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:-1]], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    scored = pairs.select("mention", *["rank"] * ranked, "entity", "entry").mapInArrow(compare, kinds + "entity string, score double")
    by = ["mention", *["rank"] * ranked]
    best = scored.groupBy(*by).agg(F.max("score").alias("score"), F.collect_set(F.struct(F.round("score", 6).alias("score"), "entity")).alias("all"))
    return best.select(*by, "score", F.transform(F.filter("all", lambda x: x["score"] >= F.col("score") - NEAR), lambda x: x["entity"]).alias("entities"))


def link(mentions: DataFrame, register: DataFrame) -> DataFrame:
    """(mention, entity, score): the one best entry of each distinct mention that has one."""
    return tops(mentions, register).filter("size(entities) = 1").select("mention", F.col("entities")[0].alias("entity"), "score")


def repeated_entries(competitors: DataFrame, lines: set[str]) -> DataFrame:
    """(id, name, first): rows of ``competitors`` that enter an organisation again, with the smallest id of that organisation.

    A row leads to the entry of a smaller id that it fits best.  Several that it fits equally well are no ambiguity if they lead to
    one organisation; rows that this settles may settle others, so it is repeated while it finds any.
    """
    names = competitors.filter("id is not null and trim(name) != ''").select(F.col("id").cast("bigint").alias("rank"), F.col("name").alias("mention"))
    found = cut(tops(names, entries(competitors, None, lines), ranked=True).select(F.col("rank").alias("id"), F.col("mention").alias("name"), F.transform("entities", lambda e: F.substring(e, 2, 20).cast("bigint")).alias("to")))
    parents = _rooted(found.filter("size(to) = 1").select("id", "name", F.col("to")[0].alias("first")))
    while True:
        open_ = found.join(parents.select("id"), "id", "left_anti").select("id", "name", F.explode("to").alias("to"))
        root = parents.select(F.col("id").alias("to"), F.col("first").alias("root"))
        settled = open_.join(root, "to", "left").groupBy("id", "name").agg(F.collect_set(F.coalesce("root", "to")).alias("roots")).filter("size(roots) = 1")
        more = cut(settled.select("id", "name", F.col("roots")[0].alias("first")))
        if more.isEmpty():
            return parents
        parents = _rooted(parents.unionByName(more))


def _rooted(parents: DataFrame) -> DataFrame:
    """(id, name, first) with ``first`` followed to its end; each round halves the paths."""
    parents = cut(parents)
    while True:
        up = parents.select(F.col("id").alias("first"), F.col("first").alias("next"))
        moved = cut(parents.join(up, "first", "left").select("id", "name", F.coalesce("next", "first").alias("first"), F.col("next").isNotNull().alias("moved")))
        parents = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return parents


def variant_names(classifications: DataFrame, competitors: DataFrame, people: DataFrame, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(tbl, row_id, mention, entity_key): spellings in ``entities`` that mean an entry but equal none of its names, and rows of
    ``competitors`` that enter an organisation again."""
    lines = line_words(competitors)
    again = repeated_entries(competitors, lines)
    root = again.select("id", F.concat(F.lit("c"), F.col("first").cast("string")).alias("root"))
    firsts = competitors.join(root, competitors["id"] == root["id"], "left_anti")
    register = cut(entries(firsts, people, lines, nicknames))
    names = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("mention")
    own = competitors.select("id", names).join(root, "id", "left").select("mention", F.coalesce("root", F.concat(F.lit("c"), F.col("id").cast("string"))).alias("entity"))
    own = own.unionByName(people.select(F.explode(F.array("full_name", "full_name_ar")).alias("mention"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("entity"))).distinct()
    used = classifications.filter("id is not null").select(F.col("id").cast("bigint").alias("row_id"), F.explode("entities").alias("mention")).filter("trim(mention) != ''").distinct()
    linked = link(used.select("mention").distinct(), register).join(own, ["mention", "entity"], "left_anti")
    found = used.join(linked, "mention").select(F.lit("article_classifications").alias("tbl"), "row_id", "mention", F.col("entity").alias("entity_key"))
    twice = again.select(F.lit("competitors").alias("tbl"), F.col("id").alias("row_id"), F.col("name").alias("mention"), F.concat(F.lit("c"), F.col("first").cast("string")).alias("entity_key"))
    return found.unionByName(twice)
