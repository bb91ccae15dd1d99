from __future__ import annotations

from datetime import datetime, timezone

import pytest

survivor = pytest.importorskip("siftwire.llm.survivor")


def at(d):
    return datetime(2025, 1, d, tzinfo=timezone.utc)


GOOD_T, GOOD_U, GOOD_S = "Board of Lazokir approves a capital call", "https://n.example/news/1a", "Cedar Wire"
EVENTS = [
    ("a", GOOD_T, "https://n.example/news/1a?id=7", "Cedar Wire", 2, at(1)), ("b", "Untitled", "#", "RSS", 1, at(9)), ("c", "Board of Lazokir approves a capi", "https://n.example/", "Cedar W…", 1, at(8)),
    ("d", GOOD_T, "https://n.example/story/2b", "Delta Post", 2, at(2)), ("e", None, None, None, None, None), ("f", "Board of Laz…", "http://localhost:8080/item/1", "n.example", 1, at(3)), ("g", "BoardÃ© of Lazokir approves a capital call", "https://go.hop.example/r?u=1", "17", 1, at(4)),
    ("h", GOOD_T, GOOD_U, GOOD_S, None, at(20)), ("i", GOOD_T, GOOD_U, GOOD_S, 3, at(1)),
]
GROUPS = [(1, x) for x in "abcdefg"] + [(1, "a"), (2, "h"), (2, "i"), (3, "e"), (3, "b"), (None, "a"), (4, "zz")]


def frames(spark, events, groups):
    e = spark.createDataFrame(events, "id string, canonical_title string, canonical_url string, canonical_source_name string, canonical_source_tier int, created_at timestamp")
    filler = [(f"x{i}", f"Board of Lazokir {w} a capital call", f"https://n.example/news/{i}", f"Paper {w}", 2, at(1)) for i, w in enumerate("wants plans names likes sees asks".split())]
    more = spark.createDataFrame(filler, e.schema)
    g = spark.createDataFrame(groups + [(100 + i, f"x{i}") for i in range(6)] * bool(groups), "group_no bigint, event_id string")
    return (e.unionByName(more) if events else e), g


def test_survivors(spark):
    e, g = frames(spark, EVENTS, GROUPS)
    got = {(r.group_no, r.field): r.event_id for r in survivor.survivors(e, g).collect() if r.group_no < 100}
    assert got == {(1, f): "d" for f in survivor.FIELDS} | {(2, f): "i" for f in survivor.FIELDS}


def test_empty(spark):
    e, g = frames(spark, [], [])
    assert survivor.survivors(e, g).count() == 0


def test_em_finds_the_reasons():
    import random

    r = random.Random(1)
    n: dict = {}
    for _ in range(4000):
        reason = r.choice([None] * 6 + list(range(4)))
        p = sum((r.random() < (0.05 if i == reason else 0.999)) << i for i in range(6))
        n[p] = n.get(p, 0) + 1
    post = survivor.fit(list(n.items()))
    assert post[63] > 0.95 and all(post[63 - (1 << i)] < 0.2 for i in range(4))
    assert abs(sum(post[p] * c for p, c in n.items()) / 4000 - 0.6) < 0.05


def test_publishers_by_listed_denials(spark):
    """The linear sums give what a model with every denial listed gives."""
    import math

    full = 63
    rows = [(g, "canonical_title", v, p, pub) for g, v, p, pub in [(1, "a", full, "X"), (1, "a", full, "Y"), (1, "b", full, "Z"), (1, "c", 31, "Z"), (2, "d", full, "X"), (2, "e", 0, "Z"), (3, "f", full, None), (3, "g", full, "Y"), (3, "g", full, "y ")]]
    df = spark.createDataFrame(rows, "group_no bigint, field string, value string, pattern int, publisher string")
    got = {(r.group_no, r.value): r.p for r in df.join(survivor.posteriors(df).withColumnRenamed("v", "h"), ["group_no", "field"]).filter("h = xxhash64(trim(value))").distinct().collect()}
    counts: dict = {}
    for x in rows:
        counts[x[3]] = counts.get(x[3], 0) + 1
    told = survivor.fit(list(counts.items()))
    claims = {(g, v, (pub or "").strip().lower()) for g, _, v, _, pub in rows}
    odds = {(g, v): math.log(told[p] / (1 - told[p])) for g, _, v, p, _ in rows}
    p = {f: 1 / (1 + math.exp(-o)) for f, o in odds.items()}
    cover = {(g, s) for g, _, s in claims}
    for _ in range(survivor.ROUNDS):
        sens, slip = {}, {}
        for s in {s for _, s in cover}:
            seen = [f for f in p if (f[0], s) in cover]
            own = [f for f in seen if (*f, s) in claims]
            sens[s] = (sum(p[f] for f in own) + survivor.TRUE_PRIOR[0]) / (sum(p[f] for f in seen) + sum(survivor.TRUE_PRIOR))
            slip[s] = (sum(1 - p[f] for f in own) + survivor.UNTRUE_PRIOR[0]) / (sum(1 - p[f] for f in seen) + sum(survivor.UNTRUE_PRIOR))
        new = {}
        for f in p:
            who = [s for g, s in cover if g == f[0]]
            said = [math.log(sens[s] / slip[s]) if (*f, s) in claims else math.log((1 - sens[s]) / (1 - slip[s])) for s in who]
            new[f] = 1 / (1 + math.exp(-odds[f] - sum(said) / len(who)))
        p = new
    assert got.keys() == p.keys() and all(abs(got[f] - p[f]) < 1e-9 for f in p)


def test_several_true_values_are_kept(spark):
    e, g = frames(spark, EVENTS, GROUPS)
    rows = survivor.true_values(e, g).filter("group_no = 1").collect()
    assert {r.value for r in rows if r.field == "canonical_url"} == {"https://n.example/news/1a?id=7", "https://n.example/story/2b"}
    assert {(r.value, r.rows) for r in rows if r.field == "canonical_title"} == {(GOOD_T, 2)}
    assert survivor.true_values(*frames(spark, [], [])).count() == 0


def test_fit_of_nothing():
    assert survivor.fit([]) == {}
