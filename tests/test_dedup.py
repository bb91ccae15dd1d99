"""Greedy distinct and components against a few lines of sequential code, on random inputs."""

from __future__ import annotations

import random

import pytest

from siftwire.functions.text import token_sort_ratio
from siftwire.operators import dedup


def greedy(rows):
    claimed, kept = set(), []
    for seq, *keys in sorted(rows):
        mine = {(i, k) for i, k in enumerate(keys) if k is not None}
        if not mine & claimed:
            claimed |= mine
            kept.append(seq)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_greedy_distinct(spark, seed):
    r = random.Random(seed)
    rows = [(i, *[r.choice([None, *"abcdefgh"[: 3 + seed * 2]]) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, x string, y string, z string")
    assert sorted(x.n for x in dedup.greedy_distinct(df, "n", ["x", "y", "z"]).collect()) == greedy(rows)


def test_greedy_distinct_chain(spark):
    rows = [(i, str(i // 2), str((i + 1) // 2), None) for i in range(12)]
    df = spark.createDataFrame(rows, "n int, x string, y string, z string")
    assert sorted(x.n for x in dedup.greedy_distinct(df, "n", ["x", "y", "z"]).collect()) == greedy(rows)


def test_greedy_distinct_empty(spark):
    df = spark.createDataFrame([], "n int, x string, y string, z string")
    assert dedup.greedy_distinct(df, "n", ["x", "y", "z"]).count() == 0


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(25 + 15 * seed)] if seed < 2 else [(i, i + 1) for i in range(30)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node int")
    got = dedup.components(nodes, spark.createDataFrame(edges, "src int, dst int"))
    assert {x.node: x.component for x in got.collect()} == components(range(n), edges)


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node int")
    got = dedup.components(nodes, spark.createDataFrame([], "src int, dst int"))
    assert {(x.node, x.component) for x in got.collect()} == {(1, 1), (2, 2)}


def test_fuzzy_links_lose_nothing(spark, monkeypatch):
    """Against all pairs, with blocks so small that every bucket is split."""
    monkeypatch.setattr(dedup, "BLOCK", 3)
    r = random.Random(5)
    words = "bank lends shares slip credit board approves plan fund opens desk cairo".split()
    hour = 3_600_000_000
    rows = []
    for i in range(60):
        base = r.sample(words, 5) if i % 3 == 0 or not rows else rows[-1][2].split()
        if i % 3:
            base = base[:]
            base[r.randrange(len(base))] = r.choice(words)
        rows.append((i, r.randrange(0, 200) * hour, " ".join(base), "OTHER", r.sample(["a", "b", "c"], 2)))
    df = spark.createDataFrame(rows, "node int, at_us bigint, title string, topic string, entities array<string>")
    links = [(x.src, x.dst) for x in dedup.fuzzy_links(df).collect()]
    truth = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and abs(a[1] - b[1]) <= 36 * hour:
                s = token_sort_ratio(a[2], b[2])
                if s >= 85 or s >= 68 and len(set(a[4]) & set(b[4])) >= 1:
                    truth.append((a[0], b[0]))
    assert truth and components(range(60), links) == components(range(60), truth)


def test_topics_keep_apart(spark):
    rows = [(1, 0, "bank opens desk", "A", None), (2, 0, "bank opens desk", "B", None), (3, 0, "bank opens desk", "OTHER", None)]
    df = spark.createDataFrame(rows, "node int, at_us bigint, title string, topic string, entities array<string>").filter("node < 3")
    assert dedup.fuzzy_links(df).count() == 0


def test_token_sort_ratio():
    assert token_sort_ratio("Central bank raises rates", "rates central BANK raises") == 100
    assert token_sort_ratio("Central bank raises rates by 2%", "New wallet launched in Cairo") < 60
    assert token_sort_ratio(None, "x") == 0


def test_canonical_pick(spark):
    rows = [("g", "a", False, 1, "x" * 200, 1), ("g", "b", True, 2, "x" * 90, 1), ("g", "c", True, 2, "x" * 10, 9), ("h", "d", None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, id string, english boolean, tier int, content string, at_us bigint")
    assert {(r.g, r.id, r.members) for r in dedup.canonical_pick(df, "g").collect()} == {("g", "b", 3), ("h", "d", 1)}


def test_provenance(spark):
    rows = [("e", 1, "https://x.example/1", 3, 2, "c"), ("e", 2, "https://gov.example/1", 3, 2, "c"), ("f", 1, "https://x.example/2", 3, 1, "c"), ("g", 1, "https://x.example/3", 3, 3, "c"), ("h", 1, "https://x.example/4", 2, 3, "c")]
    df = spark.createDataFrame(rows, "event_id string, seq int, url string, tier int, event_tier int, event_url string")
    got = {(r.event_id, r.status, r.source) for r in dedup.provenance(df, ["gov.example"], ["wire.example"]).collect()}
    assert got == {("e", "OFFICIAL", "https://gov.example/1"), ("f", "OFFICIAL", "c"), ("g", "UNVERIFIED", None), ("h", "VERIFIED", "https://x.example/4")}
