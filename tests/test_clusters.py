"""Event clusters against all pairs, and what clustering and cleaning must do on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_dedup import components, greedy

from siftwire.functions import text
from siftwire.functions.text import token_sort_ratio
from siftwire.operators import dedup

HOUR = 3_600_000_000
CONCEPTS = {"phones": ("phone", "هاتف"), "tax": ("customs", "tax")}


def linked(a, b, vectors):
    """The edges of two reports, by their definition."""
    if a[1] and a[1] == b[1] or a[2] and a[2] == b[2]:
        return True
    if a[3] != b[3] and "OTHER" not in (a[3], b[3]):
        return False
    if a[3] == b[3] != "OTHER":
        return True
    if a[7] and a[7] == b[7] and any(any(t in a[5] for t in c) and any(t in b[5] for t in c) for c in CONCEPTS.values()):
        return True
    if None not in (a[4], b[4]) and abs(a[4] - b[4]) > 36 * HOUR:
        return False
    s = token_sort_ratio(a[5], b[5])
    x, y = ({e.lower() for e in z[6] or ()} for z in (a, b))
    if s >= 85 or s >= 68 and x and y and len(x & y) >= max(1, min(len(x), len(y)) // 2):
        return True
    if a[3] == b[3] == "OTHER" and a[0] in vectors and b[0] in vectors:
        u, v = vectors[a[0]], vectors[b[0]]
        dot = lambda p, q: sum(i * j for i, j in zip(p, q))
        return dot(u, v) / (dot(u, u) * dot(v, v)) ** 0.5 >= 0.88
    return False


@pytest.mark.parametrize("seed", range(2))
def test_event_clusters_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 4)
    r = random.Random(seed)
    words = "bank lends shares slip credit board approves plan fund opens desk cairo phone customs tax هاتف sells new".split()
    rows = []
    for i in range(70):
        title = " ".join(r.sample(words, 6)) if i % 3 == 0 else rows[-1][5] if i % 3 == 1 else " ".join(rows[-1][5].split()[1:] + [r.choice(words)])
        rows.append((i, r.choice([f"u{i}", f"u{i}", "u1", ""]), r.choice([None, f"h{i}", f"h{i}", "h1"]), r.choice(["OTHER"] * 8 + ["A", "B"]), r.choice([None, *[r.randrange(0, 1500) * HOUR] * 9]), title, r.choice([None, [], ["X"], ["x", "y"]]), r.choice([None, None, None, "c1"])))
    vectors = {i: [r.gauss(0, 1) for _ in range(4)] for i in range(0, 70, 2)}
    df = spark.createDataFrame(rows, "node int, url_key string, content_hash string, topic string, at_us bigint, title string, entities array<string>, competitor string")
    v = spark.createDataFrame(list(vectors.items()), "node int, vector array<double>")
    got = {x.node: x.component for x in dedup.event_clusters(df, concepts=CONCEPTS, vectors=v).collect()}
    truth = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and linked(a, b, vectors)]
    want = components(range(70), truth)
    assert got == want and len(set(want.values())) > 3


def test_a_long_chain_is_finished_by_component(spark):
    rows = [(i, str(i // 2), str((i + 1) // 2), None) for i in range(120)]
    df = spark.createDataFrame(rows, "n int, x string, y string, z string")
    assert sorted(x.n for x in dedup.greedy_distinct(df, "n", ["x", "y", "z"], rounds=2).collect()) == greedy(rows)
    few = spark.createDataFrame(rows[:14], df.schema)
    assert sorted(x.n for x in dedup.greedy_distinct(few, "n", ["x", "y", "z"], rounds=1, largest=3).collect()) == greedy(rows[:14])


def test_copies_of_a_title_are_compared_as_one(spark):
    df = spark.range(20_000).select("id", F.lit("bank opens desk in old cairo").alias("title")).unionByName(spark.createDataFrame([(20_000, "bank opens desk in old cairo x")], "id bigint, title string"))
    rows = df.select(F.col("id").alias("node"), F.lit(HOUR).alias("at_us"), "title", F.lit("OTHER").alias("topic"), F.lit(None).cast("array<string>").alias("entities"))
    links = dedup.fuzzy_links(rows)
    assert links.count() == 20_000


PAGE = "<html><body><nav>Top <nav>Inner</nav> tail</nav><div class='post-body'><p>One &eacute;t&eacute; &mdash; 5 &euro;<p>Two <b>bold</b> words</div><script>if(a<b){}</script><aside>open<p>x</body></html>"


def test_strip_html_follows_the_nesting(spark):
    got = spark.createDataFrame([(PAGE,), (None,), ("plain text",), ("a < b & c",), ("<p>x</p><script>y",)], "t string").select(text.strip_html(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["One été — 5 € Two bold words", "", "plain text", "a < b & c", "x"]


def test_main_text(spark):
    long = "A story paragraph that is long enough to be kept here. " * 3
    page = f"<body><p>{long}outside</p><article><p>short</p><p>{long}</p></article></body>"
    poor = f"<body><p>{long}outside</p><article><p>short</p></article></body>"
    got = [r.t for r in spark.createDataFrame([(page,), (poor,), ("",)], "t string").select(text.main_text(F.col("t")).alias("t")).collect()]
    assert got == [long.strip(), f"{long}outside", ""]


@pytest.mark.parametrize("reply, prose", [
    ("```markdown\n## Executive Summary\n- Rates rose by 2%.\n```", "Rates rose by 2%."), ("1. Final Review: Yes, rates rose.", "rates rose."), ("Is it factual? Yes\nRates rose.\n\n  Banks gained.", "Rates rose.\nBanks gained."),
    ("**Draft**: **Overview** - Banks gained.", "Banks gained."), ("(?* ) Rates", "Rates"), (None, ""), ("Drafts of the law were read.", "Drafts of the law were read."), ("No bank gained.", "No bank gained."), ("2024 was good.", "2024 was good."),
])
def test_scrub_summary_keeps_the_prose(spark, reply, prose):
    assert spark.createDataFrame([(reply,)], "t string").select(text.scrub_summary(F.col("t")).alias("t")).first().t == prose


@pytest.mark.parametrize("summary, valid", [("Rates rose by two points in May, the central bank said on Monday.", True), ("Rates rose.", False), (None, False), (")?* " + "x" * 60, False), ("It contains only the title of the story, and nothing else at all.", False), ("x" * 60 + " بنك", False)])
def test_valid_summary(spark, summary, valid):
    assert spark.createDataFrame([(summary,)], "t string").select(text.valid_summary(F.col("t")).alias("v")).first().v is valid
