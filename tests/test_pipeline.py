from __future__ import annotations

from datetime import datetime, timezone

import pytest

from siftwire import schemas
from siftwire.operators.rules import Rule
from siftwire.plans import pipeline
from siftwire.sources import sinks

NOW = datetime(2025, 1, 8, tzinfo=timezone.utc)
RULES = (Rule("reg", "Regulation", {"title_l": ("regulator",)}, score=90), Rule("sport", "Other", {"title_l": ("match",)}, score=0))
BODY = "The regulator approved a new set of rules for lenders on Monday. The rules take effect in March and cover all lenders."


def row(i, title, url, tier=2, body=BODY, day=5):
    return (i, title, url, 1, "Cedar Wire", tier, datetime(2025, 1, day, 12, tzinfo=timezone.utc), NOW, body, None, "en")


@pytest.fixture(scope="module")
def result(spark):
    rows = [
        row("a", "Regulator approves new rules for lenders", "https://n.example/1?utm_source=x"), row("b", "Regulator approves new rules for lender", "https://m.example/2", 1, BODY + " More follows."),
        row("c", "Regulator approves new rules for lenders", "https://n.example/1"), row("d", "Cup match ends in a draw", "https://n.example/3"), row("e", "Weather is fine today", "https://n.example/4"),
        row("f", "Regulator fines a broker in Giza", "https://gov.example/5", body="Too short."), row("g", "Regulator story of last year", "https://n.example/6", day=1)[:6] + (datetime(2024, 1, 1, tzinfo=timezone.utc), NOW, BODY, None, "en"),
    ]
    a = spark.createDataFrame(rows, schemas.ARTICLE)
    sent = []
    ctx = pipeline.RunContext("r1", NOW, RULES, official=("gov.example",), recipients=("x@y.example",))
    return a, ctx, sent, pipeline.run(a, ctx, sink=lambda *x: sent.append(x) or True)


def test_run(result):
    _, _, sent, r = result
    assert r["counters"] == {"collected": 7, "preprocessed": 5, "relevant": 3, "events": 1, "summaries": 1, "sent": 1}
    assert r["subject"] == "Weekly Brief | 1 events" and "Regulator approves" in r["plain"] and sent[0][3] == ["x@y.example"]
    assert "90" not in r["plain"] and "score" not in r["html"]
    e = r["events"].collect()
    assert [(x.verification_status, x.canonical_url) for x in e] == [("OFFICIAL", "https://m.example/2")]


def test_ledger_stops_a_second_delivery(spark, result, tmp_path):
    a, ctx, _, r = result
    folder = str(tmp_path / "t")
    sinks.create_tables(spark, folder)
    assert sinks.record_events(r["events"], r["links"], folder, "r1", "x", NOW) == 1
    assert sinks.record_events(r["events"], r["links"], folder, "r1", "x", NOW) == 0
    ledger = sinks.stored(spark, folder, "sent_news").selectExpr("event_id as id", "canonical_url", "canonical_title", "unix_micros(sent_at) as sent_us")
    again = pipeline.run(a, ctx, ledger, sinks.stored(spark, folder, "event_articles"), a)
    assert again["counters"]["summaries"] == 0 and again["subject"].endswith("no news") and not again["delivered"]


def test_settings():
    for bad in ({"lookback_days": 0}, {"least_importance": 101}, {"when_empty": "x"}):
        with pytest.raises(ValueError):
            pipeline.RunContext("r", NOW, RULES, **bad)


def test_failover():
    class Down:
        def classify(self, *a):
            raise OSError("down")

        def summarise(self, *a):
            raise ValueError("quota")

    both = pipeline.Failover([Down(), pipeline.StubModel()])
    assert both.summarise("t", "c") == "c" and "Other" in both.classify("t", "c")
    with pytest.raises(RuntimeError):
        pipeline.Failover([Down()]).classify("t", "c")


@pytest.mark.parametrize("topics, entities, events", [(("OTHER", "OTHER"), (["Lazokir"], ["lazokir"]), 1), (("OTHER", "OTHER"), (["Lazokir"], ["Qalwam"]), 2), (("A", "B"), (["Lazokir"], ["Lazokir"]), 2), (("A", "A"), ([], []), 1)])
def test_topics_and_entities_reach_the_clusters(spark, topics, entities, events):
    import json

    from siftwire.functions import text

    titles = ("Lazokir opens a branch for loans in Giza", "Lazokir opens its branch for cards in Giza")
    assert 68 <= text.token_sort_ratio(*[" ".join(sorted(t.lower().split())) for t in titles]) < 85

    class Model(pipeline.StubModel):
        def classify(self, title, content):
            i = titles.index(title)
            return json.dumps({"category": "Bank", "is_relevant": True, "importance_score": 90, "relevance_score": 90, "topic": topics[i], "entities": entities[i]})

    a = spark.createDataFrame([row(f"i{i}", t, f"https://n.example/{i}", body=f"{BODY} {i}") for i, t in enumerate(titles)], schemas.ARTICLE)
    assert pipeline.run(a, pipeline.RunContext("r1", NOW, RULES), model=Model())["counters"]["events"] == events


def test_a_repeated_run_adds_nothing_twice(spark, tmp_path):
    """A run that broke off after its events is written again in its own place; the run log has one line a run."""
    folder = str(tmp_path / "store")
    sinks.create_tables(spark, folder)
    events = spark.createDataFrame([("e1", "T", NOW, "c", None, "u", "s", 1, "sum", 90, "OFFICIAL", "u"), ("e2", "T", NOW, "c", None, "u", "s", 1, None, 90, "OFFICIAL", "u")], sinks.TABLES["events"])
    links = spark.createDataFrame([("e1", "a"), ("e2", "b")], "event_id string, article_id string")
    sinks.put(events.filter("summary is not null"), folder, "events", "r1")
    assert sinks.record_events(events, links, folder, "r1", "x", NOW) == 1
    assert sinks.record_events(events, links, folder, "r2", "x", NOW) == 0
    assert [sinks.stored(spark, folder, t).count() for t in ("events", "event_articles", "sent_news")] == [1, 1, 1]
    sinks.record_run(spark, folder, "r1", NOW)
    sinks.record_run(spark, folder, "r1", NOW, NOW, 1, {"sent": 1})
    sinks.record_run(spark, folder, "r2", NOW, NOW, 0, {}, "boom")
    assert {(r.run_id, r.status) for r in sinks.stored(spark, folder, "workflow_runs").collect()} == {("r1", "COMPLETED"), ("r2", "FAILED")}
    sinks.drop_tables(spark, folder)
    sinks.create_tables(spark, folder)
    assert sinks.stored(spark, folder, "events").count() == 0


def test_embeddings_and_their_cache(spark):
    from siftwire.operators import vectors

    t = spark.createDataFrame([(1, "bank opens desk"), (2, "desk opens bank"), (3, " "), (4, None)], "node bigint, text string")
    first = vectors.embed(t, vectors.hashed_words)
    assert {r.node for r in first.collect()} == {1, 2}
    again = vectors.embed(t.unionByName(spark.createDataFrame([(5, "new")], t.schema)), lambda texts: [[9.0]] * len(texts), first)
    assert {r.node: len(r.vector) for r in again.collect()} == {1: 64, 2: 64, 5: 1}
