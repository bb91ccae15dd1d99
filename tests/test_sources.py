from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftwire.sources import feeds, sinks
from siftwire.streaming import stream

RSS = """<?xml version="1.0"?><rss><channel>
<item><title>Bank opens desk - Cedar Wire</title><link>https://n.example/a?utm_source=x</link><description>&lt;b&gt;Body&lt;/b&gt; text</description><pubDate>Tue, 18 Mar 2025 11:01:07 +0300</pubDate></item>
<item><title></title><link>https://n.example/b</link></item>
</channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    raw = feeds.read_feed(spark, str(tmp_path / "f.xml"))
    rows = feeds.make_articles(raw, F.timestamp_seconds(F.lit(1742300000))).collect()
    assert [(r.url, r.content, r.source_name, r.language) for r in rows] == [("https://n.example/a", "Body text", "Cedar Wire", "en")]
    assert rows[0].published_at.isoformat() == "2025-03-18T08:01:07"
    assert len(rows[0].id) == 64 and len(rows[0].content_hash) == 64


def test_search_results(spark):
    reply = json.dumps({"news_results": [{"title": "T", "link": "https://n.example/x", "snippet": "s", "date": "2 hours ago", "source": "W"}]})
    rows = feeds.search_results(spark.createDataFrame([(reply,), ("no json",), (None,)], "reply string")).collect()
    assert [(r.title, r.published_text) for r in rows] == [("T", "2 hours ago")]


def test_html_links(spark):
    page = '<a href="/news/1">A long enough title</a><a href="/news/1">A long enough title</a><a href="/x">short</a><a href="/about">Another long title</a>'
    df = spark.createDataFrame([("https://n.example/list", page), ("u", None)], "url string, html string")
    got = [tuple(r) for r in feeds.html_links(df, marker="/news/").collect()]
    assert got == [("https://n.example/list", "A long enough title", "https://n.example/news/1")]


def test_feed_source_isolates_failures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "T", "url": "u"}]))
    (tmp_path / "b.json").write_text("{broken")
    spark.dataSource.register(feeds.FeedSource)
    rows = sorted(spark.read.format("landed_feed").load(str(tmp_path)).collect(), key=lambda r: r.feed)
    assert [(r.feed, r.title, r.error) for r in rows] == [("a.json", "T", None), ("b.json", None, "JSONDecodeError")]


def test_switches(spark):
    a, b = spark.createDataFrame([], "x int"), spark.createDataFrame([(1,)], "x int")
    assert feeds.primary_or_fallback(a, b).count() == 1 and feeds.primary_or_fallback(None, b).count() == 1
    assert feeds.union([b, b.withColumn("y", F.lit(2))]).count() == 2
    df = spark.createDataFrame([(200, 5, "k"), (429, 5, "k"), (403, 5, "k"), (500, 5, "k"), (None, 5, "k"), (200, 0, "k"), (200, 5, "")], "c int, l int, k string")
    got = [r[0].reason for r in df.select(feeds.quota_status(F.col("c"), F.col("l"), F.col("k"))).collect()]
    assert got == ["ok", "quota", "denied", "http_error", "network", "exhausted", "no_key"]


def test_hydrate(spark):
    a = spark.createDataFrame([("u1", "short"), ("u2", None), ("u3", "x" * 300)], "url string, content string")
    pages = spark.createDataFrame([("u1", "<nav>m</nav><p>" + "long " * 60 + "</p>"), ("u2", "<p>hi</p>")], "url string, html string")
    got = {r.url: len(r.content or "") for r in feeds.hydrate(a, pages).collect()}
    assert got == {"u1": 299, "u2": 0, "u3": 300}  # a paragraph of two letters is no body


def test_sinks(spark, tmp_path):
    out = []
    assert sinks.SINKS["payload"](lambda body: out.append(json.loads(body)) or True)("s", "p", "h", ["a@x.example"])
    assert out[0]["to"] == ["a@x.example"]
    assert sinks.SINKS["file"](str(tmp_path / "d"))("s", "p", "<p>", []) and (tmp_path / "d" / "digest.txt").read_text() == "s\n\np"


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def _row(i, url, title, at):
    return {"id": i, "url": url, "title": title, "published_at": at, "retrieved_at": "2025-01-02T00:00:00Z", "source_id": 1}


def test_stream_with_ledger(spark, tmp_path):
    src, led = tmp_path / "in", str(tmp_path / "ledger")
    sent = []
    write = stream.ledger_writer(led, lambda df, b: sent.extend(r.id for r in df.collect()))

    def go():
        q = stream.run_once(stream.distinct_stream(stream.article_stream(spark, str(src))), str(tmp_path / "cp"), write)
        q.awaitTermination(120)

    _write(src, "1.json", [_row("a", "https://n.example/1", "T1", "2025-01-01T10:00:00Z"), _row("b", "http://www.n.example/1/?x=1", "T1", "2025-01-01T11:00:00Z"), _row("c", "https://n.example/2", "T2", None)])
    go()
    _write(src, "2.json", [_row("d", "https://n.example/1", "T1", "2025-01-01T12:00:00Z"), _row("e", "https://n.example/3", "T3", "2025-01-01T12:00:00Z")])
    go()
    assert len(sent) == 3 and set(sent) & {"a", "b"} and {"c", "e"} <= set(sent)
    write(spark.read.parquet(led).select("url_key", "id", "title"), 0)
    assert len(sent) == 3


def test_stream_windows(spark, tmp_path):
    src = tmp_path / "w"
    _write(src, "1.json", [_row(str(i), f"u{i}", f"title number {i % 2}", f"2025-01-01T0{i}:10:00Z") for i in range(4)])
    for k, f in enumerate((stream.counts, stream.sessions, stream.quiet_titles)):
        q = f(stream.article_stream(spark, str(src))).writeStream.format("memory").queryName(f"out{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("out2").count() == 2


def test_seed_load(spark, tmp_path):
    from siftwire.sources import tables

    (tmp_path / "seed.json").write_text(json.dumps([{"name": "A", "tier": 1, "active": True}, {"name": "C", "tier": 3, "active": True}, {"name": "D"}]))
    seed = tables.labelled(spark, str(tmp_path / "seed.json"), "id int, name string, tier int, active boolean")
    stored = spark.createDataFrame([(1, "A", 2, True), (2, "B", 2, True)], "id int, name string, tier int, active boolean")
    got = {tuple(r) for r in tables.seeded(stored, seed).select("id", "name", "tier", "active").collect()}
    assert got == {(1, "A", 1, True), (2, "B", 2, False), (3, "C", 3, True), (4, "D", None, False)}
    assert tables.seeded(stored.limit(0), seed).count() == 3 and tables.seeded(stored, seed.limit(0)).filter("active").count() == 0


def test_triggers():
    assert stream.trigger("once") == {"availableNow": True} and stream.trigger("daily") == {"processingTime": "1 day"} and stream.trigger("90 minutes") == {"processingTime": "90 minutes"}
    with pytest.raises(ValueError):
        stream.trigger("now and then")


def test_one_run_from_the_command_line(spark, tmp_path):
    from siftwire import __main__ as cli
    from siftwire.sources import sinks as s

    (tmp_path / "none").mkdir()
    (tmp_path / "feeds").mkdir()
    item = {"title": "Regulator approves a fund of the bank", "url": "https://n.example/1", "content": "The regulator approved the fund of the bank on Monday, after two years of talks with its owners and their lenders. " * 2, "published_text": None, "source_name": "Wire"}
    (tmp_path / "feeds" / "a.json").write_text(json.dumps([item]))
    out = str(tmp_path / "out")
    for run in ("r1", "r2"):
        assert cli.main([str(tmp_path / "none"), out, "--fallback", str(tmp_path / "feeds"), "--run-id", run]) == 0
    assert s.stored(spark, out, "articles").count() == 1  # the second run adds no article again
    assert {(r.run_id, r.status) for r in s.stored(spark, out, "workflow_runs").collect()} == {("r1", "COMPLETED"), ("r2", "COMPLETED")}
    assert s.stored(spark, out, "sent_news").count() == 1
