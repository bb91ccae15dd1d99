"""Feeds, search replies and pages as article rows.

What a connector fetched lies in landed files; reading them is a scan like any other.  ``FeedSource`` is the plug-in surface: a
Python data source with one partition per feed, where a feed that cannot be read gives a status row instead of an error.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text, urls
from ..operators import timestamps

_ITEM = "title string, link string, description string, pubDate string, updated string, published string, content string, source string"
RAW = "title string, url string, content string, published_text string, source_name string"


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """RAW rows of landed RSS (``item``) or Atom (``entry``) files; the longer of content and description, the first date there is."""
    x = spark.read.format("xml").option("rowTag", row_tag).schema(_ITEM).load(path)
    return x.select("title", F.col("link").alias("url"), F.when(F.length("description") > F.length(F.coalesce("content", F.lit(""))), F.col("description")).otherwise(F.col("content")).alias("content"), F.coalesce("pubDate", "published", "updated").alias("published_text"), F.coalesce("source", text.publisher_suffix(F.col("title"))).alias("source_name"))


def search_results(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """RAW rows of search replies in JSON (``news_results``); replies that are no JSON give none."""
    ddl = "news_results array<struct<title:string,link:string,snippet:string,date:string,source:string>>"
    r = replies.select(F.inline(F.coalesce(F.from_json(reply, ddl)["news_results"], F.array().cast("array<struct<title:string,link:string,snippet:string,date:string,source:string>>"))))
    return r.select("title", F.col("link").alias("url"), F.col("snippet").alias("content"), F.col("date").alias("published_text"), F.col("source").alias("source_name"))


def html_links(pages: DataFrame, marker: str = "", least_title: int = 12, most: int = 30) -> DataFrame:
    """(url, title, href): the first ``most`` distinct links of each page whose path holds ``marker`` and whose text is long enough.

    ``pages``: url, html.  Links are resolved against the page's URL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html.parser import HTMLParser
        from urllib.parse import urljoin

        class Anchors(HTMLParser):
            def __init__(self) -> None:
                super().__init__(convert_charrefs=True)
                self.found: list[list[str]] = []
                self.open = False

            def handle_starttag(self, tag, attrs):  # noqa: ANN001
                if tag == "a":
                    self.open = True
                    self.found.append([dict(attrs).get("href") or "", ""])

            def handle_endtag(self, tag):  # noqa: ANN001
                if tag == "a":
                    self.open = False

            def handle_data(self, data):  # noqa: ANN001
                if self.open:
                    self.found[-1][1] += data

        for b in batches:
            rows = []
            for base, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = Anchors()
                p.feed(html or "")
                seen: dict[str, str] = {}
                for href, title in p.found:
                    title, full = " ".join(title.split()), urljoin(base or "", href)
                    if href and marker in href and len(title) >= least_title and full not in seen and len(seen) < most:
                        seen[full] = title
                rows += [(base, t, h) for h, t in seen.items()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["url", "title", "href"])

    return pages.select("url", "html").mapInArrow(run, "url string, title string, href string")


def make_articles(raw: DataFrame, retrieved: Column, tier: int = 2, source_id: Column | None = None) -> DataFrame:
    """Articles of RAW rows: cleaned URL and text, one instant in UTC, hash, language, an id that follows from URL and title.

    Rows without a title or URL are left out.  Dates without a zone are UTC; ages count back from ``retrieved``.
    """
    r = raw.withColumn("url", urls.canonical_url(F.col("url"))).withColumn("title", text.strip_tags(F.col("title"))).withColumn("content", text.strip_tags(F.col("content")))
    r = r.filter((F.col("title") != "") & (F.col("url") != "")).withColumn("retrieved_at", retrieved).withColumn("_zone", F.lit("UTC")).withColumn("_seen", F.unix_micros("retrieved_at"))
    r = timestamps.parse(r, "published_text", "_zone", "_seen").withColumn("_us", timestamps.epoch_us("_zone"))
    hash_ = text.content_hash(F.col("title"), F.col("content"))
    return r.select(
        F.sha2(F.concat_ws("|", "url", "title"), 256).alias("id"), "title", "url", (source_id if source_id is not None else F.lit(None).cast("int")).alias("source_id"), "source_name", F.lit(tier).alias("source_tier"),
        F.timestamp_micros("_us").alias("published_at"), "retrieved_at", "content", hash_.alias("content_hash"), text.script_language(F.col("title"), F.col("content")).alias("language"),
    )


#: Names of a register that are read to the driver, at most.
REGISTER = 100_000


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of several feeds, with ``batch`` for the order of the feeds."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("batch", F.lit(i)) for i, f in enumerate(frames)])


def primary_or_fallback(primary: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """``primary`` if there is one with rows, else ``fallback``."""
    return fallback if primary is None or primary.isEmpty() else primary


def hydrate(articles: DataFrame, pages: DataFrame, short: int = 200, most: int = 4000) -> DataFrame:
    """Short contents replaced by the text of the landed page (``pages``: url, html), where that is longer."""
    body = pages.groupBy("url").agg(F.max("html").alias("_html"))
    needs = F.length(F.coalesce("content", F.lit(""))) < short
    small, rest = articles.filter(needs), articles.filter(~needs)
    page = F.substring(text.main_text(F.col("_html")), 1, most)
    better = F.length(page) > F.length(F.coalesce("content", F.lit("")))
    return small.join(body, "url", "left").withColumn("content", F.when(better, page).otherwise(F.col("content"))).select(articles.columns).unionByName(rest)


def quota_status(code: Column, left: Column, key: Column, least: int = 1) -> Column:
    """A struct (available, reason) of a probe of a paid source."""
    reason = (
        F.when(F.coalesce(key, F.lit("")) == "", "no_key").when(code.isNull(), "network").when(code == 429, "quota").when(code.isin(401, 403), "denied")
        .when(code != 200, "http_error").when(left < least, "exhausted").otherwise("ok")
    )
    return F.struct((reason == "ok").alias("available"), reason.alias("reason"))


def _store(folder: str):  # noqa: ANN202
    """(file system, path) of a folder on any store that pyarrow reads; plain paths are local."""
    return pafs.FileSystem.from_uri(folder if ":" in folder else os.path.abspath(folder))


class _Feed(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self):  # noqa: ANN201
        fs, root = _store(self.folder)
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.path.endswith(".json"))
        return [_Feed(n) for n in names] or [_Feed("")]

    def read(self, partition: _Feed):  # noqa: ANN201
        if not partition.path:
            return
        try:
            with _store(self.folder)[0].open_input_stream(partition.path) as f:
                rows = json.loads(f.read())
            out = [tuple(None if r.get(k) is None else str(r[k]) for k in ("title", "url", "content", "published_text", "source_name")) for r in rows]
        except Exception as e:  # one broken feed must not stop the others
            yield (None, None, None, None, None, os.path.basename(partition.path), f"{type(e).__name__}")
            return
        for r in out:
            yield (*r, os.path.basename(partition.path), None)


class FeedSource(DataSource):
    """``spark.read.format("landed_feed").load(folder)``: RAW rows, feed and error of every JSON file of a folder."""

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return RAW + ", feed string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _FeedReader(self.options)
