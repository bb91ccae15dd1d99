"""The whole run: articles in, a digest out.

Plain composition of DataFrame stages.  Only three places materialise: before the model (a bounded top-k), around the loops of
clustering, and before delivery.
"""

from __future__ import annotations

import html
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import cut
from ..functions import arrays, dates, text, urls
from ..operators import dedup, ledger, rules, vectors


class ModelClient(Protocol):
    """What a language model must offer; replies are JSON, errors are exceptions."""

    def classify(self, title: str, content: str) -> str: ...

    def summarise(self, title: str, content: str) -> str: ...

    def score(self, title: str, content: str) -> str: ...

    def translate(self, title: str) -> str: ...


class StubModel:
    """Deterministic and offline: the first sentences are the summary, nothing is relevant."""

    def classify(self, title: str, content: str) -> str:
        return '{"category":"Other","is_relevant":false,"importance_score":0,"relevance_score":0,"confidence":0.5}'

    def summarise(self, title: str, content: str) -> str:
        return text.unwrapped(content)[:400]

    def score(self, title: str, content: str) -> str:
        return '{"importance_score":0,"relevance_score":0}'

    def translate(self, title: str) -> str:
        return title


class Failover:
    """The first of several clients that answers."""

    def __init__(self, clients: list[ModelClient], tries: int = 3, pause_s: float = 1.5):
        self.clients, self.tries, self.pause_s = clients, tries, pause_s

    def _ask(self, name: str, *args: str) -> str:
        error: Exception | None = None
        for client in self.clients:
            for _ in range(self.tries):
                try:
                    return getattr(client, name)(*args)
                except OSError as e:  # worth another try, later each time
                    error = e
                    time.sleep(self.pause_s)
                except Exception as e:  # quota, no such model: the next client
                    error = e
                    break
        raise RuntimeError("no model answered") from error

    def classify(self, title: str, content: str) -> str:
        return self._ask("classify", title, content)

    def summarise(self, title: str, content: str) -> str:
        return self._ask("summarise", title, content)

    def score(self, title: str, content: str) -> str:
        return self._ask("score", title, content)

    def translate(self, title: str) -> str:
        return self._ask("translate", title)


@dataclass(frozen=True)
class RunContext:
    """Settings of a run; one clock for all stages."""

    run_id: str
    now: datetime
    rules: tuple[rules.Rule, ...]
    lookback_days: int = 7
    least_relevance: int = 50
    least_importance: int = 60
    model_budget: int = 15
    official: tuple[str, ...] = ()
    reputable: tuple[str, ...] = ()
    recipients: tuple[str, ...] = ()
    when_empty: str = "skip"
    zone: str = "UTC"
    sections: tuple[str, ...] = field(default=())
    #: Lexicons (name: terms in the title) of topics and entities, where the model names none; entities that make no two reports one event.
    topics: dict[str, tuple[str, ...]] = field(default_factory=dict)
    entities: dict[str, tuple[str, ...]] = field(default_factory=dict)
    generic: tuple[str, ...] = ()
    #: Concepts (name: terms) that two reports of one competitor share; and texts to vectors, for reports that no rule names.
    concepts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    embed: Callable[[list[str]], list[list[float]]] | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.lookback_days <= 366:
            raise ValueError("lookback_days must be from 1 to 366")
        for name in ("least_relevance", "least_importance"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be from 0 to 100")
        if self.when_empty not in ("skip", "send_empty"):
            raise ValueError("when_empty must be skip or send_empty")


_REPLY = "category string, is_relevant boolean, importance_score int, relevance_score int, confidence double, entities array<string>, topic string"


def preprocess(articles: DataFrame, ctx: RunContext) -> DataFrame:
    """In the window (unknown dates pass), cleaned, each story once, no short titles."""
    start = ctx.now.timestamp() - ctx.lookback_days * 86400
    at = F.coalesce(F.col("published_at"), F.col("retrieved_at"))
    a = articles.filter(F.col("published_at").isNull() | F.col("published_at").between(F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(ctx.now.timestamp()))))
    a = a.withColumn("title", text.strip_tags(F.col("title"))).withColumn("content", text.clean(F.col("content"))).filter(F.length("title") >= 5)
    key = text.title_key(F.col("title"))
    a = cut(a.withColumn("_k1", urls.canonical_url(F.col("url"))).withColumn("_k3", F.when(F.length(key) > 20, key)).withColumn("at_us", F.unix_micros(at)))
    return dedup.greedy_distinct(a, "id", ["_k1", "content_hash", "_k3"]).drop("_k1", "_k3")


def classify(articles: DataFrame, ctx: RunContext, model: ModelClient) -> DataFrame:
    """Rules first; of what no rule decides, the newest ``model_budget`` articles go to the model, on the driver."""
    hit = rules.first_match(list(ctx.rules))
    title = F.coalesce("title", F.lit(""))
    # What the lexicons say of a title; the model's own answer goes first.
    a = articles.withColumn("entities", rules.topics(title, ctx.entities) if ctx.entities else F.array().cast("array<string>"))
    a = a.withColumn("topic", F.coalesce(F.try_element_at(rules.topics(title, ctx.topics), F.lit(1)), F.lit("OTHER")) if ctx.topics else F.lit("OTHER"))
    a = a.withColumn("title_l", F.lower("title")).withColumn("source_l", F.lower(F.coalesce("source_name", F.lit("")))).withColumn("hit", hit)
    known = a.filter("hit.rule != 'none'").select("id", F.col("hit.label").alias("category"), (F.col("hit.score") > 0).alias("is_relevant"), F.col("hit.score").alias("importance_score"), F.when(F.col("hit.score") > 0, 100).otherwise(0).alias("relevance_score"), F.lit(1.0).alias("confidence"), "entities", "topic")
    open_ = a.filter("hit.rule = 'none'").orderBy(F.desc_nulls_last("at_us"), "id").limit(ctx.model_budget).select("id", "title", text.wrap_untrusted(F.col("content"), 3000).alias("content"), "entities", "topic").collect()
    asked = [(r.id, model.classify(r.title, r.content or ""), r.entities, r.topic) for r in open_]
    spark = articles.sparkSession
    replies = spark.createDataFrame(asked, "id string, reply string, entities array<string>, topic string").withColumn("r", arrays.model_reply(F.col("reply"), _REPLY))
    told = replies.select("id", F.coalesce("r.category", F.lit("Other")).alias("category"), F.coalesce("r.is_relevant", F.lit(False)).alias("is_relevant"), F.coalesce("r.importance_score", F.lit(0)).alias("importance_score"), F.coalesce("r.relevance_score", arrays.percent(F.col("r.confidence")), F.lit(0)).alias("relevance_score"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("r.entities", "entities").alias("entities"), F.when(F.upper(F.trim("r.topic")) == "OTHER", "OTHER").when(F.trim("r.topic") != "", F.trim("r.topic")).otherwise(F.col("topic")).alias("topic"))
    return known.unionByName(told)


def build_events(articles: DataFrame, classes: DataFrame, ctx: RunContext) -> tuple[DataFrame, DataFrame]:
    """(events, event_articles): clusters of the relevant articles, each with its canonical article and provenance.

    An event's id follows from its members, so that it is the same in the next run.
    """
    good = classes.filter(F.col("is_relevant") & (F.col("relevance_score") >= ctx.least_relevance))
    a = cut(articles.join(good, "id"))
    rows = a.select(F.col("id").alias("node"), urls.url_key(F.col("url")).alias("url_key"), "content_hash", "topic", "at_us", text.title_words(F.col("title")).alias("title"), "entities", F.when(F.col("category") == "Competitor", F.try_element_at("entities", F.lit(1))).alias("competitor"))
    told = None
    if ctx.embed is not None and a.limit(3).count() == 3:
        told = vectors.embed(a.select(F.col("id").alias("node"), F.concat_ws(". ", "title", F.substring("content", 1, 500)).alias("text")), ctx.embed)
    c = cut(dedup.event_clusters(rows, generic=ctx.generic, concepts=ctx.concepts or None, vectors=told))
    ids = c.groupBy("component").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("node")), "|"), 256).alias("event_id"))
    links = cut(c.join(ids, "component").select("event_id", F.col("node").alias("article_id")))
    member = links.join(a.withColumnRenamed("id", "article_id"), "article_id")
    pick = dedup.canonical_pick(member.select("event_id", F.col("article_id").alias("id"), text.is_english(F.col("title"), F.col("language")).alias("english"), F.col("source_tier").alias("tier"), "content", "at_us"), "event_id")
    e = pick.join(a, "id").select("event_id", F.col("title").alias("canonical_title"), F.timestamp_micros("at_us").alias("event_date"), "category", F.lit(None).cast("string").alias("subcategory"), F.col("url").alias("canonical_url"), F.col("source_name").alias("canonical_source_name"), F.col("source_tier").alias("canonical_source_tier"), "importance_score", F.col("content").alias("body"), "members")
    said = member.join(e.select("event_id", F.col("canonical_source_tier").alias("event_tier"), F.col("canonical_url").alias("event_url")), "event_id")
    said = said.select("event_id", F.col("article_id").alias("seq"), "url", F.col("source_tier").alias("tier"), "event_tier", "event_url")
    prov = dedup.provenance(said, list(ctx.official), list(ctx.reputable))
    e = e.join(prov, "event_id").withColumnRenamed("status", "verification_status").withColumnRenamed("source", "verification_source").withColumnRenamed("event_id", "id")
    return e, links


def important(events: DataFrame, ctx: RunContext) -> DataFrame:
    return events.filter((F.col("importance_score") >= ctx.least_importance) & (F.length(F.trim("body")) >= 80) & (F.coalesce("category", F.lit("Other")) != "Other"))


def score(events: DataFrame, model: ModelClient) -> DataFrame:
    """Events with the model's importance where they have none; replies that are no JSON score 0."""
    rows = events.filter("importance_score is null").select("id", "canonical_title", text.wrap_untrusted(F.col("body"), 2000).alias("body")).collect()
    if not rows:
        return events
    told = events.sparkSession.createDataFrame([(r.id, model.score(r.canonical_title, r.body or "")) for r in rows], "id string, reply string")
    told = told.select("id", F.coalesce(arrays.model_reply(F.col("reply"), "importance_score int")["importance_score"], F.lit(0)).alias("_score"))
    return events.join(told, "id", "left").withColumn("importance_score", F.coalesce("importance_score", "_score")).drop("_score")


def translate(events: DataFrame, model: ModelClient) -> DataFrame:
    """Events of the digest with titles in English where they hold Arabic letters."""
    rows = events.filter(F.col("canonical_title").rlike("[\\u0600-\\u06FF]")).select("id", "canonical_title").collect()
    if not rows:
        return events
    told = events.sparkSession.createDataFrame([(r.id, model.translate(r.canonical_title)) for r in rows], "id string, _title string")
    return events.join(told, "id", "left").withColumn("canonical_title", F.coalesce(F.nullif(F.trim("_title"), F.lit("")), "canonical_title")).drop("_title")


def summarise(events: DataFrame, model: ModelClient) -> DataFrame:
    """Events with a valid summary.  The digest holds as many events as a reader can read, so they are summarised on the driver."""
    rows = events.select("id", "canonical_title", text.wrap_untrusted(F.col("body"), 4000).alias("body")).collect()
    told = events.sparkSession.createDataFrame([(r.id, model.summarise(r.canonical_title, r.body or "")) for r in rows], "id string, raw string")
    told = told.select("id", text.scrub_summary(F.col("raw")).alias("summary"))
    return events.join(told.filter(text.valid_summary(F.col("summary"))), "id")


def render(rows: list, ctx: RunContext) -> tuple[str, str, str]:
    """(subject, plain, html) of the events' rows: section by section, without any score."""
    days = ctx.lookback_days
    brief = next((n for low, high, n in dates.BRIEFS if (days <= high if low is None else low <= days <= high)), f"{days}-Day Brief")
    if not rows:
        return f"{brief} | no news", "There is no news for this period.", "<p>There is no news for this period.</p>"
    order = {s: i for i, s in enumerate(ctx.sections)}
    plain, page = [], []
    for section in sorted({r.category for r in rows}, key=lambda s: (order.get(s, len(order)), s)):
        plain.append(f"== {section} ==")
        page.append(f"<h2>{html.escape(section)}</h2>")
        for r in sorted((r for r in rows if r.category == section), key=lambda r: (-r.importance_score, r.id)):
            plain.append(f"{r.canonical_title}\n{r.summary}\n{r.canonical_source_name or ''} {r.canonical_url}\n")
            page.append(f'<h3><a href="{html.escape(r.canonical_url or "")}">{html.escape(r.canonical_title)}</a></h3><p>{html.escape(r.summary)}</p>')
    return f"{brief} | {len(rows)} events", "\n".join(plain), "\n".join(page)


def run(articles: DataFrame, ctx: RunContext, sent: DataFrame | None = None, links: DataFrame | None = None, stored: DataFrame | None = None, model: ModelClient | None = None, sink: Callable[[str, str, str, list[str]], bool] | None = None) -> dict:
    """Counters, digest and frames of a run; with a ledger (``sent``, ``links``, ``stored`` articles), what was sent is left out."""
    model = model or StubModel()
    clean = cut(preprocess(articles, ctx))
    classes = cut(classify(clean, ctx, model))
    events, pairs = build_events(clean, classes, ctx)
    events = cut(important(score(events, model), ctx))
    if sent is not None and links is not None and stored is not None:
        now = F.lit(int(ctx.now.timestamp() * 1e6))
        events = cut(ledger.unsent(events, sent, links.unionByName(pairs).distinct(), stored.select("id", "url").unionByName(clean.select("id", "url")).distinct(), now))
    told = cut(translate(summarise(events, model), model))
    rows = told.select("id", "category", "canonical_title", "summary", "canonical_source_name", "canonical_url", "importance_score").collect()
    subject, plain, page = render(rows, ctx)
    delivered = bool(sink and (rows or ctx.when_empty == "send_empty") and sink(subject, plain, page, list(ctx.recipients)))
    counters = {"collected": articles.count(), "preprocessed": clean.count(), "relevant": classes.filter("is_relevant").count(), "events": events.count(), "summaries": len(rows), "sent": len(rows) if delivered else 0}
    return {"counters": counters, "subject": subject, "plain": plain, "html": page, "delivered": delivered, "events": told, "links": pairs}
