"""What was delivered already, upserts, and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unsent(events: DataFrame, sent: DataFrame, links: DataFrame, articles: DataFrame, now_us: Column | None = None, hours: int = 48) -> DataFrame:
    """Events that the ledger does not hold: not by id, canonical URL, any article's URL, nor by title within ``hours``.

    Four equi anti-joins; one with an OR of conditions would be a nested loop.  ``events``/``sent``: id, canonical_url,
    canonical_title (and ``sent_us`` of the ledger); ``links``: event_id, article_id; ``articles``: id, url.
    """
    out = events.join(sent.select("id"), "id", "left_anti")
    out = out.join(sent.select("canonical_url").filter("canonical_url is not null"), "canonical_url", "left_anti")
    urls = links.join(articles.select(F.col("id").alias("article_id"), "url"), "article_id").select("event_id", "url").distinct()
    seen = urls.join(sent.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("url").distinct()
    again = urls.join(seen, "url", "left_semi").select(F.col("event_id").alias("id")).distinct()
    out = out.join(again, "id", "left_anti")
    recent = sent if now_us is None else sent.filter(F.col("sent_us") >= now_us - hours * 3_600_000_000)
    titles = recent.select(F.lower("canonical_title").alias("_t")).filter("_t is not null").distinct()
    return out.join(titles, F.lower(F.trim("canonical_title")) == F.col("_t"), "left_anti")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``delta``, which win by key."""
    both = base.withColumn("_v", F.lit(0)).unionByName(delta.withColumn("_v", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_v"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_v")


def insert_absent(stored: DataFrame, batch: DataFrame, key: str, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, the batch with the stored ids): rows whose key is stored take over its id."""
    known = stored.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias("_stored"))
    joined = batch.join(known, key, "left")
    mapped = joined.withColumn(id_, F.coalesce("_stored", id_)).drop("_stored")
    return joined.filter("_stored is null").drop("_stored").dropDuplicates([key]), mapped


def deactivate_missing(stored: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """``stored`` with ``active`` false where the seed lacks the key."""
    marked = stored.join(seed.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return marked.withColumn("active", F.coalesce("active", F.lit(False)) & F.col("_in").isNotNull()).drop("_in")


def run_status(error: Column, sent: Column) -> Column:
    return F.when(error.isNotNull() & (F.coalesce(sent, F.lit(0)) == 0), "FAILED").when(error.isNotNull(), "PARTIAL").otherwise("COMPLETED")


def last_good_run(runs: DataFrame) -> DataFrame:
    """One row: the start of the latest run that ended well and sent something."""
    return runs.filter(F.col("status").isin("COMPLETED", "PARTIAL") & (F.col("events_sent") > 0)).agg(F.max("started_us").alias("started_us"))
