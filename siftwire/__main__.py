"""``python -m siftwire``: one run over landed feeds."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftwire", description="Turn landed feeds into a digest.")
    p.add_argument("feeds", help="folder of JSON feeds")
    p.add_argument("out", help="folder of tables and digest")
    p.add_argument("--days", type=int, default=7)
    p.add_argument("--one-day", action="store_true", help="the last day alone, whatever --days says")
    p.add_argument("--fallback", default=None, help="folder of feeds that are read where the first has none")
    p.add_argument("--force-fallback", action="store_true", help="read the fallback at once")
    p.add_argument("--ignore-sent", action="store_true")
    p.add_argument("--run-id", default=None)
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .context import cut, ship
    from .operators import ledger
    from .plans import pipeline
    from .plans.text_queries import RULES
    from .sources import feeds, sinks

    spark = SparkSession.builder.appName("siftwire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    spark.dataSource.register(feeds.FeedSource)
    now = datetime.now(timezone.utc)
    ctx = pipeline.RunContext(a.run_id or now.strftime("%Y%m%dT%H%M%S"), now, tuple(RULES), lookback_days=1 if a.one_day else a.days)
    sinks.create_tables(spark, a.out)
    sinks.record_run(spark, a.out, ctx.run_id, now)
    read = lambda folder: spark.read.format("landed_feed").load(folder).filter("error is null")
    if a.force_fallback and not a.fallback:
        p.error("--force-fallback needs --fallback")
    raw = read(a.feeds) if not a.fallback else feeds.primary_or_fallback(None if a.force_fallback else read(a.feeds), read(a.fallback))
    articles = feeds.make_articles(raw, F.timestamp_seconds(F.lit(now.timestamp())))
    # What is stored keeps its id; only what is not is added.
    known = sinks.stored(spark, a.out, "articles")
    new, articles = ledger.insert_absent(known, articles, "url")
    old = {} if a.ignore_sent else {
        "sent": sinks.stored(spark, a.out, "sent_news").select(F.col("event_id").alias("id"), "canonical_url", "canonical_title", F.unix_micros("sent_at").alias("sent_us")),
        "links": sinks.stored(spark, a.out, "event_articles"), "stored": known,
    }
    try:
        result = pipeline.run(articles, ctx, sink=sinks.file_sink(a.out), **old)
        if result["delivered"]:
            sinks.record_events(result["events"], result["links"], a.out, ctx.run_id, ",".join(ctx.recipients), now)
        sinks.put(cut(new), a.out, "articles", ctx.run_id)
    except Exception as e:
        sinks.record_run(spark, a.out, ctx.run_id, now, datetime.now(timezone.utc), error=f"{type(e).__name__}: {e}"[:500])
        raise
    sinks.record_run(spark, a.out, ctx.run_id, now, datetime.now(timezone.utc), result["counters"]["sent"], result["counters"])
    print(result["subject"], result["counters"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
