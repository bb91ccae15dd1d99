"""Where results go: stored tables, and the delivery of a digest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import exists, write_text
from ..schemas import TABLES


def create_tables(spark: SparkSession, folder: str) -> None:
    """An empty table for every name of the schema that is not there yet."""
    for name, ddl in TABLES.items():
        if not exists(spark, f"{folder}/{name}"):
            spark.createDataFrame([], ddl).write.parquet(f"{folder}/{name}/part=none")


def drop_tables(spark: SparkSession, folder: str) -> None:
    from ..context import file_system

    for name in TABLES:
        fs, p = file_system(spark, f"{folder}/{name}")
        fs.delete(p, True)


def _columns(name: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in TABLES[name].replace("map<string,bigint>", "map").split(",")]


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}").select(*_columns(name))


def put(df: DataFrame, folder: str, name: str, part: str) -> None:
    """What a run adds to a table is one partition of it: written again, it takes its own place, so a repeated run adds nothing twice."""
    df.select(*_columns(name)).write.mode("overwrite").parquet(f"{folder}/{name}/part={part}")


def record_events(events: DataFrame, links: DataFrame, folder: str, run_id: str, recipient: str, now) -> int:  # noqa: ANN001
    """Record events, links and ledger of a run, rows without a title or summary and events of other runs left out.

    The ledger comes last: a run that has it is passed over, one that broke off before is written again from the start.
    """
    spark = events.sparkSession
    if exists(spark, f"{folder}/sent_news/part={run_id}/_SUCCESS"):
        return 0
    before = stored(spark, folder, "sent_news").filter(F.col("run_id") != run_id).select(F.col("event_id").alias("id")).distinct()
    good = events.filter("canonical_title is not null and summary is not null").join(before, "id", "left_anti").persist()
    put(good, folder, "events", run_id)
    put(links.join(good.select(F.col("id").alias("event_id")), "event_id", "left_semi").distinct(), folder, "event_articles", run_id)
    sent = good.select(F.col("id").alias("event_id"), "canonical_url", "canonical_title", F.lit(now).cast("timestamp").alias("sent_at"), F.lit(recipient).alias("recipient"), F.lit(run_id).alias("run_id"))
    put(sent.dropDuplicates(["event_id"]), folder, "sent_news", run_id)
    n = good.count()
    good.unpersist()
    return n


def record_run(spark: SparkSession, folder: str, run_id: str, started, completed=None, sent: int = 0, counters: dict[str, int] | None = None, error: str | None = None) -> None:  # noqa: ANN001
    """A line of the run log: RUNNING at its start, and one in its place when it ends, with the status that follows from error and
    number sent."""
    from ..operators.ledger import run_status

    row = spark.createDataFrame([(run_id, started, completed, None, sent, counters or {}, error)], TABLES["workflow_runs"])
    status = run_status(F.col("error"), F.col("events_sent"))
    put(row.withColumn("status", F.when(F.col("completed_at").isNull(), "RUNNING").otherwise(status)), folder, "workflow_runs", run_id)


Sink = Callable[[str, str, str, list[str]], bool]


def file_sink(folder: str) -> Sink:
    """Writes the digest as text and HTML to the store that Spark itself uses for the folder."""

    def send(subject: str, plain: str, html: str, to: list[str]) -> bool:
        spark = SparkSession.active()
        for name, body in (("digest.txt", f"{subject}\n\n{plain}"), ("digest.html", html)):
            write_text(spark, f"{folder}/{name}", body)
        return True

    return send


def payload_sink(post: Callable[[str], bool]) -> Sink:
    """Hands a JSON payload to ``post`` (a webhook client, say)."""
    return lambda subject, plain, html, to: post(json.dumps({"subject": subject, "text": plain, "html": html, "to": to}, ensure_ascii=False))


SINKS: dict[str, Callable[..., Sink]] = {"file": file_sink, "payload": payload_sink}
