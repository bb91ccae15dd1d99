"""Articles as a stream: late rows, repeats across batches, the ledger, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..context import exists
from ..functions import text, urls
from ..schemas import ARTICLE


def article_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Landed JSON files as a stream of articles; ``event_time`` is the publication, else the retrieval (``imputed``)."""
    s = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return s.withColumn("imputed", F.col("published_at").isNull()).withColumn("event_time", F.coalesce("published_at", "retrieved_at"))


def distinct_stream(articles: DataFrame, late: str = "168 hours") -> DataFrame:
    """Each page once within ``late``; what comes later than that is dropped by the watermark, and so is its state."""
    keyed = articles.withColumn("url_key", urls.url_key(F.col("url")))
    return keyed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["url_key"])


def quiet_titles(articles: DataFrame, hours: int = 48) -> DataFrame:
    """Each title once within ``hours``."""
    keyed = articles.withColumn("title_key", text.title_key(F.col("title")))
    return keyed.withWatermark("event_time", f"{hours} hours").dropDuplicatesWithinWatermark(["title_key"])


def counts(articles: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "6 hours") -> DataFrame:
    """Articles by source and window, final once the watermark has passed."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    return articles.withWatermark("event_time", late).groupBy(w.alias("w"), "source_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source_id", "n")


def sessions(articles: DataFrame, gap: str = "30 minutes", late: str = "6 hours") -> DataFrame:
    return articles.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "source_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source_id", "n")


def ledger_writer(folder: str, deliver: Callable[[DataFrame, int], None] = lambda df, batch: None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: what the ledger lacks is delivered, then recorded under the batch's number.

    Delivery comes before the record, so a failure in between sends again; a batch that is recorded is not sent twice.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark, out = df.sparkSession, f"{folder}/batch={batch}"
        if exists(spark, f"{out}/_SUCCESS"):
            return
        new = df.dropDuplicates(["url_key"])
        if exists(spark, folder):
            # A part that broke off holds what was not recorded, so it does not count: this batch's own.
            before = spark.read.schema("url_key string, id string, title string, batch bigint").parquet(folder).filter(F.col("batch") != batch)
            new = new.join(before.select("url_key"), "url_key", "left_anti")
        new = new.persist()
        deliver(new, batch)
        new.select("url_key", "id", "title").write.mode("overwrite").parquet(out)
        new.unpersist()

    return write


#: How often a schedule runs, as the interval of a micro-batch trigger.
INTERVALS = {"hourly": "1 hour", "daily": "1 day", "weekly": "7 days", "biweekly": "14 days", "monthly": "30 days"}


def trigger(schedule: str) -> dict[str, str | bool]:
    """The trigger of a schedule, for ``DataStreamWriter.trigger``: one of INTERVALS, an interval of its own ("90 minutes"), or "once",
    which takes all there is and stops."""
    if schedule == "once":
        return {"availableNow": True}
    if schedule not in INTERVALS and not schedule.split(" ", 1)[0].isdigit():
        raise ValueError(f"unknown schedule {schedule!r}")
    return {"processingTime": INTERVALS.get(schedule, schedule)}


def run_always(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], schedule: str = "hourly") -> StreamingQuery:
    """The same on a schedule, until it is stopped."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger(schedule)).start()


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All that is there, in batches, then stop: the shape of a scheduled run."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
