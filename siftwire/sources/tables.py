"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..context import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; zone-less timestamps are taken as UTC once, here."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    if zoneless:
        df = df.withColumns({c: utc(c) for c in zoneless})
    return df


def utc(c: str):
    """A ``timestamp_ntz`` column as the instant it denotes in UTC, whatever the session's zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c)))


def labelled(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A labelled set: JSON files that each hold an array of records; fields that are missing are null."""
    return spark.read.schema(ddl).json(path, multiLine=True)


def seeded(stored: DataFrame, seed: DataFrame, key: str = "name", id_: str = "id") -> DataFrame:
    """``stored`` after a seed load: rows of the seed win by ``key`` and keep their stored id, new ones follow the greatest id, and what
    the seed no longer names is switched off (``active``).  Seeds are small registers; numbering the new rows is one ordered window.
    """
    from pyspark.sql import Window

    from ..operators import ledger

    known = stored.select(key, F.col(id_).alias("_id"))
    rows = seed.drop(id_).dropDuplicates([key]).join(known, key, "left")
    last = stored.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_last"))
    fresh = rows.filter("_id is null").join(last).withColumn("_id", (F.col("_last") + F.row_number().over(Window.orderBy(key))).cast(stored.schema[id_].dataType)).drop("_last")
    delta = rows.filter("_id is not null").unionByName(fresh).withColumnRenamed("_id", id_)
    return ledger.deactivate_missing(ledger.upsert(stored, delta.select(stored.columns), key), seed, key)
