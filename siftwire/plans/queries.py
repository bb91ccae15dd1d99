"""The registered queries of the core, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import timestamps
from ..sources.tables import table
from . import catalogue_queries, relational_queries


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_timestamps(table(spark, d, "articles"), table(spark, d, "sources"))


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.zone_report(table(spark, d, "articles"), table(spark, d, "sources"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational_queries.QUERIES | catalogue_queries.QUERIES | {f.__name__: f for f in (p5_found, p5_zones)}


def oracle_sql() -> dict[str, str]:
    return relational_queries.SQL | catalogue_queries.SQL
