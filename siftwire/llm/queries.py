"""The registered queries of the text operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import boilerplate, encoding, language, linking, lookalike, survivor, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(table(spark, d, "articles"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "articles"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return linking.variant_names(table(spark, d, "article_classifications"), table(spark, d, "competitors"), table(spark, d, "watch_people"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "news_events"), table(spark, d, "event_groups"), table(spark, d, "articles"), table(spark, d, "competitors"))


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return survivor.true_values(table(spark, d, "news_events"), table(spark, d, "event_groups"), table(spark, d, "articles"), table(spark, d, "competitors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "articles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, d, "articles")).select("article_id", "field")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, d, "articles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, d, "articles"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return tokens.pack_documents(table(spark, d, "documents"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return tokens.split_documents(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_segments, p2_found, p3_found, p4_found, p4_values, p6_found, p6_restored, p7_found, p8_ids, p9_containers, p10_pieces)}


def oracle_sql() -> dict[str, str]:
    """SQL cannot express these operators; they are tested against brute force and round trips in tests/llm."""
    return {}
