"""Ordered rules over text, gates, and their evaluation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One line of a rule table: it fires where each column holds one of its terms (``any_of``), none of ``none_of``, and one of each
    further list of ``all_of``, pairs of a column and terms."""

    name: str
    label: str
    any_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    none_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    score: int = 0
    all_of: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _one_of(c: Column, terms: tuple[str, ...]) -> Column:
    return F.coalesce(c.rlike("(?iu)" + "|".join(map(re.escape, terms))), F.lit(False))


def fires(rule: Rule) -> Column:
    out = F.lit(True)
    for c, terms in (*rule.any_of.items(), *rule.all_of):
        out = out & _one_of(F.col(c), terms)
    for c, terms in rule.none_of.items():
        out = out & ~_one_of(F.col(c), terms)
    return out


def first_match(rules: list[Rule], default: str = "OTHER") -> Column:
    """A struct (rule, label, score) of the first rule that fires: one nested CASE, whatever the number of rules."""
    hit = None
    for r in rules:
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.score).alias("score"))
        hit = F.when(fires(r), value) if hit is None else hit.when(fires(r), value)
    other = F.struct(F.lit("none").alias("rule"), F.lit(default).alias("label"), F.lit(0).alias("score"))
    return hit.otherwise(other) if hit is not None else other


def topics(c: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """The topics of which a text holds a term, in the lexicon's order."""
    return F.array_compact(F.array(*[F.when(_one_of(c, terms), F.lit(t)) for t, terms in lexicon.items()]))


def aliases_in(texts: DataFrame, text: str, aliases: list[str]) -> DataFrame:
    """Rows whose text holds one of the aliases as a word; aliases of up to three characters are passed over."""
    terms = sorted({a.strip() for a in aliases if a and len(a.strip()) > 3})
    if not terms:
        return texts.limit(0)
    return texts.filter(F.col(text).rlike("(?iuU)\\b(?:" + "|".join(map(re.escape, terms)) + ")\\b"))


def relevance_gate(articles: DataFrame, classes: DataFrame, least: int = 50) -> DataFrame:
    """Articles with a class that is relevant and scores at least ``least``."""
    good = classes.filter(F.col("is_relevant") & (F.col("relevance_score") >= least)).select("article_id").distinct()
    return articles.join(good, articles["id"] == good["article_id"], "left_semi")


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: n, hits, accuracy (three digits) of the rows that have a label and a prediction."""
    both = rows.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    n = both.agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(predicted)).alias("hits"))
    return n.select("n", "hits", F.round(F.try_divide("hits", "n"), 3).alias("accuracy"))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 (three digits, 0 where undefined)."""
    y, p = F.coalesce(F.col(label), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    n = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.select("tp", "fp", "fn", "tn", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 3).alias("f1"))
