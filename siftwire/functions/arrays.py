"""Array, vector and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_overlap(a: Column, b: Column) -> Column:
    """Whether two lists share at least half of the shorter one (one at least), whatever the case; empty lists never do."""
    x, y = (F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)) for c in (a, b))
    least = F.greatest(F.lit(1), F.floor(F.least(F.size(x), F.size(y)) / 2))
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= least)


def without(a: Column, generic: list[str]) -> Column:
    return F.filter(a, lambda e: ~F.lower(e).isin(*[g.lower() for g in generic]))


def first_terms(name: Column, aliases: Column, k: int) -> Column:
    """The first ``k`` distinct terms of a name and its aliases, each split at slashes."""
    every = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    terms = F.flatten(F.transform(every, lambda x: F.transform(F.split(x, "/"), F.trim)))
    return F.slice(F.array_distinct(F.filter(terms, lambda t: t != "")), 1, k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def percent(c: Column) -> Column:
    return (c * 100).cast("int")


def model_reply(c: Column, ddl: str) -> Column:
    """A model's JSON reply as a struct; null where it is none."""
    from .text import strip_fence

    return F.from_json(strip_fence(c), ddl)
