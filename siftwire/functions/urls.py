"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")
#: The same and the parameters that search feeds add.
FEED_TRACKING = (*TRACKING, "oc", "hl", "gl", "ceid")

_URL = "^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query, 5 fragment."""
    return F.regexp_extract(url, _URL, i)


def _kept(query: Column, drop: tuple[str, ...]) -> Column:
    """The parameters of a query that have a value and are not in ``drop``, re-encoded, as structs (key, value)."""
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))
    pairs = F.transform(pairs, lambda x: F.struct(_decode(x["k"]).alias("k"), _decode(F.substr(x["p"], F.length(x["k"]) + 2)).alias("v")))
    return F.filter(pairs, lambda x: (x["v"] != "") & ~F.lower(x["k"]).isin(*drop))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda x: F.concat(_encode(x["k"]), F.lit("="), _encode(x["v"]))), "&")


def _query(q: Column) -> Column:
    return F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")


def canonical_url(url: Column) -> Column:
    """The one spelling of a URL: no tracking or blank parameters, the others sorted by key (equal keys keep their order), lower-case
    scheme and host, no trailing slash but the root's, no fragment.  Null gives an empty string."""
    u = F.trim(F.coalesce(url, F.lit("")))
    pairs = _kept(part(u, 4), FEED_TRACKING)
    numbered = F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v")))
    q = _joined(F.array_sort(numbered))
    path = F.when(part(u, 3) == "/", "/").otherwise(F.regexp_replace(part(u, 3), "/+$", ""))
    head = F.when(part(u, 1) != "", F.concat(F.lower(part(u, 1)), F.lit(":"))).otherwise("")
    host = F.when(part(u, 2) != "", F.concat(F.lit("//"), F.lower(part(u, 2)))).otherwise("")
    return F.concat(head, host, path, _query(q))


def strip_tracking(url: Column) -> Column:
    """A URL without tracking and blank parameters; the rest keeps its order, the fragment stays."""
    u = F.coalesce(url, F.lit(""))
    bare = F.regexp_extract(u, "^([^?#]*)", 1)
    fragment = F.regexp_extract(u, "(#.*)$", 1)
    return F.concat(bare, _query(_joined(_kept(part(u, 4), TRACKING))), fragment)


def url_key(url: Column, bilingual_hosts: tuple[str, ...] = ()) -> Column:
    """What two URLs of one page share: no scheme, www, query, fragment or trailing slash, lower case; on ``bilingual_hosts`` also
    no /en/ step."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "(?i)^https?://(?:www\\.)?", "")
    if bilingual_hosts:
        hosts = "|".join(h.replace(".", "\\.") for h in bilingual_hosts)
        u = F.regexp_replace(u, f"(?i)({hosts})/en/", "$1/")
    u = F.substring_index(F.substring_index(u, "#", 1), "?", 1)
    return F.lower(F.regexp_replace(u, "/+$", ""))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(F.coalesce(url, F.lit("")), 2)), "^www\\.", "")


def contains_any(text: Column, patterns: list[str]) -> Column:
    """Whether the text holds any of the patterns as plain strings, whatever the case."""
    import re

    return F.coalesce(text.rlike("(?iu)" + "|".join(re.escape(p) for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def date_of_path(url: Column) -> Column:
    """Noon UTC, in seconds since 1970, of a /YYYY/MM/DD/ or /YYYY/MM/ path; null without one."""
    y, m, d = (F.regexp_extract(F.coalesce(url, F.lit("")), "/((?:19|20)\\d{2})/(\\d{1,2})(?:/(\\d{1,2}))?/", i) for i in (1, 2, 3))
    day = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(F.when(d != "", d).otherwise("1"), 2, "0")).try_cast("date")
    return F.unix_date(day).cast("bigint") * 86400 + 43200


def feed_url(base: str, query: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(query))
