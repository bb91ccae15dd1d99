"""Mixed timestamp notations to one instant in UTC.

Everything runs as Catalyst expressions: the notation is matched by one regular expression per
family and rewritten to ``year|month|day|hour|minute|second|fraction|half|zone``, which is split
once.  Where a text carries no zone, it is read in the offset history of its source: for each source and period of 28 days, every
candidate zone is charged for the wall clocks that it would set after their ingestion, for unlikely lags and for offsets that
the source itself wrote; the cheapest path through the periods is the history.  A declared zone is where the search starts.

Defined results: null, blank, impossible dates (30 February, hour 25) and notations without an
instant give null; repeated rows give one row; a local time that occurs twice means the first one,
a skipped one is read with the offset before the change; extra columns are ignored.
"""

from __future__ import annotations

import math
import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import cut

#: Names of the Gregorian months, January to December, by language.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "tr": "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık",
    "ar": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر",
    "ar_bare": "يناير فبراير مارس ابريل مايو يونيه يوليه اغسطس سبتمبر اكتوبر نوفمبر ديسمبر",
    "fa": "ژانویه فوریه مارس آوریل مه ژوئن ژوئیه اوت سپتامبر اکتبر نوامبر دسامبر",
}
#: Hours east of UTC of zone abbreviations that feeds use.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "bst": 1, "west": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3,
    "msk": 3, "trt": 3, "irst": 3.5, "gst": 4, "ist": 5.5,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}
#: Seconds of the units in which ages are told; Arabic duals and bare units carry their own number.
UNITS = {
    "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800,
    "ثانية": 1, "ثوان": 1, "ثواني": 1, "دقيقة": 60, "دقائق": 60, "ساعة": 3600, "ساعات": 3600,
    "يوم": 86400, "يوما": 86400, "أيام": 86400, "أسبوع": 604800, "أسابيع": 604800,
    "دقيقتين": 120, "ساعتين": 7200, "يومين": 172800, "أسبوعين": 1209600,
}

DAY_US = 86_400_000_000
_ZONE = r"\s*(z|\[?[a-z]+(?:/[a-z_+-]+[0-9]*){1,2}\]?|\[?[a-z]{2,4}\]?(?:[+-]\d{1,2}(?::?\d{2})?)?|[+-]\d{1,2}(?::?\d{2})?)?"
_WEEKDAY = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"
_MON = r"([^\W\d_]{2,12})\.?"
_CLOCK = r"(?:[,،]?\s*(?:à|um|at|-)?\s*(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(am|pm|a\.m\.|p\.m\.|ص|م)?(?:\s*uhr)?)?"
#: (pattern, rewriting): the groups go to year|month|day|hour|minute|second|fraction|half|zone.
FAMILIES = [
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[t ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?" + _ZONE, "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})" + _ZONE, "$1|$2|$3|$4|$5|$6|||$7"),
    (r"(\d{1,2})(/)(\d{1,2})/(\d{4})" + _CLOCK + _ZONE, "$4|$1/$3|/|$5|$6|$7|$8|$9|$10"),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})" + _CLOCK + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (_WEEKDAY + r"(\d{1,2})\.?[\s-]+" + _MON + r"[\s-]+(\d{4})" + _CLOCK + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (_WEEKDAY + _MON + r"\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (_WEEKDAY + _MON + r"\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(\d{4})" + _ZONE, "$6|$1|$2|$3|$4|$5|||$7"),
]
_AGE = r"^(?:منذ\s+)?(\d*)\s*([^\W\d_]+?)s?(?:\s+ago)?$"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def plain(text: Column) -> Column:
    """Trimmed lower-case text with ASCII digits, single blanks and no invisible marks."""
    t = F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    t = F.regexp_replace(t, "[\\u200b-\\u200f\\u202a-\\u202e\\u2060\\u061c\\ufeff\\u00ad]", "")
    return F.lower(F.trim(F.regexp_replace(t, "(?U)\\s+", " ")))


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a one-row generator: no later filter is pushed through and no expression is copied into it."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def parse(rows: DataFrame, text: str, zone: str, seen_us: str) -> DataFrame:
    """``rows`` with what ``text`` says: ``local_us`` (its wall clock as if it were UTC), ``offset_us`` or ``own_zone`` where the
    text carries one, and ``own_us`` where the text denotes an instant by itself (epoch numbers, ages told back from ``seen_us``).

    ``zone`` names the column with the zone of the source: slashed dates are month-first where it begins with ``America/``.
    The steps are columns of their own, as each is read more than once by the next.
    """
    number = lambda c: F.when(c.rlike("^\\d{1,9}$"), c.cast("bigint"))
    at = lambda i: F.get(F.col("_part"), F.lit(i))
    s, z, digits, width = F.col("_s"), F.col("_z"), F.col("_digits"), F.length("_digits")
    kept = rows.columns
    rows = rows.withColumn("_s", plain(F.col(text)))
    rows = rows.withColumn("_part", F.split(F.coalesce(*[F.when(s.rlike(f"(?Ui)^{p}$"), F.regexp_replace(s, f"(?Ui)^{p}$", r)) for p, r in FAMILIES]), "\\|", -1))
    rows = _settled(rows)

    names = {name: i + 1 for names in MONTHS.values() for i, name in enumerate(names.split())} | {"sept": 9}
    slashed, american = at(2) == "/", F.coalesce(F.col(zone).startswith("America/"), F.lit(False))
    first, second = F.split_part(at(1), F.lit("/"), F.lit(1)), F.split_part(at(1), F.lit("/"), F.lit(2))
    rows = rows.withColumns({
        "_word": F.when(slashed, F.when(american, first).otherwise(second)).otherwise(at(1)),
        "_day": number(F.when(slashed, F.when(american, second).otherwise(first)).otherwise(at(2))),
        "_half": F.when(at(7).isin("pm", "p.m.", "م"), 1).when(at(7).isin("am", "a.m.", "ص"), 0),
        "_hour": F.coalesce(number(at(3)), F.lit(0)),
        "_minute": F.coalesce(number(at(4)), F.lit(0)),
        "_second": F.coalesce(number(at(5)), F.lit(0)),
        "_fraction": F.coalesce(number(F.rpad(F.substring(at(6), 1, 6), 6, "0")), F.lit(0)),
        "_z": F.coalesce(F.regexp_replace(at(8), "[\\[\\]]", ""), F.lit("")),
    })
    rows = rows.withColumns({
        "_month": F.coalesce(number(F.col("_word")), F.try_element_at(_map(names), F.col("_word"))),
        "_hour": F.when(F.col("_half").isNull(), F.when(F.col("_hour") <= 23, F.col("_hour"))).when(F.col("_hour").between(1, 12), F.col("_hour") % 12 + 12 * F.col("_half")),
        "_digits": F.regexp_replace(F.regexp_extract(z, "([+-][\\d:]+)$", 1), ":", ""),
    })
    rows = _settled(rows)
    date = F.concat_ws("-", F.lpad(at(0), 4, "0"), F.lpad(F.col("_month").cast("string"), 2, "0"), F.lpad(F.col("_day").cast("string"), 2, "0")).try_cast("date")
    clock = F.when((F.col("_minute") <= 59) & (F.col("_second") <= 59), ((F.col("_hour") * 60 + F.col("_minute")) * 60 + F.col("_second")) * 1_000_000 + F.col("_fraction"))
    rows = rows.withColumns({
        "local_us": F.when(F.col("_month").isNotNull() & F.col("_day").isNotNull(), F.unix_date(date)).cast("bigint") * DAY_US + clock,
        "_oh": F.when(width == 4, number(F.substring(digits, 2, 1))).otherwise(number(F.substring(digits, 2, 2))),
        "_om": F.when(width >= 4, number(F.substring(digits, -2, 2))).otherwise(0),
        "own_zone": F.when(z.contains("/"), F.try_element_at(_map({n.lower(): n for n in sorted(zoneinfo.available_timezones()) if "/" in n}), z)),
    })
    numeric = F.when((F.col("_oh") <= 18) & (F.col("_om") <= 59), (F.col("_oh") * 60 + F.col("_om")) * 60_000_000 * F.when(digits.startswith("-"), -1).otherwise(1))
    abbreviation = F.try_element_at(_map({k: int(v * 3_600_000_000) for k, v in ABBREVIATIONS.items()}), z)
    rows = rows.withColumn("offset_us", F.when((width > 0) & F.regexp_extract(z, "^([a-z]*)", 1).isin("", "utc", "gmt"), numeric).otherwise(abbreviation))
    rows = rows.withColumn("local_us", F.when((z == "") | F.col("offset_us").isNotNull() | F.col("own_zone").isNotNull(), F.col("local_us")))

    unit = F.try_element_at(_map(UNITS), F.regexp_extract(s, "(?U)" + _AGE, 2))
    count = F.coalesce(number(F.regexp_extract(s, "(?U)" + _AGE, 1)), F.lit(1))
    rows = rows.withColumn("own_us", F.when(s.rlike("^\\d{9,10}$"), s.try_cast("bigint") * 1_000_000)
        .when(s.rlike("^\\d{12,13}$"), s.try_cast("bigint") * 1000)
        .when(s.rlike("^\\d{15,16}$"), s.try_cast("bigint"))
        .when(s.rlike("(?U)^(منذ\\s.*|.*\\sago)$"), F.col(seen_us) - count * unit * 1_000_000))
    return _settled(rows.select(*kept, "local_us", "offset_us", "own_zone", "own_us"))


def epoch_us(zone: str) -> Column:
    """The instant in microseconds of a ``parse`` row; the column ``zone`` counts only where the text carries no zone."""
    named = F.coalesce(F.col("own_zone"), F.col(zone))
    return F.coalesce("own_us", F.col("local_us") - F.col("offset_us"), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("local_us"), named)))


#: Candidate zones besides those that sources declare.
DEFAULT_ZONES = ("UTC", "Europe/London", "Europe/Paris", "Europe/Istanbul", "Africa/Cairo", "Asia/Riyadh", "Asia/Tehran", "Asia/Dubai", "America/New_York", "America/Los_Angeles")
#: Length of a period of a history.
PERIOD_US = 28 * DAY_US
#: Costs in nats: a wall clock after its ingestion or against a written offset; a change of zone; a zone other than the declared one.
VIOLATION, CHANGE, UNDECLARED = 8.0, 20.0, 40.0
#: Seconds that a clock may be ahead of ingestion; and the edges, in seconds, between which lags count as equally likely.
SLACK_S = 300
LAGS = (0, 300, 900, 1800, 3600, 7200, 10800, 14400, 21600, 28800, 43200, 86400, 172800, 604800)


def lag_costs(parsed: DataFrame) -> list[float]:
    """Nats of a lag in each bin of LAGS (the last is open), learned from the texts that denote an instant by themselves.

    One count per bin; one more of each keeps unseen lags possible.
    """
    instant = F.coalesce("own_us", F.col("local_us") - F.col("offset_us"))
    lag = (F.col("seen_us") - instant) / 1_000_000
    bin_ = sum((F.when(lag >= e, 1).otherwise(0) for e in LAGS[1:]), F.lit(0))
    got = {r.bin: r["count"] for r in parsed.filter(instant.isNotNull() & F.col("seen_us").isNotNull() & (lag >= -SLACK_S)).groupBy(bin_.alias("bin")).count().collect()}
    widths = [b - a for a, b in zip(LAGS, (*LAGS[1:], 2 * LAGS[-1]))]
    total = sum(got.values()) + len(LAGS)
    # Per hour: what the tasks sum stays small.
    return [-math.log((got.get(i, 0) + 1) / total / w * 3600) for i, w in enumerate(widths)]


def offset_histories(parsed: DataFrame, candidates: list[str], costs: list[float]) -> DataFrame:
    """(source_id, period, zone, violations, rows): the zone of each source in each period of its texts.

    ``parsed``: source_id, declared, local_us, alt_us (the other reading of a slashed date), offset_us, seen_us.  Texts without a zone
    are charged for their lag (``lag_costs``), VIOLATION if they come after their ingestion; offsets that a source wrote,
    other than zero, cost VIOLATION where a zone has another one.  Bare dates tell nothing.  One partial aggregate per source, period
    and task, so a hot source costs no skew; a source's path is found from one row per period.
    """
    lag_nats = F.array(*map(F.lit, costs))
    written = F.col("offset_us").isNotNull()
    told = F.when(written, F.col("offset_us") != 0).otherwise(F.col("seen_us").isNotNull() & (F.coalesce("local_us", "alt_us") % DAY_US != 0))

    def charge(z: str) -> Column:
        local = F.coalesce("alt_us", "local_us") if z.startswith("America/") else F.col("local_us")
        at = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), z))
        lag = (F.col("seen_us") - at) / 1_000_000
        bin_ = sum((F.when(lag >= e, 1).otherwise(0) for e in LAGS[1:]), F.lit(0))
        mute = F.when(at.isNull() | (lag < -SLACK_S), VIOLATION).otherwise(F.get(lag_nats, bin_))
        return F.when(written, F.when(local - at == F.col("offset_us"), 0.0).otherwise(VIOLATION)).otherwise(mute)

    rows = parsed.filter("source_id is not null and own_us is null and own_zone is null and coalesce(local_us, alt_us) is not null")
    late = lambda z: F.coalesce(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.coalesce("alt_us", "local_us") if z.startswith("America/") else F.col("local_us")), z)) > F.col("seen_us") + SLACK_S * 1_000_000, F.lit(False))
    sums = rows.groupBy("source_id", F.floor(F.coalesce("local_us", "alt_us") / PERIOD_US).alias("period")).agg(
        F.min("declared").alias("declared"),
        F.count_if(~written).alias("rows"),
        F.array(*[F.coalesce(F.sum(F.when(told, charge(z))), F.lit(0.0)) for z in candidates]).alias("cost"),
        F.array(*[F.count_if(told & ~written & late(z)) for z in candidates]).alias("late"),
    )
    kind = parsed.schema["source_id"].dataType.simpleString()

    def path(pdf):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("period", ignore_index=True)
        cost, late = np.stack(pdf.cost.to_list()), np.stack(pdf.late.to_list())
        start = np.array([0.0 if z == pdf.declared[0] or pd.isna(pdf.declared[0]) else UNDECLARED for z in candidates])
        best, back = start + cost[0], []
        for c in cost[1:]:
            low = int(best.argmin())
            moved = best[low] + CHANGE < best
            back.append(np.where(moved, low, np.arange(len(candidates))))
            best = np.where(moved, best[low] + CHANGE, best) + c
        at = [int(best.argmin())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        at.reverse()
        return pd.DataFrame({"source_id": pdf.source_id, "period": pdf.period, "zone": [candidates[i] for i in at], "violations": late[np.arange(len(at)), at], "rows": pdf["rows"]})

    return sums.groupBy("source_id").applyInPandas(path, f"source_id {kind}, period bigint, zone string, violations bigint, rows bigint")


def candidate_zones(sources: DataFrame) -> list[str]:
    """Zones to try: those that any source declares (at most one per zone of the tz database) and DEFAULT_ZONES."""
    known = zoneinfo.available_timezones()
    return sorted(({r[0] for r in sources.select("time_zone").distinct().collect()} & known) | set(DEFAULT_ZONES))


def readings(rows: DataFrame, text: str) -> DataFrame:
    """``parse`` of rows with ``declared`` and ``seen_us``, written once, with ``alt_us``: where no zone is declared, the month-first
    reading of a slashed date, which is day-first in ``local_us``."""
    slashed = F.coalesce(F.col(text).rlike("^\\s*\\d{1,2}/\\d{1,2}/\\d{4}"), F.lit(False)) & F.col("declared").isNull() & F.col("source_id").isNotNull()
    none = F.lit(None).cast("bigint")
    if rows.filter(slashed).isEmpty():  # the same result with one reading
        return cut(parse(rows, text, "declared", "seen_us").withColumn("alt_us", none).drop(text))
    plain_ = parse(rows.filter(~slashed), text, "declared", "seen_us").withColumn("alt_us", none)
    kept = [*plain_.columns]
    open_ = parse(rows.filter(slashed), text, "declared", "seen_us").withColumn("_month_first", F.lit("America/"))
    first, offset, own = open_.withColumnsRenamed({"local_us": "_day_first", "offset_us": "_first_offset", "own_zone": "_first_zone", "own_us": "_first_own"}), F.col("_first_offset"), F.col("_first_zone")
    both = parse(first, text, "_month_first", "seen_us").withColumns({"alt_us": F.col("local_us"), "local_us": F.col("_day_first"), "offset_us": F.coalesce(offset, "offset_us"), "own_zone": F.coalesce(own, "own_zone")})
    return cut(plain_.unionByName(both.select(*kept)).drop(text))


def with_zones(rows: DataFrame, sources: DataFrame, text: str, seen: str, trust: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``rows`` parsed, with ``zone``; the histories): the zone of a row is the one of its source's history in its period, and UTC
    where source_id is null.  Without ``trust``, declared zones are not looked at."""
    declared = sources.filter("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.min("time_zone").alias("declared"))
    rows = rows.withColumn("seen_us", F.unix_micros(F.col(seen).cast("timestamp"))).drop(seen)
    rows = rows.join(declared, "source_id", "left") if trust else rows.withColumn("declared", F.lit(None).cast("string"))
    rows = readings(rows, text)
    candidates = candidate_zones(sources)
    histories = cut(offset_histories(rows, candidates, lag_costs(rows)))
    known = histories.select("source_id", "period", F.col("zone").alias("_told"))
    rows = rows.withColumn("period", F.floor(F.coalesce("local_us", "alt_us") / PERIOD_US)).join(known, ["source_id", "period"], "left")
    rows = rows.withColumn("zone", F.coalesce("_told", "declared", F.lit("UTC"))).drop("_told", "period")
    american = F.col("zone").startswith("America/") & F.col("declared").isNull()
    return rows.withColumn("local_us", F.when(american, F.coalesce("alt_us", "local_us")).otherwise(F.col("local_us"))), histories


def normalise_timestamps(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, epoch_us) of every article whose ``published_at`` denotes an instant in another notation than the standard one.

    Zones come from the offset histories of the sources.  A declared zone is the history unless clocks contradict it by UNDECLARED nats.
    """
    dirty = F.col("published_at").isNotNull() & ~F.col("published_at").rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$")
    rows = articles.filter(dirty & F.col("id").isNotNull()).select(F.col("id").alias("article_id"), "source_id", "published_at", "retrieved_at")
    rows, _ = with_zones(rows, sources, "published_at", "retrieved_at")
    return rows.select("article_id", epoch_us("zone").alias("epoch_us")).filter("epoch_us is not null").dropDuplicates(["article_id"])


def zone_report(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """How well clocks alone give each source's zone: (source_id, zone, declared, same, changes, violations, rows).

    Declared zones are not looked at, neither for zones nor for slashed dates.  ``zone`` holds most of the source's texts without a zone;
    ``same``: it has the offset of the declared one in every period of the source's texts.
    """
    rows = articles.filter("published_at is not null and source_id is not null").select("source_id", "published_at", "retrieved_at")
    _, h = with_zones(rows, sources, "published_at", "retrieved_at", trust=False)
    declared = sources.select(F.col("id").alias("source_id"), F.col("time_zone").alias("declared"))
    noon = F.timestamp_micros(F.col("period") * PERIOD_US + PERIOD_US // 2)
    at = lambda z: F.unix_micros(F.to_utc_timestamp(noon, F.coalesce(z, F.lit("UTC"))))
    w = Window.partitionBy("source_id").orderBy("period")  # one row per period
    h = h.join(declared, "source_id", "left").withColumn("moved", F.col("zone") != F.lag("zone").over(w)).withColumn("equal", at(F.col("zone")) == at(F.col("declared")))
    most = h.groupBy("source_id", "zone").agg(F.sum("rows").alias("n")).groupBy("source_id").agg(F.max(F.struct("n", "zone"))["zone"].alias("zone"))
    told = h.groupBy("source_id").agg(F.first("declared").alias("declared"), F.bool_and("equal").alias("same"), F.count_if("moved").alias("changes"), F.sum("violations").alias("violations"), F.sum("rows").alias("rows"))
    return told.join(most, "source_id").select("source_id", "zone", "declared", "same", "changes", "violations", "rows")
