"""Clock and window functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (from, to, name) of the digest's names by days looked back.
BRIEFS = (
    (None, 1, "Daily Brief"), (6, 8, "Weekly Brief"), (13, 15, "Bi-Weekly Brief"), (28, 31, "Monthly Brief"), (58, 62, "Bi-Monthly Brief"),
    (85, 95, "Quarterly Brief"), (175, 185, "Semi-Annual Brief"), (360, 366, "Annual Brief"),
)


def within_hours(a_us: Column, b_us: Column, hours: int) -> Column:
    """Whether two instants (microseconds) are at most ``hours`` apart; unknown instants always are."""
    return F.coalesce(F.abs(a_us - b_us) <= hours * 3_600_000_000, F.lit(True))


def recency_bucket(seconds: Column) -> Column:
    return F.when(seconds <= 2 * 86400, "day").when(seconds <= 8 * 86400, "week").otherwise("month")


def brief_name(days: Column) -> Column:
    out = F.when(days.isNull(), F.lit(BRIEFS[0][2]))
    for low, high, name in BRIEFS:
        out = out.when(days <= high if low is None else days.between(low, high), F.lit(name))
    return out.otherwise(F.concat(days.cast("string"), F.lit("-Day Brief")))


def window_start(last_ok_us: Column, now_us: Column, overlap_hours: int = 6, floor_hours: int = 168) -> Column:
    """Where collecting begins: ``overlap_hours`` before the last good run, and at least ``floor_hours`` back."""
    hour = 3_600_000_000
    return F.least(F.coalesce(last_ok_us - overlap_hours * hour, now_us), now_us - floor_hours * hour)


def effective_days(explicit: Column, start_us: Column, end_us: Column, scheduled: int = 7) -> Column:
    return F.coalesce(explicit, F.bround((end_us - start_us) / 86_400_000_000).cast("int"), F.lit(scheduled))


def display(ts: Column, zone: str, name: str = "") -> Column:
    """``dd Mon yyyy, HH:MM`` in a zone, with the zone's name if one is given.  The session's zone is UTC."""
    shown = F.date_format(F.from_utc_timestamp(ts, zone), "dd MMM yyyy, HH:mm")
    return F.concat(shown, F.lit(" " + name)) if name else shown
