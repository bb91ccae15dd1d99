from __future__ import annotations

from datetime import datetime, timezone

import pytest

from siftwire.operators import timestamps

SEEN = datetime(2025, 1, 10, 12, 0, tzinfo=timezone.utc)
SOURCES = [(1, "Africa/Cairo"), (2, "America/New_York"), (3, "Asia/Tehran"), (4, "Europe/Paris")]


def run(spark, rows):
    a = spark.createDataFrame([(str(i), s, t, SEEN) for i, (s, t) in enumerate(rows)], "id string, source_id int, published_at string, retrieved_at timestamp")
    got = {int(r.article_id): r.epoch_us for r in timestamps.normalise_timestamps(a, spark.createDataFrame(SOURCES, "id int, time_zone string")).collect()}
    return [datetime.fromtimestamp(got[i] / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") if i in got else None for i in range(len(rows))]


CASES = [
    (1, "2024-07-22 09:14:32", "2024-07-22T06:14:32"), (None, "2024-07-22 09:14:32", "2024-07-22T09:14:32"), (1, "2024-01-05T10:00", "2024-01-05T08:00:00"),
    (1, "2024-07-22T09:14:32Z", None), (1, "  2024-07-22T09:14:32Z ", "2024-07-22T09:14:32"), (1, "2024-07-22T09:14Z", "2024-07-22T09:14:00"),
    (1, "2025-04-18T20:46:29+02:00", "2025-04-18T18:46:29"), (1, "2025-12-15T21:18:28-0500", "2025-12-16T02:18:28"), (1, "2024-01-15 05:43:56.595958+02:00", "2024-01-15T03:43:56"),
    (1, "2025-04-18T20:46:29[UTC]", "2025-04-18T20:46:29"), (4, "2024-11-03 02:41:19 America/New_York", "2024-11-03T07:41:19"),
    (2, "03/04/2025 14:00", "2025-03-04T19:00:00"), (1, "03/04/2025 14:00", "2025-04-03T12:00:00"), (2, "11/03/2024 1:30 AM", "2024-11-03T05:30:00"),
    (1, "21.11.2025 17:16", "2025-11-21T15:16:00"), (1, "03-Dec-2024 13:35:58 UTC", "2024-12-03T13:35:58"), (1, "Tue, 18 Mar 2025 11:01:07 +0200", "2025-03-18T09:01:07"),
    (1, "Sun Jul  7 01:29:39 2024", "2024-07-06T22:29:39"), (4, "16 juin 2024 à 6h24", "2024-06-16T04:24:00"), (4, "13. Oktober 2024, 08:46 Uhr", "2024-10-13T06:46:00"),
    (1, "٦ يناير ٢٠٢٥، ٣:٥٤ م", "2025-01-06T13:54:00"), (3, "۱۸ اوت ۲۰۲۵ ۰۹:۴۲", "2025-08-18T06:12:00"), (1, "August 10, 2025 12:22 AM", "2025-08-09T21:22:00"),
    (1, "24 September 2024", "2024-09-23T21:00:00"), (1, "2024-07-11", "2024-07-10T21:00:00"), (1, "1726933415", "2024-09-21T15:43:35"), (1, "1714288840533", "2024-04-28T07:20:40"),
    (1, "20250507T170727Z", "2025-05-07T17:07:27"), (1, "20240213145835", "2024-02-13T12:58:35"), (1, "10 Nov 2024 21:20:19 GMT+4", "2024-11-10T17:20:19"), (1, "3 Aug 2024 13:44:38 UTC+03:00", "2024-08-03T10:44:38"),
    (1, "2 hours ago", "2025-01-10T10:00:00"), (1, "منذ 6 أيام", "2025-01-04T12:00:00"), (1, "منذ يوم", "2025-01-09T12:00:00"),
    (4, "31/03/2024 02:20", "2024-03-31T01:20:00"), (2, "10 March 2024 02:14", "2024-03-10T07:14:00"),
    (1, None, None), (1, "", None), (1, "   ", None), (1, "soon", None), (1, "2024-13-45", None), (1, "31/02/2024 10:00", None), (1, "2024-02-30 10:00:00", None), (1, "2024-02-03 25:00:00", None),
    (1, "??/??/2025", None), (1, "0000-00-00 00:00:00", None), (1, "13:00 PM", None), (1, "x" * 5000, None), (1, "2024-07-22 09:14:32 Mars/Crater", None),
]


def test_notations(spark):
    got = run(spark, [(s, t) for s, t, _ in CASES])
    assert [(t, g) for (_, t, w), g in zip(CASES, got) if g != w] == []


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    a = spark.createDataFrame([("a", 1, "1 hour ago", SEEN, "clash")] * 3, "id string, source_id int, published_at string, retrieved_at timestamp, declared string")
    assert timestamps.normalise_timestamps(a, spark.createDataFrame(SOURCES, "id int, time_zone string")).count() == 1


def test_zone_is_estimated_where_none_is_declared(spark):
    # Source 9 writes New York time; ingestion follows within the hour.
    rows = [(str(i), 9, f"2024-{1 + i % 12:02d}-1{i % 9} 0{i % 9}:15:00", datetime(2024, 1 + i % 12, 10 + i % 9, i % 9 + (4 if 3 <= 1 + i % 12 <= 10 else 5), 40 + i % 15, tzinfo=timezone.utc)) for i in range(60)]
    a = spark.createDataFrame(rows, "id string, source_id int, published_at string, retrieved_at timestamp")
    s = spark.createDataFrame([(9, None), (1, "Africa/Cairo")], "id int, time_zone string")
    got = {r.article_id: r.epoch_us for r in timestamps.normalise_timestamps(a, s).collect()}
    lag = [(r[3].timestamp() * 1e6 - got[r[0]]) / 6e7 for r in rows if 1 + int(r[0]) % 12 not in (3, 11)]
    assert all(20 <= x <= 45 for x in lag), lag


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert run(spark, [(1, "2024-07-22 09:14:32"), (1, "2 hours ago")]) == ["2024-07-22T06:14:32", "2025-01-10T10:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _texts(source, zone, days, style="%Y-%m-%d %H:%M:%S"):
    """(source, text, retrieved) of a source that writes in a zone and is read some minutes later."""
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    out = []
    for i, d in enumerate(days):
        at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=d, hours=7 * i % 24, minutes=11 * i % 60)
        out.append((source, at.astimezone(ZoneInfo(zone)).strftime(style), at + timedelta(minutes=5 + 7 * i % 40), at))
    return out


def _normalised(spark, rows, sources):
    a = spark.createDataFrame([(str(i), s, t, r) for i, (s, t, r, _) in enumerate(rows)], "id string, source_id int, published_at string, retrieved_at timestamp")
    s = spark.createDataFrame(sources, "id int, time_zone string")
    return {int(r.article_id): r.epoch_us for r in timestamps.normalise_timestamps(a, s).collect()}, timestamps.zone_report(a, s)


def test_a_source_that_moves_has_a_history(spark):
    rows = _texts(9, "America/New_York", range(0, 250, 2)) + _texts(9, "Europe/Paris", range(280, 500, 2)) + _texts(1, "UTC", range(0, 400, 9), "%Y-%m-%dT%H:%M:%S.000Z")
    got, report = _normalised(spark, rows, [(9, None), (1, "Europe/Paris")])
    wrong = [t for i, (_, t, _, at) in enumerate(rows) if abs(got[i] - at.timestamp() * 1e6) > 1e6]
    assert wrong == []
    assert {(r.source_id, r.zone, r.changes) for r in report.collect()} >= {(9, "America/New_York", 1)}


def test_slashed_dates_of_an_undeclared_source(spark):
    rows = _texts(9, "America/New_York", range(0, 300, 2), "%m/%d/%Y %H:%M:%S") + _texts(8, "Africa/Cairo", range(0, 300, 2), "%d/%m/%Y %H:%M:%S")
    got, _ = _normalised(spark, rows, [(9, None), (8, None), (1, "Africa/Cairo"), (2, None)])
    assert [t for i, (_, t, _, at) in enumerate(rows) if abs(got[i] - at.timestamp() * 1e6) > 1e6] == []


def test_declared_zone_stands_unless_clocks_contradict_it(spark):
    few = _texts(1, "Asia/Dubai", range(3))
    got, _ = _normalised(spark, few, [(1, "Africa/Cairo")])
    assert all(got[i] - r[3].timestamp() * 1e6 in (7.2e9, 3.6e9) for i, r in enumerate(few))


def test_written_offsets_tell_the_zone(spark):
    rows = _texts(9, "Asia/Tehran", range(0, 90, 3), "%Y-%m-%dT%H:%M:%S%z") + [(9, "2024-02-10 10:00:00", datetime(2024, 2, 12, tzinfo=timezone.utc), datetime(2024, 2, 10, 6, 30, tzinfo=timezone.utc))]
    got, _ = _normalised(spark, rows, [(9, None)])
    assert got[len(rows) - 1] == rows[-1][3].timestamp() * 1e6
