from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import series, stats

SINCE = datetime(2026, 7, 20, 10, 0, 30)


@pytest.fixture
def buckets(spark):
    def build(*rows):
        return spark.createDataFrame(rows, "start TIMESTAMP, group STRING, count BIGINT")

    return build


def at(minutes: float) -> datetime:
    return datetime(2026, 7, 20, 10, 0) + timedelta(minutes=minutes)


def test_slots_round_half_up_and_drop_what_is_outside(buckets):
    found = series.dense_series(
        buckets((at(0), None, 1), (at(1), None, 2), (at(3), None, 4), (at(4), None, 8)),
        SINCE,
        SINCE + timedelta(minutes=3),
        "1m",
    ).collect()
    assert [(r.group, r.slot, r["count"]) for r in found] == [
        ("all", 0, 1),
        ("all", 1, 2),
        ("all", 2, 0),
    ]
    assert [r.start for r in found] == [SINCE + timedelta(minutes=i) for i in range(3)]


def test_all_levels_appear_and_services_with_any_bucket(buckets):
    until = SINCE + timedelta(minutes=2)
    by_level = series.dense_series(buckets((at(1), "warn", 3)), SINCE, until, "1m", "level")
    assert by_level.count() == 8
    assert by_level.agg(F.sum("count")).first()[0] == 3
    by_service = series.dense_series(
        buckets((at(1), "a", 3), (at(99), "out", 1)), SINCE, until, "1m", "service"
    )
    assert {r.group for r in by_service.collect()} == {"a", "out"}


def test_range_limits():
    day = datetime(2026, 7, 20)
    assert series.slot_count(day, day + timedelta(seconds=90), "1m") == 2
    with pytest.raises(ValueError, match="at least one bucket"):
        series.slot_count(day, day + timedelta(seconds=29), "1m")
    assert series.slot_count(day, day + timedelta(minutes=5000), "1m") == 5000
    assert series.check_view(day, day + timedelta(minutes=2000), "1m") == 2000
    with pytest.raises(ValueError, match="too wide"):
        series.check_view(day, day + timedelta(minutes=2001), "1m")
    with pytest.raises(ValueError, match="before"):
        series.slot_count(day, day - timedelta(days=1), "1m")
    spans = {"1m": 60, "5m": 240, "1h": 24 * 60, "1d": 14 * 1440}
    for bucket, minutes in spans.items():
        since, until = series.default_range(bucket, day)
        assert until - since == timedelta(minutes=minutes)


def test_ranking_peak_and_shares(spark, buckets):
    table = buckets((at(0), "a", 3), (at(1), "b", 5), (at(2), "a", 4), (at(3), None, 9))
    assert [(r.group, r["count"]) for r in series.group_ranking(table).collect()] == [
        ("a", 7),
        ("b", 5),
    ]
    assert series.peak(table).first().peak == 9
    assert series.peak(table.filter("false")).first().peak == 1
    levels = spark.createDataFrame([("info", 3), ("error", 8)], "level STRING, count BIGINT")
    shares = series.share_of_max(levels, "level").collect()
    assert {(r.name, r["count"], r.pct) for r in shares} == {
        ("error", 8, 100),
        ("info", 3, 38),
        ("debug", 0, 0),
        ("warn", 0, 0),
    }
    nothing = series.share_of_max(levels.filter("false"), "level").collect()
    assert {r.pct for r in nothing} == {0}


def test_ingestion_rate_has_no_upper_bound(logs):
    now = datetime(2026, 7, 20, 12)
    table = logs(
        [
            (str(now + timedelta(minutes=3)), "info", "a", "x"),
            (str(now - timedelta(seconds=60)), "info", "a", "x"),
            (str(now - timedelta(seconds=61)), "info", "a", "x"),
            (str(now - timedelta(minutes=5)), "info", "a", "x"),
            (str(now - timedelta(minutes=5, seconds=1)), "info", "a", "x"),
        ]
    )
    row = stats.ingestion_rate(table, now).first()
    assert (row.last_1m, row.last_5m, row.per_second_1m) == (2, 4, 0.03)
    assert stats.total_rows(table.filter("false")).first().rows == 0
