from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.time import cover, floor_to, instant
from emberlog.operators import aggregate as agg
from emberlog.operators.quality import rollup_drift, run_visibility
from emberlog.schema import BUCKET_SECONDS
from tests.conftest import plan_text

BASE = datetime(2026, 7, 20, 0, 0, 0)


def rows_of(df) -> list[tuple]:
    return [(row.start, row.group, row["count"]) for row in df.collect()]


def test_bucket_counts_and_levels(logs):
    table = logs(
        [
            (str(BASE), "error", "a", "x"),
            (str(BASE + timedelta(seconds=5)), "error", "a", "x"),
            (str(BASE + timedelta(seconds=10)), "warn", "a", "x"),
        ]
    )
    until = BASE + timedelta(minutes=1)
    assert rows_of(agg.bucket_counts(table, BASE, until, "1m")) == [(BASE, None, 3)]
    assert rows_of(agg.bucket_counts(table, BASE, until, "1m", "level")) == [
        (BASE, "error", 2),
        (BASE, "warn", 1),
    ]
    assert rows_of(agg.bucket_counts(table, BASE, BASE, "1m")) == []


@pytest.fixture(scope="module")
def filled(new_store, logs):
    """Two and a half days, one service with most rows, in two batches."""
    store = new_store()
    rows = [
        (
            str(BASE + timedelta(minutes=17 * i, seconds=13 * i % 60)),
            ("debug", "info", "warn", "error")[i * 7 % 4],
            ("hot", "hot", "a", "hot", "b")[i % 5],
            "x",
            {"run": str(i % 2)},
        )
        for i in range(210)
    ]
    table = logs(rows)
    even = F.col("id").cast("int") % 2 == 0
    store.load_batch(table.filter(even), "one")
    store.load_batch(table.filter(~even), "two")
    return store


RANGES = [
    (BASE, BASE + timedelta(days=3)),
    (BASE + timedelta(hours=5), BASE + timedelta(hours=29)),
    (BASE + timedelta(hours=5, minutes=3, seconds=2), BASE + timedelta(hours=29, seconds=30)),
    (BASE + timedelta(minutes=18), BASE + timedelta(minutes=18, seconds=40)),
    (BASE + timedelta(minutes=59, seconds=59), BASE + timedelta(hours=1, seconds=1)),
    (BASE, BASE),
]


def counted(rows, since, until, bucket, group_by, service=None, level=None):
    """The same counts in plain Python."""
    step = timedelta(seconds=BUCKET_SECONDS[bucket])
    found = Counter()
    for row in rows:
        if since <= row.timestamp < until and service in (None, row.service):
            if level in (None, row.level):
                start = BASE + (row.timestamp - BASE) // step * step
                found[start, row[group_by] if group_by else None] += 1
    return sorted((*key, count) for key, count in found.items())


@pytest.mark.parametrize("bucket", ["1m", "5m", "1h", "1d"])
def test_auto_always_equals_raw(filled, bucket):
    rows = filled.scan_logs().collect()
    for number, (since, until) in enumerate(RANGES):
        keys = dict(service="hot", level="info") if number % 2 else {}
        for group_by in (None, "service")[number % 2 :]:
            found = agg.aggregate(filled, since, until, bucket, group_by, **keys)
            assert rows_of(found) == counted(rows, since, until, bucket, group_by, **keys)
        raw = agg.aggregate(filled, since, until, bucket, source="raw", **keys)
        assert rows_of(raw) == counted(rows, since, until, bucket, None, **keys)


@pytest.mark.parametrize("seed", range(6))
def test_any_range_equals_raw(filled, seed):
    draw = random.Random(seed)
    rows = filled.scan_logs().collect()
    since = BASE + timedelta(milliseconds=draw.randrange(3 * 86_400_000))
    until = since + timedelta(milliseconds=int(10 ** draw.uniform(3, 8.4)))
    bucket, group_by = draw.choice(list(BUCKET_SECONDS)), draw.choice([None, "service", "level"])
    found = agg.aggregate(filled, since, until, bucket, group_by)
    assert rows_of(found) == counted(rows, since, until, bucket, group_by)


def test_cover():
    day = timedelta(days=1)
    grains = agg.COVERS["1d"]
    draw = random.Random(3)
    for _ in range(300):
        since = instant(BASE) + timedelta(milliseconds=draw.randrange(10 * 86_400_000))
        until = since + timedelta(milliseconds=int(10 ** draw.uniform(0, 9.3)))
        spans, rest = cover(since, until, grains)
        pieces = sorted([s for own in spans.values() for s in own] + rest)
        assert pieces[0][0] == since and pieces[-1][1] == until
        assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        assert len(rest) <= 2 and all(high - low < timedelta(minutes=1) for low, high in rest)
        for name, step in grains:
            own = spans.get(name, [])
            assert len(own) <= 2 and all(floor_to(t, step) == t for s in own for t in s)
            if name != "day":
                assert sum((high - low for low, high in own), timedelta()) < 2 * day
    assert cover(since, since, grains) == ({}, [])


def test_raw_rows_are_read_only_beside_whole_minutes(filled):
    since, until = RANGES[2]
    plan = plan_text(agg.aggregate(filled, since, until, "1d"))
    for table in ("logs", "minute_counts", "hourly_counts"):
        assert f"/{table}/dt" in plan
    whole = agg.aggregate(filled, BASE, BASE + timedelta(days=2), "1d")
    assert "/daily_counts/dt" in plan_text(whole) and "hourly" not in plan_text(whole)
    raw = filled.scan_logs_in(cover(since, until, agg.COVERS["1d"])[1]).collect()
    ends = [(since, since + timedelta(minutes=1)), (until - timedelta(minutes=1), until)]
    assert all(any(low <= r.timestamp < high for low, high in ends) for r in raw)


def test_rollups_test_the_start_of_their_bucket(filled):
    since, until = BASE + timedelta(minutes=30), BASE + timedelta(hours=2, minutes=30)
    rolled = rows_of(agg.aggregate(filled, since, until, "1h", source="rollup"))
    assert [start.hour for start, _, _ in rolled] == [1, 2]
    whole = rows_of(agg.aggregate(filled, BASE, BASE + timedelta(hours=3), "1h"))
    assert rolled == whole[1:]


def test_coarse_buckets_come_from_finer_rollups(filled):
    since, until = BASE, BASE + timedelta(days=3)
    for bucket in ("5m", "1d"):
        raw = agg.aggregate(filled, since, until, bucket, "level", source="raw")
        rolled = agg.aggregate(filled, since, until, bucket, "level", source="rollup")
        assert rows_of(raw) == rows_of(rolled)


def test_filters_without_counts_read_raw_rows(filled):
    since, until = BASE, BASE + timedelta(days=3)
    plan = plan_text(agg.aggregate(filled, since, until, "1h", attr={"run": "1"}))
    assert "/logs/dt" in plan and "_counts" not in plan
    plan = plan_text(agg.aggregate(filled, since, until, "1h"))
    assert "/hourly_counts/dt" in plan and "/logs/" not in plan
    with pytest.raises(ValueError, match="no counts"):
        agg.aggregate(filled, since, until, "1h", q="x", source="rollup")
    with pytest.raises(ValueError, match="source"):
        agg.aggregate(filled, since, until, "1h", source="cache")


def test_cut_ranges_read_only_the_edges_raw(filled):
    since, until = RANGES[2]
    plan = plan_text(agg.aggregate(filled, since, until, "1h", "service"))
    assert "dt" in plan.split("/logs/dt")[1].split("PartitionFilters:")[1].split("\n")[0]
    assert plan.count("Arguments: hashpartitioning") == 1


def test_drift_descends_only_where_hashes_differ(filled):
    logs, partials = filled.scan_logs(), filled.scan_partials("minute")
    keys = ["bucket", "service", "level"]
    spoiled = (
        partials.groupBy(*keys).agg(F.sum("count").alias("count"))
        # One key more, one less, one moved to another level of the same hour: totals agree.
        .withColumn("level", F.when(F.minute("bucket") == 17, F.lit("moved")).otherwise(F.col("level")))
        .withColumn("count", F.when(F.minute("bucket") == 34, F.lit(2)).otherwise(F.col("count")))
        .filter(F.minute("bucket") != 51)
    )
    found = rollup_drift(logs, spoiled, "minute")
    raw = Counter((r.timestamp.replace(second=0, microsecond=0), r.service, r.level) for r in logs.collect())
    rolled = Counter({(r.bucket, r.service, r.level): r["count"] for r in spoiled.collect()})
    wanted = {k: (raw[k], rolled[k]) for k in raw | rolled if raw[k] != rolled[k]}
    assert {(r.bucket, r.service, r.level): (r.raw, r.rollup) for r in found.collect()} == wanted and wanted
    skipped = rollup_drift(logs, spoiled, "minute", skip_day=BASE.date()).collect()
    assert {r.bucket for r in skipped} == {k[0] for k in wanted if k[0].date() != BASE.date()}


def test_no_drift_and_visibility(filled):
    for grain in ("minute", "hour", "day"):
        drift = rollup_drift(filled.scan_logs(), filled.scan_partials(grain), grain)
        assert drift.count() == 0
    partial = filled.scan_partials("hour").filter("batch_id = 'one'")
    assert rollup_drift(filled.scan_logs(), partial, "hour").agg(
        F.sum(F.col("raw") - F.col("rollup"))
    ).first()[0] == 105
    skipped = rollup_drift(filled.scan_logs(), partial, "hour", skip_day=BASE.date())
    assert skipped.filter(F.to_date("bucket") == F.lit(BASE.date())).count() == 0
    seen = run_visibility(filled.scan_logs(), "1", *RANGES[0], key="run")
    assert seen.first().visible == 105


NOW = datetime(2026, 7, 20, 12, 30, 40)


@pytest.fixture(scope="module")
def live_logs(logs):
    def minutes_ago(n, service, level="info"):
        return (str(NOW - timedelta(minutes=n)), level, service, "x")

    return logs(
        [
            minutes_ago(1, "brakes"),
            minutes_ago(1, "brakes", "error"),
            minutes_ago(1, "fares"),
            minutes_ago(14, "brakes"),
            minutes_ago(15, "brakes"),
        ]
    )


def test_live_window_groups_and_filters(live_logs):
    since = NOW - timedelta(minutes=5)
    minute = datetime(2026, 7, 20, 12, 29)
    assert rows_of(agg.live_window(live_logs, NOW, since, NOW, "service")) == [
        (minute, "brakes", 2),
        (minute, "fares", 1),
    ]
    assert rows_of(agg.live_window(live_logs, NOW, since, NOW, level="error")) == [
        (minute, None, 1)
    ]
    assert rows_of(agg.live_window(live_logs, NOW, since, NOW, service="nobody")) == []


def test_live_window_refuses_what_it_cannot_know(live_logs):
    edge = datetime(2026, 7, 20, 12, 16)
    assert agg.live_window(live_logs, NOW, edge - timedelta(seconds=1), NOW) is None
    assert len(rows_of(agg.live_window(live_logs, NOW, edge, NOW))) == 2
    started = NOW - timedelta(minutes=3)
    assert agg.live_window(live_logs, NOW, edge, NOW, started_at=started) is None
    late = NOW - timedelta(minutes=3, seconds=20)
    assert agg.live_window(live_logs, NOW, late, NOW, started_at=started) is not None


def test_live_window_counts_whole_minutes(live_logs):
    since = datetime(2026, 7, 20, 12, 29, 50)
    assert rows_of(agg.live_window(live_logs, NOW, since, NOW))[0][2] == 3
    until = datetime(2026, 7, 20, 12, 29, 1)
    assert rows_of(agg.live_window(live_logs, NOW, until, until))[0][2] == 3
    whole = datetime(2026, 7, 20, 12, 29)
    assert rows_of(agg.live_window(live_logs, NOW, whole, whole)) == []


def test_aggregate_takes_the_live_table_for_whole_recent_minutes(filled, spark):
    start = datetime(2026, 7, 20, 12, 29)

    class Live:
        complete = True

        def counts(self):
            schema = "bucket TIMESTAMP, service STRING, level STRING, count BIGINT"
            return spark.createDataFrame([(start, "a", "info", 7)], schema)

        def covers(self, since, until):
            return self.complete

    until, live = start + timedelta(minutes=1), Live()
    options = dict(as_of=NOW, live=live)
    assert rows_of(agg.aggregate(filled, start, until, "1m", **options)) == [(start, None, 7)]
    cut = agg.aggregate(filled, start + timedelta(seconds=1), until, "1m", **options)
    assert rows_of(cut) != [(start, None, 7)]
    forced = agg.aggregate(
        filled, start + timedelta(seconds=1), until, "1m", source="live", **options
    )
    assert rows_of(forced) == [(start, None, 7)]
    with pytest.raises(ValueError, match="cannot answer"):
        agg.aggregate(filled, BASE, until, "1m", source="live", **options)
    live.complete = False
    raw = agg.aggregate(filled, start, until, "1m", source="raw")
    assert rows_of(agg.aggregate(filled, start, until, "1m", **options)) == rows_of(raw)
    with pytest.raises(ValueError, match="cannot answer"):
        agg.aggregate(filled, start, until, "1m", source="live", **options)
