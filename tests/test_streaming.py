from __future__ import annotations

import json
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.aggregate import aggregate, live_counts
from emberlog.operators.retention import backfill_day
from emberlog.plans.queries import contents
from emberlog.session import scratch
from emberlog.sources import folders
from emberlog.sources.compaction import compact_day
from emberlog.streaming import ingest
from emberlog.streaming.ingest import ingest_bodies, ingest_stream
from emberlog.streaming.live import (
    LiveTable,
    live_counts_stream,
    live_state_stream,
    prune_live,
    read_live,
    read_live_state,
)
from emberlog.streaming.tail import committed_entries, live_tail

AS_OF = datetime(2026, 7, 21, 12, tzinfo=UTC)


def body(*entries: tuple[str, str, str]) -> str:
    logs = [
        {"timestamp": ts, "level": level, "service": service, "message": "m"}
        for ts, level, service in entries
    ]
    return json.dumps({"logs": logs})


def drop(spark, path: str, *bodies: str) -> None:
    lines = spark.createDataFrame([(text,) for text in bodies], "value STRING").coalesce(1)
    lines.write.mode("append").text(path)


@pytest.fixture
def inbox(spark):
    return scratch(spark, "inbox")


def run(spark, inbox, store, checkpoint):
    ingest_stream(spark, inbox, store, checkpoint, clock=lambda: AS_OF).awaitTermination()


def sizes(store):
    row = contents(store).first()
    return row.rows, row.hour_count, row.minute_count


def test_ingest_picks_up_where_it_stopped(spark, inbox, store):
    checkpoint = scratch(spark, "checkpoint")
    same = body(("2026-07-21T10:00:00Z", "info", "a"))
    drop(spark, inbox, same, same, "{bad", body(("2026-07-21T10:00:00Z", "loud", "a")))
    run(spark, inbox, store, checkpoint)
    assert sizes(store) == (2, 2, 2)
    run(spark, inbox, store, checkpoint)
    assert sizes(store) == (2, 2, 2)
    drop(spark, inbox, body(("2026-07-20T10:00:00Z", "warn", "b")))
    run(spark, inbox, store, checkpoint)
    assert sizes(store) == (3, 3, 3)
    assert {(r["index"], r.reason) for r in store.scan_rejected().collect()} == {
        (0, "Invalid level: loud"),
        (None, "Malformed JSON"),
    }
    assert store.scan_logs().select("id").distinct().count() == 3
    batches = {r.batch_id for r in store.scan_logs().select("batch_id").distinct().collect()}
    assert len(batches) == 2 and not any(name.startswith("None") for name in batches)
    other = scratch(spark, "inbox")
    drop(spark, other, body(("2026-07-21T11:00:00Z", "info", "c")))
    run(spark, other, store, scratch(spark, "checkpoint"))
    assert sizes(store) == (4, 4, 4)


def test_a_batch_that_runs_twice_changes_nothing(spark, inbox, store):
    drop(spark, inbox, body(("2026-07-21T10:00:00Z", "info", "a")), body(("x", "info", "a")))
    bodies = spark.read.text(inbox).select("value", F.col("_metadata.file_name").alias("file"))
    outcomes = []
    for keep in (True, False):
        ingest_bodies(store, bodies, "batch-7", AS_OF, keep_parsed=keep)
        outcomes.append((sizes(store), store.scan_logs().collect(), store.scan_rejected().collect()))
    assert outcomes[0] == outcomes[1]
    assert outcomes[0][0] == (1, 1, 1)


def follow(store, path, checkpoint, **options):
    stream = committed_entries(store)
    live_counts_stream(stream, path, checkpoint, clock=lambda: AS_OF, **options).awaitTermination()
    return LiveTable(store, path)


def test_live_counts_follow_the_stream(spark, store, logs):
    path, checkpoint = scratch(spark, "live"), scratch(spark, "checkpoint")
    first = datetime(2026, 7, 21, 11, 50)

    def arrive(name, *rows):
        store.load_batch(logs([(str(ts), level, service, "m") for ts, level, service in rows]), name)

    # One entry is ahead of the clock, and the stream begins after the first batch.
    arrive("one", (first, "info", "a"), (first, "info", "a"), (AS_OF + timedelta(minutes=4), "info", "a"))
    live = follow(store, path, checkpoint)
    until = first + timedelta(minutes=5)
    assert live.covers(first, until)
    arrive("two", (first, "info", "a"), (first - timedelta(minutes=2), "warn", "b"))
    assert not live.covers(first, until)
    options = dict(as_of=AS_OF, live=live)
    for _ in range(2):
        found = aggregate(store, first, until, "1m", "service", **options).collect()
        assert [(r.start, r.group, r["count"]) for r in found] == [(first, "a", 3)]
        live = follow(store, path, checkpoint)
    assert live.covers(first, until)
    compact_day(store, AS_OF.date())
    live = follow(store, path, checkpoint)
    assert live.covers(first, until)
    found = live_counts(live.counts(), AS_OF, first - timedelta(minutes=3), AS_OF, "service").collect()
    assert [(r.group, r["count"]) for r in found] == [("b", 1), ("a", 3)]
    assert live_counts(live.counts(), AS_OF, first - timedelta(minutes=10), AS_OF) is None
    prune_live(spark, path, AS_OF)
    assert read_live(spark, path).count() == 3
    prune_live(spark, path, AS_OF + timedelta(days=2))
    assert folders.matching(spark, f"{path}/*/*=*") == []


def test_a_batch_loaded_twice_is_not_answered_live(spark, store, logs):
    path, checkpoint = scratch(spark, "live"), scratch(spark, "checkpoint")
    first = datetime(2026, 7, 21, 11, 50)
    rows = logs([(str(first), "info", "a", "m")])
    for _ in range(2):
        store.load_batch(rows, "same")
        live = follow(store, path, checkpoint)
    found = aggregate(store, first, first + timedelta(minutes=1), "1m", as_of=AS_OF, live=live)
    assert [r["count"] for r in found.collect()] == [1]


def test_a_retried_epoch_is_judged_by_its_first_time(spark, inbox, store, monkeypatch):
    ahead = (AS_OF + timedelta(minutes=8)).isoformat()
    drop(spark, inbox, body((ahead, "info", "a"), ("2026-07-21T10:00:00Z", "info", "a")))
    checkpoint, times = scratch(spark, "checkpoint"), [AS_OF, AS_OF + timedelta(minutes=10)]
    real = ingest.ingest_bodies

    def dies(*args, **options):
        real(*args, **options)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(ingest, "ingest_bodies", dies)
    with pytest.raises(Exception, match="driver lost"):
        ingest_stream(spark, inbox, store, checkpoint, clock=lambda: times[0]).awaitTermination()
    monkeypatch.setattr(ingest, "ingest_bodies", real)
    ingest_stream(spark, inbox, store, checkpoint, clock=lambda: times[1]).awaitTermination()
    assert sizes(store) == (1, 1, 1)
    assert store.scan_rejected().count() == 1


def test_tail_shows_committed_rows_of_one_service(spark, store, logs):
    assert live_tail(store).isStreaming  # an empty store can be tailed
    store.load_batch(
        logs([("2026-07-21 10:00:00", "info", "svc-a", "x"), ("2026-07-21 10:00:00", "warn", "svc-b", "y")]),
        "one",
    )

    def tailed(**options):
        out = scratch(spark, "tail")
        query = (
            live_tail(store, **options)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", scratch(spark, "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return spark.read.parquet(out)

    rows = tailed(service="svc-a")
    assert "id" not in rows.columns
    assert [r.message for r in rows.collect()] == ["x"]
    assert tailed(level="warn").count() == 1
    store.load_batch(logs([("2026-07-21 10:00:00", "warn", "svc-b", "z")]), "two")
    compact_day(store, AS_OF.date())
    store.park_stray(logs([("2026-07-21 11:00:00", "warn", "svc-b", "moved")]), "late")
    backfill_day(store, AS_OF.date())
    assert sorted(r.message for r in tailed(level="warn").collect()) == ["y", "z"]
    assert tailed(started_at=datetime.now(UTC) + timedelta(hours=1)).count() == 0
    with pytest.raises(ValueError, match="invalid level: 'loud'"):
        live_tail(store, level="loud")


def test_live_state_follows_event_time(spark, logs):
    """Late entries of the window count, older ones and a restart change nothing, state is given up."""
    inbox, path, checkpoint = (scratch(spark, name) for name in ("inbox", "state", "checkpoint"))
    start = datetime(2026, 7, 21, 10, 0)
    held = []

    def arrive(*entries):
        rows = [(str(start + timedelta(minutes=m, seconds=s)), level, service, "m") for m, s, level, service in entries]
        logs(rows).coalesce(1).write.mode("append").parquet(inbox)
        held.extend(entries)
        stream = spark.readStream.schema(logs(rows).schema).parquet(inbox)
        query = live_state_stream(stream, path, checkpoint)
        query.awaitTermination()
        return query

    def kept():
        last = max(m for m, *_ in held)
        counts = Counter((start + timedelta(minutes=m), svc, lvl) for m, _, lvl, svc in held if m > last - 15)
        found = read_live_state(spark, path).collect()
        assert {(r.bucket, r.service, r.level): r["count"] for r in found} == counts
        assert len(found) == len(counts)

    assert read_live_state(spark, path).collect() == []
    arrive(*[(m, 7 * m % 60, "info", "ab"[m % 2]) for m in range(40)])
    kept()
    arrive((39, 59, "info", "b"), (30, 1, "warn", "a"), (26, 0, "info", "a"))  # late, in the window
    kept()
    arrive((45, 0, "info", "a"), (31, 30, "info", "b"), (3, 0, "info", "a"), (3, 1, "error", "b"))  # and before it
    kept()
    last = arrive((100, 0, "info", "a"))
    kept()
    assert read_live_state(spark, path).count() == 1
    last = arrive((101, 0, "info", "a"))
    kept()
    states = [p.stateOperators[0].numRowsTotal for p in last.recentProgress if p.stateOperators]
    assert states[-1] == 2, states  # only the minutes within reach of the watermark
    assert all(int(folders.partition_values(p)["epoch"]) >= 3 for p in folders.matching(spark, f"{path}/counts/epoch=*"))
