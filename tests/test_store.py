from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import dead_letters as dead
from emberlog.operators import retention, stats
from emberlog.operators.backfill import backfill
from emberlog.plans.queries import contents
from emberlog.sources import folders, packs
from emberlog.sources.compaction import compact_day, remove_replaced
from emberlog.sources.store import LogStore
from emberlog.streaming.ingest import flush_batch

AS_OF = datetime(2026, 7, 21, 9, 30, tzinfo=UTC)


def day(offset: int, hour: int = 12) -> str:
    return str(datetime(2026, 7, 21, hour) + timedelta(days=offset))


def sizes(store: LogStore) -> tuple[int, int, int]:
    row = contents(store).first()
    return row.rows, row.hour_count, row.minute_count


def test_an_empty_store_reads_as_empty(store):
    assert store.scan_logs().count() == 0
    assert store.scan_rollup("hour").count() == 0
    assert stats.partition_stats(store).count() == 0
    assert stats.time_range(store.scan_logs()).first().oldest is None
    assert dead.dead_letter_list(store).count() == 0
    assert dead.dead_letter_replay(store) == dead.Replayed(0, 0)
    assert retention.retain(store, AS_OF).dropped == []


def test_batches_add_up_and_a_repeated_one_replaces_itself(store, logs):
    first = logs([(day(0), "info", "a", "x"), (day(0), "info", "a", "y"), (day(-1), "warn", "b", "z")])
    second = logs([(day(0), "info", "a", "x")])
    store.load_batch(first, "one")
    store.load_batch(second, "two")
    counts = {
        (r.service, r.level): r["count"] for r in store.scan_rollup("hour", day(0, 0)).collect()
    }
    assert counts == {("a", "info"): 3}
    store.load_batch(second, "two")
    assert sizes(store) == (4, 4, 4)
    store.load_batch(first.filter("service = 'a'"), "one")
    assert sizes(store) == (3, 3, 3)
    assert store.days() == [date(2026, 7, 21)]
    store.load_batch(first.filter("false"), "empty")
    assert sizes(store) == (3, 3, 3)


def test_batch_names_stay_plain(store, logs):
    with pytest.raises(ValueError, match="batch id"):
        store.append_logs(logs([(day(0), "info", "a", "x")]), "a/b")


def pack_store(store, logs):
    for name in ("one", "two", "three"):
        store.load_batch(logs([(day(0), "info", "a", name), (day(-1), "warn", "b", name)]), name)
    return sorted((r.message, r.dt) for r in store.scan_logs().collect())


TODAY = date(2026, 7, 21)


def test_compaction_keeps_rows_and_counts(store, logs):
    before = pack_store(store, logs)
    assert compact_day(store, TODAY)
    assert sorted((r.message, r.dt) for r in store.scan_logs().collect()) == before
    assert sizes(store) == (6, 6, 6)
    remove_replaced(store, TODAY)
    assert sizes(store) == (6, 6, 6)
    for path in (store.logs_path, store.rollup_path("hour"), store.rollup_path("minute")):
        assert len(folders.matching(store.spark, f"{path}/dt=2026-07-21/batch_id=*")) == 1
        assert len(folders.matching(store.spark, f"{path}/dt=2026-07-20/batch_id=*")) == 3
    assert not compact_day(store, TODAY)
    store.load_batch(logs([(day(0), "info", "a", "late")]), "late")
    assert compact_day(store, TODAY)
    assert sizes(store) == (7, 7, 7)


def test_a_batch_arriving_while_a_day_is_packed_stays(store, logs, monkeypatch):
    pack_store(store, logs)
    real = packs.publish

    def late(*args):
        store.load_batch(logs([(day(0), "info", "a", "late")]), "late")
        assert sizes(store) == (7, 7, 7)  # a reader during the run sees every row once
        real(*args)
        assert sizes(store) == (7, 7, 7)

    monkeypatch.setattr(packs, "publish", late)
    assert compact_day(store, TODAY)
    monkeypatch.setattr(packs, "publish", real)
    assert sizes(store) == (7, 7, 7)
    assert compact_day(store, TODAY)
    remove_replaced(store, TODAY)
    assert sizes(store) == (7, 7, 7)


@pytest.mark.parametrize("published", [False, True])
def test_compaction_survives_a_crash_and_new_batches(store, logs, monkeypatch, published):
    pack_store(store, logs)
    real = packs.publish

    def dies(*args):
        if published:
            real(*args)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(packs, "publish", dies)
    with pytest.raises(RuntimeError):
        compact_day(store, TODAY)
    monkeypatch.setattr(packs, "publish", real)
    assert sizes(store) == (6, 6, 6)
    for name in ("four", "five"):
        store.load_batch(logs([(day(0), "info", "a", name)]), name)
    assert sizes(store) == (8, 8, 8)
    assert compact_day(store, TODAY)
    assert sizes(store) == (8, 8, 8)
    remove_replaced(store, TODAY)
    assert sizes(store) == (8, 8, 8)


def test_a_packed_batch_that_runs_again_changes_nothing(store, logs):
    pack_store(store, logs)
    again = logs([(day(0), "info", "a", "two"), (day(-1), "warn", "b", "two")])
    compact_day(store, TODAY)
    store.load_batch(again, "two")
    assert sizes(store) == (6, 6, 6)
    remove_replaced(store, TODAY)
    store.load_batch(again, "two")
    assert sizes(store) == (6, 6, 6)


def test_a_batch_without_its_counts_is_not_packed(store, logs):
    pack_store(store, logs)
    store.append_logs(logs([(day(0), "info", "a", "half")]), "half")
    compact_day(store, TODAY)
    assert sizes(store) == (7, 6, 6)
    store.add_all_counts(store.scan_batch("half"), "half")
    assert sizes(store) == (7, 7, 7)


def test_a_rebuild_beside_a_load_counts_once(store, logs):
    pack_store(store, logs)
    table = logs([(day(0), "info", "a", "new")])
    store.append_logs(table, "new")
    for grain in ("hour", "minute"):
        store.rebuild_rollup(grain)
    assert sizes(store) == (7, 7, 7)
    store.add_all_counts(store.scan_batch("new"), "new")
    assert sizes(store) == (7, 7, 7)


def test_rebuild_repairs_a_rollup(store, logs):
    table = logs([(day(0), "info", "a", "x"), (day(0, 3), "info", "a", "x")])
    store.append_logs(table, "one")
    store.add_counts(table, "hour", "wrong")
    store.add_counts(table, "hour", "wrong-again")
    for _ in range(2):
        store.rebuild_rollup("hour")
        store.rebuild_rollup("minute")
    assert sizes(store) == (2, 2, 2)


def test_a_hot_day_is_written_by_many_tasks(spark, store):
    """One day holding nearly everything must not end up in one file."""
    rows = spark.range(60_000).select(
        F.expr("uuid()").alias("id"),
        F.timestamp_seconds(F.lit(1_784_600_000) + F.col("id") % 3600).alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("hot").alias("service"),
        F.expr("repeat(uuid(), 4)").alias("message"),
        F.lit("").alias("message_lower"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
    rows = rows.withColumn("dt", F.to_date("timestamp"))
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1MB")
    try:
        store.append_logs(rows, "hot")
    finally:
        spark.conf.set(setting, before)
    assert len(folders.matching(spark, f"{store.logs_path}/dt=*/batch_id=hot/*.parquet")) > 2
    assert store.scan_logs().count() == 60_000


def test_a_failed_batch_is_dead_lettered_whole_and_replayed(store, logs, monkeypatch):
    accepted = logs([(day(0), "info", "a", "x"), (day(-1), "warn", "b", "y")]).select(
        F.lit("e").alias("envelope"),
        F.col("id").cast("int").alias("index"),
        "timestamp",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_text"),
        "level",
        "service",
        "message",
        "attributes",
    )
    real = LogStore.add_counts

    def broken(self, entries, grain, batch_id=None):
        if grain == "hour":
            raise RuntimeError("disk full\nstack")
        real(self, entries, grain, batch_id)

    monkeypatch.setattr(LogStore, "add_counts", broken)
    assert flush_batch(store, accepted, "batch-1", AS_OF) == "disk full"
    assert sizes(store) == (0, 0, 0)
    (listed,) = dead.dead_letter_list(store).collect()
    assert (listed.id, listed.reason, listed.n_entries) == ("batch-1", "disk full", 2)
    monkeypatch.setattr(LogStore, "add_counts", real)
    assert dead.dead_letter_replay(store) == dead.Replayed(1, 0)
    assert sizes(store) == (2, 2, 2)
    assert dead.dead_letter_list(store).count() == 0
    assert flush_batch(store, accepted, "batch-2", AS_OF) is None
    assert sizes(store) == (4, 4, 4)


def dead_entries(spark, *rows):
    schema = (
        "timestamp STRING, level STRING, service STRING, message STRING, "
        "attributes MAP<STRING,STRING>"
    )
    return spark.createDataFrame(rows, schema)


def test_replay_takes_each_dead_letter_whole_or_not_at_all(spark, store):
    good = ("2026-07-20T10:00:00Z", "info", "a", "x", {})
    write = lambda name, minute, *rows: dead.dead_letter_write(
        store, dead_entries(spark, *rows), "broken", AS_OF + timedelta(minutes=minute), name
    )
    write("mixed", 0, good, ("2026-07-20T10:00:00Z", "not-a-real-level", "a", "x", {}))
    write("undated", 1, ("soon", "info", "a", "x", {}))
    write("stale-and-blank", 2, ("2001-01-01T00:00:00Z", "info", " ", "", None))
    write("fine", 3, good, good)
    assert write("nothing", 4) is None
    assert [r.id for r in dead.dead_letter_list(store).collect()] == [
        "mixed",
        "undated",
        "stale-and-blank",
        "fine",
    ]
    first = dead.dead_letter_list(store, limit=2).collect()
    after = dead.position(dead.oldest_dead(store, limit=2)[-1])
    rest = dead.dead_letter_list(store, limit=2, after=after).collect()
    assert [r.id for r in first + rest] == ["mixed", "undated", "stale-and-blank", "fine"]
    kept = {r.entry_id for r in dead.dead_letter_entries(store).collect() if r.id == "fine"}
    assert len(kept) == 2
    assert dead.dead_letter_replay(store, limit=3) == dead.Replayed(1, 2)
    assert sizes(store) == (1, 1, 1)
    assert dead.dead_letter_replay(store) == dead.Replayed(1, 2)
    assert sizes(store) == (3, 3, 3)
    assert kept < {r.id for r in store.scan_logs().collect()}
    assert dead.dead_letter_entries(store).count() == 3


def test_a_long_queue_is_replayed_behind_its_bad_letters(spark, store, monkeypatch):
    monkeypatch.setattr(dead, "REPLAY_PAGE", 3)
    for number in range(8):
        level = "no-level" if number < 5 else "info"
        row = ("2026-07-20T10:00:00Z", level, "a", "x", {})
        at = AS_OF + timedelta(minutes=number)
        dead.dead_letter_write(store, dead_entries(spark, row), "broken", at, f"d{number}")
    assert dead.dead_letter_replay(store) == dead.Replayed(3, 5)


def test_retention_cuts_raw_rows_by_day_and_rollups_by_instant(store, logs):
    table = logs(
        [(day(-60), "info", "a", "x"), (day(-30, 3), "info", "a", "x"), (day(-30, 12), "info", "a", "x"), (day(0), "info", "a", "x")]
    )
    store.load_batch(table, "one")
    store.load_batch(table.filter("id = '0001'"), "early")
    assert retention.expired_partitions(store, AS_OF, 30) == ["logs_2026_05_22"]
    for dropped in (["logs_2026_05_22"], []):
        assert retention.retain(store, AS_OF, 30).dropped == dropped
        assert sizes(store) == (4, 2, 2)
    left = folders.matching(store.spark, f"{store.rollup_path('hour')}/dt=2026-06-21/*")
    assert [folders.partition_values(p)["batch_id"] for p in left] == ["one"]


def test_stray_rows_are_moved_or_dropped(store, logs):
    table = logs(
        [
            (day(2), "info", "a", "x"),
            (day(2), "info", "b", "x"),
            (day(3), "info", "a", "x"),
            (day(-95), "info", "a", "x"),
            (day(-30, 23), "info", "a", "x"),
        ]
    )
    store.park_stray(table, "late")
    assert retention.stray_days(store.scan_stray()).count() == 4
    assert store.scan_logs(include_stray=True).count() == 5
    report = {r.name: r for r in stats.store_report(store, AS_OF).collect()}
    assert report["rows"].rows == 5
    assert retention.backfill_day(store, date(2026, 7, 24)) == 1
    assert retention.backfill_day(store, date(2026, 7, 24)) == 0
    done = retention.reconcile_stray(store, AS_OF, 30)
    assert done == retention.Reconciled(2, ["logs_2026_07_23"])
    assert sizes(store) == (3, 3, 3)
    assert {r.id for r in store.scan_logs().collect()} == {"0000", "0001", "0002"}
    assert retention.reconcile_stray(store, AS_OF, 30) == retention.Reconciled(0, [])


def test_report_totals_need_no_scan_of_the_rows(store, logs):
    """Equal to a scan for any clock, and only the first, the last and the recent days are read."""
    def lines(**how):
        return sorted(map(str, stats.store_report(store, clock, **how).collect()))

    clock = AS_OF
    assert lines() == lines(source="raw")  # nothing stored yet
    for k in range(6):
        rows = [(day(-k, h), level, f"s{h}", "x") for h in (0, 9, 23) for level in ("info", "error")]
        store.load_batch(logs([*rows, (str(AS_OF - timedelta(days=k, seconds=30)), "warn", "now", "y")]), f"b{k}")
    store.park_stray(logs([(day(-95), "info", "old", "x"), (day(3), "debug", "new", "x")]), "late")
    for clock in (AS_OF, AS_OF - timedelta(days=2), AS_OF + timedelta(days=400), AS_OF - timedelta(days=400)):
        assert lines() == lines(source="raw")
    read = stats.store_totals(store, AS_OF).inputFiles()
    days = {f.split("/logs/dt=")[1][:10] for f in read if "/logs/" in f}
    middle = {str(TODAY - timedelta(days=k)) for k in (1, 2, 3)}
    assert days and not days & middle
    store.add_counts(logs([(day(0), "info", "a", "x")]), "day", "wrong")
    assert lines() != lines(source="raw")
    with pytest.raises(ValueError, match="source"):
        stats.store_report(store, AS_OF, source="guess")


def test_a_move_that_died_before_clearing_the_stray_rows_can_run_again(store, logs, monkeypatch):
    store.park_stray(logs([(day(1), "info", "a", "x")]), "late")
    real = folders.remove

    def dies(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(folders, "remove", dies)
    with pytest.raises(RuntimeError):
        retention.backfill_day(store, date(2026, 7, 22))
    monkeypatch.setattr(folders, "remove", real)
    assert retention.backfill_day(store, date(2026, 7, 22)) == 1
    assert sizes(store) == (1, 1, 1)


def test_backfill_fills_raw_rows_and_rollups(spark, store, logs):
    store.park_stray(logs([(day(-2), "info", "a", "x")]), "late")
    entries = spark.createDataFrame(
        [
            ("e", 0, '{"timestamp":"2026-07-19T01:00:00Z","level":"info","service":"a","message":"m"}'),
            ("e", 1, '{"timestamp":"2026-05-01T01:00:00Z","level":"info","service":"a","message":"m"}'),
            ("e", 2, "{}"),
        ],
        "envelope STRING, index INT, entry STRING",
    )
    done = backfill(store, entries, "history", AS_OF, 30)
    assert (done.accepted, done.discarded, done.rejected, done.status) == (1, 1, 1, 200)
    assert done.dates == [date(2026, 7, 19)]
    assert [tuple(r) for r in done.rejected_rows.collect()] == [("e", 2, "invalid timestamp")]
    assert sizes(store) == (2, 2, 2)
    assert store.days(store.stray_path) == [] or store.scan_stray().count() == 0
