from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.time import millis
from emberlog.operators import dead_letters as dead
from emberlog.plans.queries import contents
from emberlog.sources import folders

AS_OF = datetime(2026, 7, 21, 9, 30, tzinfo=UTC)
ENTRY = "timestamp STRING, level STRING, service STRING, message STRING, attributes MAP<STRING,STRING>"


def queue(spark, n, per=3, bad=4):
    """``n`` letters of some entries, one a minute; every ``bad``-th holds an unknown level."""
    number = F.col("id")
    letter = F.floor(number / per).cast("long")
    level = F.when((letter % bad == 0) & (number % per == 1), "none").otherwise("info")
    return spark.range(n * per, numPartitions=3).select(
        number.cast("string").alias("id"),
        F.lit("broken").alias("reason"),
        F.lit("2026-07-20T10:00:00Z").alias("timestamp"),
        level.alias("level"),
        F.lit("a").alias("service"),
        F.lit("x").alias("message"),
        F.create_map().cast("map<string,string>").alias("attributes"),
        (F.lit(millis(AS_OF)) + letter * 60_000).alias("failed_ms"),
        F.format_string("d%04d", letter).alias("dead_id"),
    )


def directories(store):
    return folders.matching(store.spark, f"{store.dead_path}/*/*")


def test_directories_do_not_grow_with_the_letters(spark, store):
    dead.write_dead(store, queue(spark, 200))
    assert len(directories(store)) == 1
    pages = dead.dead_letter_pages(store, limit=30).collect()
    assert [r.page for r in pages] == [1 + k // 30 for k in range(200)]
    assert [r.id for r in pages] == [f"d{k:04d}" for k in range(200)]
    assert {r.n_entries for r in pages} == {3}
    after, walked = None, []
    while part := dead.oldest_dead(store, 30, after):
        walked += dead.dead_letter_list(store, 30, after).collect()
        after = dead.position(part[-1])
    assert walked == [r[:-1] for r in pages]
    assert dead.dead_letter_replay(store) == dead.Replayed(150, 50)
    assert tuple(contents(store).first()) == (450, 450, 450)
    assert len(folders.matching(spark, f"{store.logs_path}/dt=*/batch_id=*")) == 1
    assert dead.waiting(store) == 50
    assert dead.dead_letter_replay(store) == dead.Replayed(0, 50)


def test_a_page_of_a_replay_takes_the_oldest_and_the_last_letter_clears_the_queue(spark, store, monkeypatch):
    monkeypatch.setattr(dead, "REPLAY_PAGE", 7)
    dead.write_dead(store, queue(spark, 20, bad=100))
    assert dead.dead_letter_replay(store, limit=10) == dead.Replayed(9, 1)
    assert [r.dead_id for r in dead.oldest_dead(store, 3)] == ["d0000", "d0010", "d0011"]
    dead.discard_dead(store, "d0000")
    assert dead.dead_letter_replay(store) == dead.Replayed(10, 0)
    assert directories(store) == [] == store.notes() == store.notes(done=False)
    assert tuple(contents(store).first()) == (57, 57, 57)


def test_a_letter_written_again_is_replaced_and_no_other(spark, store):
    dead.write_dead(store, queue(spark, 5))
    entry = ("2026-07-20T10:00:00Z", "info", "a", "again", {})
    one = lambda *rows: spark.createDataFrame(rows, ENTRY)
    dead.dead_letter_write(store, one(entry), "worse", AS_OF + timedelta(minutes=2), "d0002")
    found = {r.id: (r.reason, r.n_entries) for r in dead.dead_letter_list(store).collect()}
    assert found == {f"d{k:04d}": ("broken", 3) for k in range(5)} | {"d0002": ("worse", 1)}
    # The same id at another time is another letter, as it stands elsewhere in the queue.
    dead.dead_letter_write(store, one(entry, entry), "later", AS_OF + timedelta(days=2), "d0002")
    assert [r.n_entries for r in dead.dead_letter_list(store).collect()] == [3, 3, 1, 3, 3, 2]
    assert dead.dead_letter_entries(store, limit=3).count() == 7
    dead.discard_dead(store, "d0002")
    assert dead.waiting(store) == 4
    dead.write_dead(store, queue(spark, 5))
    assert dead.dead_letter_entries(store).count() == 15


def test_a_replay_that_died_is_finished_first_and_loads_nothing_twice(spark, store, monkeypatch):
    dead.write_dead(store, queue(spark, 8))
    real = dead.close_note

    def dies(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(dead, "close_note", dies)
    with pytest.raises(RuntimeError):
        dead.dead_letter_replay(store)
    assert dead.waiting(store) == 8
    monkeypatch.setattr(dead, "close_note", real)
    dead.write_dead(store, queue(spark, 10).filter("dead_id > 'd0007'"))
    assert dead.dead_letter_replay(store) == dead.Replayed(7, 3)
    assert tuple(contents(store).first()) == (21, 21, 21)


def test_letters_of_no_known_time_wait_like_others(spark, store):
    rows = queue(spark, 2, bad=100).withColumn("failed_ms", F.lit(None).cast("long"))
    dead.write_dead(store, rows)
    assert [r.failed_at for r in dead.dead_letter_list(store).collect()] == [None, None]
    assert dead.dead_letter_replay(store) == dead.Replayed(1, 1)
    assert dead.waiting(store) == 1
