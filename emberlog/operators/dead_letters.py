"""The dead-letter queue: batches that failed to load, kept for replay.

A dead letter is entry rows, not one row holding an array: a failed batch may be of any size and
must not be gathered in one task.  Directories name the day of failure and the write that queued
the rows, so there are as many as days and writes, whatever the number of letters.  Letters that
leave the queue are written down in a note; it counts once a file of its name stands among
``dead_done``, and a directory goes when all its letters have left.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from emberlog.functions.text import entry_id
from emberlog.functions.time import millis, parse_iso
from emberlog.schema import DEAD_ENTRIES, DEAD_LETTER, DEAD_LETTER_LIMIT, LEVELS
from emberlog.session import cut_lineage
from emberlog.sources import folders
from emberlog.sources.store import LogStore, among, check_batch_id

#: Dead letters loaded together, as one batch.
REPLAY_PAGE = 100_000

#: What names a dead letter, oldest first.
POSITION = ("failed_ms", "dead_id")


def dead_letter_write(
    store: LogStore,
    entries: DataFrame,
    reason: str,
    failed_at: str | datetime,
    dead_id: str | None = None,
) -> str | None:
    """Queue a failed batch; returns its id, or None for an empty batch.

    ``entries`` need timestamp text (``timestamp_text`` or a text ``timestamp``),
    level, service, message and attributes, and keep the id they would have been stored
    under (from ``envelope`` and ``index``).  Repeating an id replaces it.
    """
    dead_id = check_batch_id(dead_id or str(uuid.uuid4()))
    if "id" not in entries.columns or "envelope" in entries.columns:
        place = ("envelope", "index") if "envelope" in entries.columns else ()
        name = [F.lit(dead_id), *(F.col(c).cast("string") for c in place)]
        if not place:
            name.append(F.monotonically_increasing_id().cast("string"))
        entries = entries.withColumn("id", entry_id(*name))
    if "timestamp_text" in entries.columns:
        entries = entries.withColumn("timestamp", F.col("timestamp_text"))
    written = write_dead(
        store,
        entries.withColumn("reason", F.lit(reason))
        .withColumn("failed_ms", F.lit(millis(failed_at)))
        .withColumn("dead_id", F.lit(dead_id)),
    )
    found = folders.matching(store.spark, f"{store.dead_path}/failed_dt=*/written={written}")
    return dead_id if found else None


def failed_day(failed_ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(failed_ms))


def write_dead(store: LogStore, rows: DataFrame) -> str:
    """Queue rows that already carry reason, failed_ms and dead_id; returns the write's name.

    A letter that was queued before is replaced.  A write that dies before its end leaves both;
    repeating it replaces both.
    """
    earlier = folders.matching(store.spark, f"{store.dead_path}/failed_dt=*/written=*")
    name = f"write-{uuid.uuid4().hex}"
    (
        rows.select(DEAD_ENTRIES.fieldNames())
        .withColumns({"failed_dt": failed_day(F.col("failed_ms")), "written": F.lit(name)})
        .hint("rebalance", F.col("failed_dt"))
        .sortWithinPartitions("failed_dt", *POSITION)
        .write.mode("append")
        .partitionBy("failed_dt", "written")
        .parquet(store.dead_path)
    )
    if earlier:
        found = letters(store.scan_queued())
        fresh = F.col("written") == name
        retire(store, among(found.filter(~fresh), found.filter(fresh), "left_semi", POSITION))
    return name


def letters(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per dead letter, with aggregates of its entries."""
    names = DEAD_LETTER.fieldNames()
    return rows.groupBy(names).agg(*more) if more else rows.select(names).distinct()


def retire(store: LogStore, gone: DataFrame) -> None:
    """Take letters out of the queue."""
    if not gone.isEmpty():
        name = f"drop-{uuid.uuid4().hex}"
        gone.write.parquet(f"{store.gone_path}/note={name}")
        close_note(store, name)
        sweep(store)


def close_note(store: LogStore, name: str) -> None:
    folders.create(store.spark, f"{store.done_path}/{name}", name)


def sweep(store: LogStore) -> None:
    """Remove the directories that all letters have left; with the last of them go the notes."""
    names = store.notes()
    if not names:
        return
    place = ("failed_dt", "written")
    left = store.scan_queued().select(*place).distinct()
    for row in among(
        store.scan_notes(names).select(*place).distinct(), left, "left_anti", place
    ).collect():  # at most one row per directory
        day = row.failed_dt or "__HIVE_DEFAULT_PARTITION__"
        folders.remove(store.spark, f"{store.dead_path}/failed_dt={day}/written={row.written}")
    if not folders.matching(store.spark, f"{store.dead_path}/failed_dt=*/written=*"):
        for name in names:
            folders.remove(store.spark, f"{store.gone_path}/note={name}")
            folders.remove(store.spark, f"{store.done_path}/{name}")


def discard_dead(store: LogStore, dead_id: str) -> None:
    """Take back a dead letter, for a batch that is about to be tried again."""
    if folders.matching(store.spark, f"{store.dead_path}/failed_dt=*/written=*"):
        retire(store, letters(store.scan_queued().filter(F.col("dead_id") == dead_id)))


def position(letter: Row) -> tuple[int, str]:
    """Place of a dead letter in the queue: time of failure in milliseconds, and id."""
    return letter.failed_ms, letter.dead_id


def behind(store: LogStore, after: tuple[int, str] | None) -> DataFrame:
    """Entries of the letters behind a position."""
    rows = store.scan_queued()
    if after is None:
        return rows
    failed_ms, dead_id = F.lit(after[0]).cast("long"), F.lit(after[1])
    return rows.filter(F.col("failed_dt") >= failed_day(failed_ms)).filter(
        (F.col("failed_ms") > failed_ms)
        | ((F.col("failed_ms") == failed_ms) & (F.col("dead_id") > dead_id))
    )


def page_of(rows: DataFrame, limit: int | None) -> DataFrame:
    """The oldest letters of some entries: (failed_ms, dead_id), in order."""
    queue = rows.select(*POSITION).distinct().orderBy(*POSITION)
    return queue if limit is None else queue.limit(limit)


def oldest_dead(
    store: LogStore, limit: int | None = None, after: tuple[int, str] | None = None
) -> list[Row]:
    """Names of the dead letters behind a position, oldest first; a page or all of them."""
    return page_of(behind(store, after), limit).collect()


def waiting(store: LogStore) -> int:
    """Length of the queue."""
    return page_of(store.scan_queued(), None).count()


def listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        F.col("dead_id").alias("id"), F.timestamp_millis("failed_ms").alias("failed_at")
    ).agg(F.max("reason").alias("reason"), F.count("*").alias("n_entries"))


def dead_letter_list(
    store: LogStore, limit: int | None = DEAD_LETTER_LIMIT, after: tuple[int, str] | None = None
) -> DataFrame:
    """A page of the queue, oldest first: (id, failed_at, reason, n_entries).

    The next page lies behind the last row's (``unix_millis(failed_at)``, id).
    """
    queue = listed(behind(store, after)).orderBy("failed_at", "id")
    return queue if limit is None else queue.limit(limit)


def dead_letter_pages(store: LogStore, limit: int = DEAD_LETTER_LIMIT) -> DataFrame:
    """Every page of the queue at once, oldest first: the rows of ``dead_letter_list`` and the number
    of their ``page``, from 1."""
    queue = numbered(listed(store.scan_queued()), "failed_at", "id")
    page = F.floor(F.col("number") / limit) + 1
    return queue.withColumn("page", page).orderBy("number").drop("number")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their ``number`` in this order, from 0.  They are counted within the parts of a
    sorted copy, and of the parts only the sizes meet."""
    sorted_rows = rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    kept = cut_lineage(sorted_rows).withColumns(
        {"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}
    )
    sizes = kept.groupBy("part").agg(F.count("*").alias("size"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("begin"))
    number = (F.col("begin") + F.col("at")).alias("number")
    return kept.join(F.broadcast(begins), "part").select(*rows.columns, number)


def dead_letter_entries(
    store: LogStore, limit: int | None = DEAD_LETTER_LIMIT, after: tuple[int, str] | None = None
) -> DataFrame:
    """The entries of a page of dead letters, one row each; ``entry_id`` is the entry's own."""
    rows = behind(store, after)
    if limit is not None:
        rows = among(rows, page_of(rows, limit), "left_semi", POSITION)
    rows = rows.select(DEAD_ENTRIES.fieldNames())
    return rows.withColumnsRenamed({"id": "entry_id", "dead_id": "id"}).withColumn(
        "failed_at", F.timestamp_millis("failed_ms")
    ).drop("failed_ms")


def storable() -> Column:
    """What the table itself demands; stale or blank entries do go through on replay."""
    return F.coalesce(
        F.col("level").isin(*LEVELS)
        & parse_iso(F.col("timestamp")).isNotNull()
        & F.col("service").isNotNull()
        & F.col("message").isNotNull(),
        F.lit(False),
    )


@dataclass(frozen=True)
class Replayed:
    replayed: int
    still_failed: int


def dead_letter_replay(store: LogStore, limit: int | None = None) -> Replayed:
    """Load dead letters, each on its own, whole or not at all: the oldest ``limit``, or all.

    One job decides for all of them; those that can go are loaded ``REPLAY_PAGE`` at a time,
    one that cannot is passed over.  A page is written down in a note, loaded as a batch
    of the note's name, and leaves the queue when the note is closed.  A replay that dies half way can
    simply be run again: it first loads the notes left open anew, which replaces their batches.
    """
    replayed = 0
    for name in store.notes(done=False):
        if name.startswith("replay-"):
            replayed += store.scan_notes([name]).count()
            load_dead(store, name)
    verdicts = letters(store.scan_queued(), F.bool_and(storable()).alias("whole"))
    queue = numbered(verdicts, *POSITION)
    if limit is not None:
        queue = queue.filter(F.col("number") < limit)
    queue = queue.withColumn("page", F.floor(F.col("number") / REPLAY_PAGE))
    pages = queue.groupBy("page").agg(
        F.count("*").alias("taken"), F.count_if("whole").alias("good")
    )
    failed = 0
    for row in pages.orderBy("page").collect():  # one row per page
        if row.good:
            name = f"replay-{uuid.uuid4().hex}"
            good = queue.filter((F.col("page") == row.page) & F.col("whole"))
            good.select(DEAD_LETTER.fieldNames()).write.parquet(f"{store.gone_path}/note={name}")
            load_dead(store, name)
        replayed += row.good
        failed += row.taken - row.good
    sweep(store)
    return Replayed(replayed, failed)


def load_dead(store: LogStore, name: str) -> None:
    """Load the letters of a note as a batch, then close it."""
    entries = among(store.scan_queued(), store.scan_notes([name]), "left_semi")
    logs = entries.select(
        "id",
        parse_iso(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        F.lower("message").alias("message_lower"),
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
    ).withColumn("dt", F.to_date("timestamp"))
    store.load_batch(logs, name)
    close_note(store, name)
