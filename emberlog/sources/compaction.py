"""Packing a day's batches together, for stores fed by many small batches.

Raw rows and both rollups of a day are packed under one name and published by creating
one small file that names the packed batches (``sources.packs``).  Before that file exists
readers ignore the copy, afterwards they ignore what it replaces, so every reader sees
each row once at any moment.  Only batches that are complete in all three tables
when a run begins are packed; one that arrives meanwhile stays as it is.  The replaced
directories are removed by the next run (or ``remove_replaced``), so queries that
listed them before can finish.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from emberlog.schema import LOGS, ROLLUP
from emberlog.sources import folders, packs
from emberlog.sources.store import GRAINS, LogStore, with_filters


def _tables(store: LogStore) -> list[str]:
    return [store.logs_path, *(store.rollup_path(grain) for grain in GRAINS)]


def _batches(store: LogStore, table: str, day: date) -> set[str]:
    found = folders.matching(store.spark, f"{table}/dt={day.isoformat()}/batch_id=*")
    return {folders.partition_values(part)["batch_id"] for part in found}


def remove_replaced(store: LogStore, day: date) -> None:
    """Remove what a published copy of the day replaces, and copies that were never published."""
    published = packs.of_day(store.spark, store.root, day)
    visible = published[-1:]  # the newest names everything the older ones do
    gone = set(visible[0].batches) if visible else set()
    keep = {pack.name for pack in visible}
    for table in _tables(store):
        for name in _batches(store, table, day):
            if name in gone or (packs.is_pack(name) and name not in keep):
                folders.remove(store.spark, f"{table}/dt={day.isoformat()}/batch_id={name}")
    for pack in published[:-1]:
        folders.remove(store.spark, pack.path)


def compact_day(store: LogStore, day: date) -> bool:
    """Pack raw rows and both rollups of one day; False when there was nothing to pack.

    Rollup partials are summed.  The rebalance hint sizes the files, so a day of any size
    is rewritten by as many tasks as it needs.  One run per day at a time; a run that
    died before publishing leaves an ignored copy, which the next run removes.
    """
    remove_replaced(store, day)
    listed = [_batches(store, table, day) for table in _tables(store)]
    replaced = set.intersection(*listed)
    if len(replaced) < 2:
        return False
    name = packs.new_name(uuid.uuid4().hex)
    # Exactly the listed directories are read: what arrives later is not in the copy.
    for table, schema, order in (
        (store.logs_path, LOGS, ["service", "timestamp"]),
        *((store.rollup_path(grain), ROLLUP, ["service", "level", "bucket"]) for grain in GRAINS),
    ):
        parts = [f"{table}/dt={day.isoformat()}/batch_id={batch}" for batch in sorted(replaced)]
        rows = store.read_parts(table, schema, parts)
        if schema is ROLLUP:
            rows = rows.groupBy("bucket", "service", "level").agg(F.sum("count").alias("count"))
        (
            with_filters(rows.select(*stored(schema)).hint("rebalance").sortWithinPartitions(*order).write)
            .parquet(f"{table}/dt={day.isoformat()}/batch_id={name}")
        )
    before = {batch for pack in packs.of_day(store.spark, store.root, day) for batch in pack.batches}
    packs.publish(store.spark, store.root, day, name, sorted(before | replaced))
    return True


def compact_days(store: LogStore, days: list[date], at_once: int = 4) -> list[date]:
    """Pack several days, a few side by side; the days that had something to pack."""
    run = inheritable_thread_target(store.spark)(compact_day)
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(lambda day: run(store, day), days))
    return [day for day, packed in zip(days, done, strict=True) if packed]


def stored(schema) -> list[str]:
    """Columns kept in the files: all but the two partition columns."""
    return [name for name in schema.fieldNames() if name not in ("dt", "batch_id")]
