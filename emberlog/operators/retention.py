"""Retention and repair: dropping old days, trimming rollups, moving stray rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.time import instant, ts_lit
from emberlog.schema import DEFAULT_RETENTION_DAYS
from emberlog.session import cut_lineage
from emberlog.sources import folders
from emberlog.sources.store import GRAINS, LogStore


def partition_name(day: date) -> str:
    return f"logs_{day:%Y_%m_%d}"


def cutoff(as_of: str | datetime, days: int) -> datetime:
    return instant(as_of) - timedelta(days=days)


def expired_days(store: LogStore, as_of: str | datetime, days: int) -> list[date]:
    """Whole days before the cutoff day, which itself stays."""
    last = cutoff(as_of, days).date()
    return [day for day in store.days() if day < last]


def expired_partitions(
    store: LogStore, as_of: str | datetime, days: int = DEFAULT_RETENTION_DAYS
) -> list[str]:
    return [partition_name(day) for day in expired_days(store, as_of, days)]


def drop_expired(
    store: LogStore, as_of: str | datetime, days: int = DEFAULT_RETENTION_DAYS
) -> list[str]:
    """Remove expired days by directory, reading no data; returns their names."""
    dropped = []
    for day in expired_days(store, as_of, days):
        store.drop_day(store.logs_path, day)
        dropped.append(partition_name(day))
    return dropped


def prune_rollups(
    store: LogStore, as_of: str | datetime, days: int = DEFAULT_RETENTION_DAYS
) -> None:
    """Drop rollup rows whose bucket starts before the exact cutoff instant.

    Whole days go by directory.  Only the cutoff day is rewritten: its kept rows
    are first set aside in the shared folder, then replace each batch's
    directory in place, so running it again after a failure gives the same end.
    """
    limit = cutoff(as_of, days)
    for grain in GRAINS:
        path = store.rollup_path(grain)
        for day in store.days(path):
            if day < limit.date():
                store.drop_day(path, day)
        if grain == "day":
            continue  # the cutoff day's raw rows are all kept, and so is its one count
        parts = folders.matching(store.spark, f"{path}/dt={limit.date().isoformat()}/batch_id=*")
        partials = store.scan_partials(grain).filter(F.col("dt") == F.lit(limit.date()))
        if not parts or partials.filter(F.col("bucket") < ts_lit(limit)).isEmpty():
            continue
        kept = cut_lineage(partials.filter(F.col("bucket") >= ts_lit(limit)))
        store.replace_counts(kept, grain)
        left = {row.batch_id for row in kept.select("batch_id").distinct().toLocalIterator()}
        for part in parts:
            if folders.partition_values(part)["batch_id"] not in left:
                folders.remove(store.spark, part)


def stray_days(stray: DataFrame) -> DataFrame:
    return stray.select(F.to_date("timestamp").alias("day")).distinct()


def _move(store: LogStore, parts: list[str]) -> dict[date, int]:
    """Load parked rows into their days, remove the parked copies; rows moved per day.

    The target batch is named after the parked one, so a move that is repeated
    after a failure replaces its own files.  Parked rows are in no rollup, so
    they are counted when they move.
    """
    if not parts:
        return {}
    rows = store.read_stray(parts)
    per_day = rows.groupBy("dt").agg(F.count("*").alias("rows"))
    moved = {row.dt: row.rows for row in per_day.collect()}  # one row per listed day
    store.load_rows(rows.withColumn("batch_id", F.concat(F.lit("stray-"), F.col("batch_id"))))
    for part in parts:
        folders.remove(store.spark, part)
    return moved


def _parked(store: LogStore, day: str = "*") -> list[str]:
    return folders.matching(store.spark, f"{store.stray_path}/dt={day}/batch_id=*")


def backfill_day(store: LogStore, day: date) -> int:
    """Move the parked rows of one UTC day into its partition, keeping their ids."""
    return sum(_move(store, _parked(store, day.isoformat())).values())


@dataclass(frozen=True)
class Reconciled:
    deleted: int
    backfilled: list[str]


def reconcile_stray(
    store: LogStore, as_of: str | datetime, days: int = DEFAULT_RETENTION_DAYS
) -> Reconciled:
    """Delete parked days that start before the cutoff instant, move all others.

    All days go in one job.  On the cutoff day parked rows are deleted although
    the day's own partition would still be kept: the day starts before the
    cutoff instant unless that is midnight.
    """
    limit = cutoff(as_of, days)
    parts = _parked(store)
    old = [p for p in parts if instant(folders.partition_values(p)["dt"]) < limit]
    keep = [p for p in parts if p not in set(old)]
    deleted = store.read_stray(old).count() if old else 0
    moved = _move(store, keep)
    for part in old:
        folders.remove(store.spark, part)
    return Reconciled(deleted, [partition_name(day) for day in sorted(moved) if moved[day]])


@dataclass(frozen=True)
class Retained:
    dropped: list[str]
    reconciled: Reconciled


def retain(
    store: LogStore, as_of: str | datetime, days: int = DEFAULT_RETENTION_DAYS
) -> Retained:
    """Trim the rollups, drop expired days, then settle the parked rows.

    Rollups go first: at no moment do they count rows that are already gone,
    which the search over the store relies on.
    """
    prune_rollups(store, as_of, days)
    dropped = drop_expired(store, as_of, days)
    return Retained(dropped, reconcile_stray(store, as_of, days))
