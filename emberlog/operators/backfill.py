"""Historical load into the store."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame

from emberlog.operators.retention import backfill_day
from emberlog.operators.validation import derive_columns, split_backfill, validate_entries
from emberlog.schema import DEFAULT_RETENTION_DAYS
from emberlog.session import scratch
from emberlog.sources.store import LogStore


@dataclass(frozen=True)
class Backfilled:
    accepted: int
    discarded: int
    rejected: int
    status: int
    dates: list[date]
    rejected_rows: DataFrame  # envelope, index, reason of every refused entry


def backfill(
    store: LogStore,
    entries: DataFrame,
    batch_id: str,
    as_of: str | datetime,
    days: int = DEFAULT_RETENTION_DAYS,
) -> Backfilled:
    """Load old entries that are still within retention, in raw rows and rollups.

    Entries are parsed once, into the shared folder; counts, refused rows and the load
    come from there.  Parked rows of the days touched are moved into place first.
    """
    staged = scratch(store.spark, "backfill")
    validated = validate_entries(entries, as_of, retention_days=days, allow_stale=True)
    validated.write.parquet(staged)
    to_insert, rejected, outcome = split_backfill(store.spark.read.parquet(staged), as_of, days)
    counted = outcome.collect()  # one row per day of the window, at most
    totals = dict.fromkeys(("accepted", "discarded", "rejected"), 0)
    for row in counted:
        totals[row.outcome] += row["count"]
    touched = sorted(row.dt for row in counted if row.dt is not None)
    for day in touched:
        backfill_day(store, day)
    store.load_batch(derive_columns(to_insert, batch_id), batch_id)
    status = 200 if totals["accepted"] else 400
    return Backfilled(**totals, status=status, dates=touched, rejected_rows=rejected)
