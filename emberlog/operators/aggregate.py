"""Counts per time bucket, from raw rows, a rollup, the live window or a mix."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.arguments import check_aggregate
from emberlog.functions.predicates import all_filters
from emberlog.functions.time import ceil_to, cover, floor_to, instant, time_bucket
from emberlog.schema import LIVE_WINDOW_MINUTES
from emberlog.sources.store import LogStore

#: Rollup grain that can answer each bucket size.
GRAIN_OF = {"1m": "minute", "5m": "minute", "1h": "hour", "1d": "hour"}
#: Rollups whose buckets fit whole into each bucket size, coarsest first.
COVERS = {
    "1m": (("minute", 60),),
    "5m": (("minute", 60),),
    "1h": (("hour", 3600), ("minute", 60)),
    "1d": (("day", 86400), ("hour", 3600), ("minute", 60)),
}
MINUTE = timedelta(minutes=1)


class LiveSource(Protocol):
    """A live table: its minute counts, and whether they are complete for a range."""

    def counts(self) -> DataFrame: ...

    def covers(self, since: str | datetime, until: str | datetime) -> bool: ...


def _group(group_by: str | None) -> Column:
    return (F.col(group_by) if group_by else F.lit(None).cast("string")).alias("group")


def _amounts(
    rows: DataFrame, instant_col: str, bucket: str, group_by: str | None, amount: Column
) -> DataFrame:
    return rows.select(
        time_bucket(F.col(instant_col), bucket).alias("start"),
        _group(group_by),
        amount.cast("bigint").alias("count"),
    )


def _summed(amounts: DataFrame) -> DataFrame:
    """One row per bucket and group.  Each task sums its own rows first, so a group
    holding most of the table is one row per task in the shuffle."""
    return amounts.groupBy("start", "group").agg(F.sum("count").alias("count"))


def _raw_amounts(rows: DataFrame, bucket: str, group_by: str | None) -> DataFrame:
    return _amounts(rows, "timestamp", bucket, group_by, F.lit(1))


def in_order(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy("start", "group")


def bucket_counts(
    logs: DataFrame,
    since: str | datetime,
    until: str | datetime,
    bucket: str,
    group_by: str | None = None,
    *,
    service: str | None = None,
    level: str | None = None,
    q: str | None = None,
    attr: Mapping[str, str] | None = None,
) -> DataFrame:
    """Count raw rows per bucket (and service or level); empty buckets are left out."""
    filters = dict(service=service, level=level, since=since, until=until, q=q, attr=attr)
    check_aggregate(bucket=bucket, group_by=group_by, **filters)
    return in_order(_summed(_raw_amounts(all_filters(logs, **filters), bucket, group_by)))


def _rollup_amounts(
    partials: DataFrame, since, until, bucket, group_by, service, level
) -> DataFrame:
    rows = all_filters(
        partials.withColumnRenamed("bucket", "timestamp"),
        service=service,
        level=level,
        since=since,
        until=until,
    )
    return _amounts(rows, "timestamp", bucket, group_by, F.col("count"))


def rollup_counts(
    partials: DataFrame,
    since: str | datetime,
    until: str | datetime,
    bucket: str,
    group_by: str | None = None,
    *,
    service: str | None = None,
    level: str | None = None,
) -> DataFrame:
    """Sum rollup counts into buckets.

    The range is tested against the start of each rollup bucket: a first partial
    bucket is left out and a last partial one counts whole.  Partials of several
    batches are summed in the same aggregation.
    """
    check_aggregate(
        bucket=bucket, group_by=group_by, since=since, until=until, service=service, level=level
    )
    amounts = _rollup_amounts(partials, since, until, bucket, group_by, service, level)
    return in_order(_summed(amounts))


def live_window(
    logs: DataFrame,
    as_of: str | datetime,
    since: str | datetime,
    until: str | datetime,
    group_by: str | None = None,
    *,
    service: str | None = None,
    level: str | None = None,
    started_at: str | datetime | None = None,
) -> DataFrame | None:
    """Minute counts of the last 15 minutes; None when that window cannot answer.

    None (``since`` lies before the window, or before counting started) is not
    the same as an empty result.  Whole minutes count: ``since`` is floored and a
    minute belongs when it starts before ``until``.
    """
    check_aggregate(
        bucket="1m", group_by=group_by, since=since, until=until, service=service, level=level
    )
    window = live_range(as_of, since, until, started_at)
    if window is None:
        return None
    rows = all_filters(
        logs, service=service, level=level, since=window[0], until=window[1]
    )
    return in_order(_summed(_raw_amounts(rows, "1m", group_by)))


def live_range(as_of, since, until, started_at=None) -> tuple[datetime, datetime] | None:
    """Whole minutes the live window covers of a range, or None if it cannot."""
    first = floor_to(instant(as_of), 60) - (LIVE_WINDOW_MINUTES - 1) * MINUTE
    if started_at is not None:
        first = max(first, floor_to(instant(started_at), 60))
    low = floor_to(instant(since), 60)
    return None if low < first else (low, ceil_to(instant(until), 60))


def live_counts(
    live: DataFrame,
    as_of: str | datetime,
    since: str | datetime,
    until: str | datetime,
    group_by: str | None = None,
    *,
    service: str | None = None,
    level: str | None = None,
    started_at: str | datetime | None = None,
) -> DataFrame | None:
    """``live_window`` from the table the live stream keeps (bucket, service, level, count)."""
    check_aggregate(
        bucket="1m", group_by=group_by, since=since, until=until, service=service, level=level
    )
    window = live_range(as_of, since, until, started_at)
    if window is None:
        return None
    return in_order(_summed(_rollup_amounts(live, *window, "1m", group_by, service, level)))


def _covered(
    store: LogStore, since, until, bucket, group_by, service, level
) -> DataFrame:
    """Each rollup for the part of the range it covers best, raw rows for what no minute covers.

    Equals the raw answer for any range.  Days fill the middle, hours and minutes both sides of it,
    so raw rows are read for less than a minute at each end; a table is scanned once, for all its
    spans, and all are summed in one aggregation.
    """
    spans, rest = cover(since, until, COVERS[bucket])
    keys = dict(service=service, level=level)
    amounts = []
    for grain, own in spans.items():
        rows = store.scan_partials_in(grain, own).withColumnRenamed("bucket", "timestamp")
        rows = all_filters(rows, **keys)
        amounts.append(_amounts(rows, "timestamp", bucket, group_by, F.col("count")))
    if rest or not amounts:
        raw = all_filters(store.scan_logs_in(rest), **keys)
        amounts.append(_raw_amounts(raw, bucket, group_by))
    return in_order(_summed(reduce(DataFrame.unionByName, amounts)))


def aggregate(
    store: LogStore,
    since: str | datetime,
    until: str | datetime,
    bucket: str,
    group_by: str | None = None,
    *,
    service: str | None = None,
    level: str | None = None,
    q: str | None = None,
    attr: Mapping[str, str] | None = None,
    source: str = "auto",
    as_of: str | datetime | None = None,
    live: LiveSource | None = None,
) -> DataFrame:
    """Bucket counts from the cheapest source that can answer.

    ``auto`` always equals the count of raw rows.  Message and attribute filters
    need raw rows; anything else is read from the rollups that cover the range, with raw rows only for
    minutes it cuts.  Minute buckets of the last 15 minutes come from
    ``live`` if it is given, the range is whole minutes and the live table has counted every
    committed batch of its days.  ``rollup``, ``raw`` and ``live`` force a source with its
    own way of treating a cut bucket; a live table that lags refuses.
    """
    filters = dict(service=service, level=level, q=q, attr=attr)
    check_aggregate(bucket=bucket, group_by=group_by, since=since, until=until, **filters)
    if source not in ("auto", "raw", "rollup", "live"):
        raise ValueError("source must be 'auto', 'raw', 'rollup' or 'live'")
    countable = not q and not attr
    keys = dict(service=service, level=level)

    if source == "raw" or not countable:
        if source in ("rollup", "live"):
            raise ValueError(f"{source} holds no counts by message or attribute")
        logs = store.scan_logs(since, until)
        return bucket_counts(logs, since, until, bucket, group_by, **filters)

    if source == "live" or (source == "auto" and bucket == "1m" and live is not None and as_of):
        whole = all(floor_to(instant(t), 60) == instant(t) for t in (since, until))
        if source == "live" and bucket != "1m":
            raise ValueError("the live window holds minute buckets only")
        if live is not None and as_of and (whole or source == "live") and live.covers(since, until):
            found = live_counts(live.counts(), as_of, since, until, group_by, **keys)
            if found is not None:
                return found
        if source == "live":
            raise ValueError("the live window cannot answer this range")

    if source == "rollup":
        grain = GRAIN_OF[bucket]
        partials = store.scan_partials(grain, since, until)
        return rollup_counts(partials, since, until, bucket, group_by, **keys)
    return _covered(store, since, until, bucket, group_by, service, level)


