"""Newest-first search with keyset paging."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.arguments import check_limit, check_search
from emberlog.functions.cursors import decode_cursor, encode_cursor
from emberlog.functions.predicates import all_filters
from emberlog.functions.time import ceil_to, floor_to, instant, ts_lit
from emberlog.schema import (
    DEFAULT_LIMIT,
    LOG_COLUMNS,
    LOGS,
    TABLE_ROWS_SHOWN,
    TAIL_ROWS_KEPT,
)
from emberlog.sources.store import LogStore

HOUR = 3600

#: The columns of a page.
_PAGE = T.StructType([LOGS[name] for name in LOG_COLUMNS])


def project_log(logs: DataFrame) -> DataFrame:
    return logs.select(*LOG_COLUMNS)


def newest_first(logs: DataFrame, limit: int) -> DataFrame:
    """Top rows by (timestamp, id); plans as one take-ordered step, not a sort."""
    return project_log(logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit))


def after_cursor(logs: DataFrame, timestamp: datetime, row_id: str) -> DataFrame:
    """Rows strictly after the cursor; the plain upper bound is there for the scan."""
    at = ts_lit(timestamp)
    ts = F.col("timestamp")
    logs = logs.filter((ts < at) | ((ts == at) & (F.col("id") < row_id)))
    logs = logs.filter(ts <= at)
    if "dt" in logs.columns:
        logs = logs.filter(F.col("dt") <= F.lit(instant(timestamp).date()))
    return logs


def search_logs(
    logs: DataFrame,
    *,
    service: str | None = None,
    level: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    q: str | None = None,
    attr: Mapping[str, str] | None = None,
    limit: int | None = None,
    cursor: str | None = None,
) -> DataFrame:
    """One page of the newest rows meeting all filters, after ``cursor`` if given."""
    limit = DEFAULT_LIMIT if limit is None else limit
    filters = dict(service=service, level=level, since=since, until=until, q=q, attr=attr)
    check_search(**filters, limit=limit, cursor=cursor)
    rows = all_filters(logs, **filters)
    if cursor is not None:
        rows = after_cursor(rows, *decode_cursor(cursor))
    return newest_first(rows, limit)


def page_floor(
    store: LogStore,
    limit: int,
    *,
    service: str | None = None,
    level: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    cursor: str | None = None,
) -> datetime | None:
    """An hour from which on at least ``limit`` matching rows are counted, or None.

    Read from the hourly rollup, over hours that lie wholly inside the range and
    wholly after the cursor: the newest day first, then twice as many each time.  One
    count per hour of the days needed comes back, the newest hours first.
    """
    ends = [floor_to(instant(until), HOUR)] if until else []
    if cursor is not None:
        ends.append(floor_to(decode_cursor(cursor)[0], HOUR))
    low = ceil_to(instant(since), HOUR) if since else None
    high = min(ends) if ends else None
    days, seen, width = store.newest_days(low and low.date(), high and high.date()), 0, 1
    while days:
        window, days = days[:width], days[width:]
        partials = store.scan_partials("hour", *_of_days(window, low, high))
        hours = (
            all_filters(
                partials.withColumnRenamed("bucket", "timestamp"), service=service, level=level
            )
            .groupBy(F.unix_seconds("timestamp").alias("hour"))
            .agg(F.sum("count").alias("count"))
            .collect()  # at most 24 rows per listed day
        )
        for row in sorted(hours, key=lambda row: -row.hour):
            seen += row["count"]
            if seen >= limit:
                return datetime.fromtimestamp(row.hour, UTC)
        width *= 2
    return None


def _of_days(
    window: list[date], low: datetime | None, high: datetime | None
) -> tuple[datetime, datetime]:
    """The part of a range that lies in a window of days (newest first)."""
    first, last = instant(window[-1]), instant(window[0]) + timedelta(days=1)
    return max(first, low) if low else first, min(last, high) if high else last


def search_store(
    store: LogStore,
    *,
    service: str | None = None,
    level: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    q: str | None = None,
    attr: Mapping[str, str] | None = None,
    limit: int | None = None,
    cursor: str | None = None,
) -> DataFrame:
    """``search_logs`` over the store, reading only what the page needs.

    For a page asked for by service and level alone the rollup tells an hour from which
    it should be full; messages and attributes have no counts to go by.  From that
    hour, or the newest day, on the days are searched backwards, each time twice as many,
    until the page is full: no day is read twice and no other day is listed.  The
    rows of the page itself, at most ``limit``, are what passes through the driver.
    Batches whose summary of messages (``sources.grams``) lacks a string of ``q`` are not read.
    """
    limit = DEFAULT_LIMIT if limit is None else limit
    keys = dict(service=service, level=level, since=since, until=until)
    filters = dict(**keys, q=q, attr=attr)
    check_search(**filters, limit=limit, cursor=cursor)
    low = instant(since) if since else None
    high = instant(until) if until else None
    at = decode_cursor(cursor) if cursor is not None else None
    if at is not None:
        after = instant(at[0]) + timedelta(milliseconds=1)
        high = min(high, after) if high else after
    floor = None if q or attr else page_floor(store, limit, **keys, cursor=cursor)

    spans: list[tuple[datetime, datetime | None]] = []
    days = store.newest_days(low and low.date(), high and high.date())
    if floor is not None:
        spans.append((max(floor, low) if low else floor, high))
        days = [day for day in days if day <= floor.date()]
        high = floor
    width = 1
    while days:
        window, days = days[:width], days[width:]
        spans.append(_of_days(window, low, high))
        width *= 2

    pages: list[pa.Table] = []
    missing = limit
    for first, last in spans:
        rows = all_filters(
            store.scan_logs(first, last, may_hold=q), **{**filters, "since": first, "until": last}
        )
        if at is not None:
            rows = after_cursor(rows, *at)
        page = newest_first(rows, missing).toArrow()
        if page.num_rows:
            pages.append(page)
        missing -= page.num_rows
        if not missing:
            break
    if not pages:
        return no_rows(store)
    return store.spark.createDataFrame(pa.concat_tables(pages).combine_chunks(), _PAGE)


def no_rows(store: LogStore) -> DataFrame:
    """A page without rows."""
    return store.spark.createDataFrame([], _PAGE)


def pages(store: LogStore, *, limit: int | None = None, **filters) -> Iterator[DataFrame]:
    """All pages of ``search_store``, newest first, each asked for when it is taken.

    The first page is always there, empty if nothing matches; a page that is not full is the
    last, and so is an empty one behind rows that end exactly with a page.
    """
    limit = DEFAULT_LIMIT if limit is None else limit
    cursor = filters.pop("cursor", None)
    while True:
        page = search_store(store, **filters, limit=limit, cursor=cursor)
        yield page
        found = next_cursor(page, limit).first()
        if found is None:
            return
        cursor = found.cursor


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """(timestamp, id, cursor) of the page's last row, or no row if it is not full.

    A page ending exactly at the last row still gives a cursor; the page after
    it is empty.
    """
    check_limit(limit)
    last = page.agg(
        F.min(F.struct("timestamp", "id")).alias("last"), F.count("*").alias("rows")
    ).filter(F.col("rows") == limit)
    return last.select(
        F.col("last.timestamp").alias("timestamp"),
        F.col("last.id").alias("id"),
        encode_cursor(F.col("last.timestamp"), F.col("last.id")).alias("cursor"),
    )


def first_rows(buckets: DataFrame, n: int = TABLE_ROWS_SHOWN) -> DataFrame:
    return buckets.orderBy("start", "group").limit(n)


def tail_last(tail: DataFrame, n: int = TAIL_ROWS_KEPT) -> DataFrame:
    """The newest tailed entries (they have no id to break ties by)."""
    return tail.orderBy(
        F.desc("timestamp"), F.desc("service"), F.desc("level"), F.desc("message")
    ).limit(n)
