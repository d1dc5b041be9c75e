"""Instants on the driver and time expressions on columns (all UTC, milliseconds)."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schema import BUCKET_SECONDS

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_MILLISECOND = timedelta(milliseconds=1)

# Fixed pattern: the ISO 8601 shapes an entry's timestamp may have.
ISO_SHAPE = (
    r"^([+-]\d{6}|\d{4})(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
)


def instant(value: str | date | datetime) -> datetime:
    """An aware UTC datetime cut to milliseconds; text without a zone is UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    value = value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)
    return value.replace(microsecond=value.microsecond // 1000 * 1000)


def millis(value: str | date | datetime) -> int:
    return (instant(value) - _EPOCH) // _MILLISECOND


def ts_lit(value: str | date | datetime) -> Column:
    """A timestamp literal that does not depend on the Python process's zone."""
    return F.timestamp_millis(F.lit(millis(value)))


def floor_to(value: datetime, seconds: int) -> datetime:
    step = seconds * 1000
    return _EPOCH + (millis(value) // step * step) * _MILLISECOND


def ceil_to(value: datetime, seconds: int) -> datetime:
    low = floor_to(value, seconds)
    return low if low == instant(value) else low + timedelta(seconds=seconds)


def cover(
    since: str | datetime, until: str | datetime, grains: tuple[tuple[str, int], ...]
) -> tuple[dict[str, list[tuple[datetime, datetime]]], list[tuple[datetime, datetime]]]:
    """Split ``[since, until)`` into spans of whole grains and what is left.

    ``grains`` are (name, seconds), coarsest first, each a multiple of the next.  The coarsest takes the middle, the
    next one both sides of it and so on: at most two spans per grain, and two rests that
    are each shorter than the finest grain.
    """
    open_ = [(instant(since), instant(until))]
    spans: dict[str, list[tuple[datetime, datetime]]] = {}
    for name, step in grains:
        rest = []
        for low, high in open_:
            first, last = ceil_to(low, step), floor_to(high, step)
            if first < last:
                spans.setdefault(name, []).append((first, last))
                rest += [(low, first), (last, high)]
            elif first == last:
                rest += [(low, first), (first, high)]
            else:
                rest.append((low, high))
        open_ = [(low, high) for low, high in rest if low < high]
    return spans, open_


def day_lit(value: datetime) -> Column:
    return F.lit(instant(value).date())


def time_bucket(ts: Column, bucket: str) -> Column:
    """Start of the 1m / 5m / 1h / 1d bucket holding ``ts``.

    The bucket origin is 2000-01-01 UTC.  It lies a whole number of days after
    the Unix epoch, so flooring the epoch offset gives the same buckets.
    """
    step = F.lit(BUCKET_SECONDS[bucket] * 1_000_000)
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, step))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def to_millis(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts)


def parse_iso(text: Column) -> Column:
    """ISO 8601 text to a timestamp cut to milliseconds, NULL when it is not one.

    A bare cast is both too wide (it takes ``12:30`` and zone names) and too
    narrow (it refuses ``2024-01-01T10:00Z`` and hour 24), hence the shape test
    and, for texts the cast refuses, two rewrites.
    """
    padded = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    next_day = F.regexp_replace(padded, r"([T ])24:00:00", "$100:00:00")
    rewritten = F.when(
        padded.rlike(r"[T ]24:00:00(\.0+)?(Z|[+-]|$)"),
        next_day.try_cast("timestamp") + F.expr("INTERVAL 24 HOURS"),
    ).otherwise(padded.try_cast("timestamp"))
    parsed = F.coalesce(text.try_cast("timestamp"), rewritten)
    return F.when(text.rlike(ISO_SHAPE), to_millis(parsed))


def is_stale(ts: Column, as_of: datetime, days: int) -> Column:
    """Older than the retention window, counted in exact 24-hour days."""
    return ts < ts_lit(instant(as_of) - timedelta(days=days))
