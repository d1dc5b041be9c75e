"""Row filters of the search and the aggregate, as plain Column predicates."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import contains_pattern
from emberlog.functions.time import day_lit, instant, ts_lit
from emberlog.schema import NO_PAIR, PAIR_COLUMNS, PAIRS_GO_ON


def by_service(service: str) -> Column:
    return F.col("service") == service


def by_level(level: str) -> Column:
    return F.col("level") == level


def by_time(
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    *,
    column: str = "timestamp",
    day: str | None = None,
) -> Column:
    """``since`` is inclusive, ``until`` exclusive; both are optional.

    With ``day`` (the name of the partition column) the same bounds are put on
    the day too, which is what lets a scan skip whole partitions.
    """
    terms = [F.lit(True)]
    if since:
        terms.append(F.col(column) >= ts_lit(since))
        if day:
            terms.append(F.col(day) >= day_lit(instant(since)))
    if until:
        terms.append(F.col(column) < ts_lit(until))
        if day:
            terms.append(F.col(day) <= day_lit(instant(until)))
    return reduce(Column.__and__, terms)


def by_spans(spans: list[tuple[datetime, datetime]], column: str, day: str) -> Column:
    """Within any of some ranges; each also bounds the partition column."""
    terms = [by_time(low, high, column=column, day=day) for low, high in spans]
    return reduce(Column.__or__, terms, F.lit(False))


def by_message(q: str) -> Column:
    """Case-insensitive match anywhere in the message."""
    return F.col("message_lower").like(contains_pattern(q))


def by_attribute(attr: Mapping[str, str]) -> Column:
    terms = [F.col("attributes")[key] == value for key, value in attr.items()]
    return reduce(Column.__and__, terms, F.lit(True))


def _pair_hash(key: Column, value: Column) -> Column:
    """A hash of key and value that is never one of the marks."""
    found = F.xxhash64(key, value)
    return F.when(found.isin(PAIRS_GO_ON, NO_PAIR), F.lit(1)).otherwise(found)


def pair_values(attributes: Column) -> dict[str, Column]:
    """The pair columns of a row (see ``schema.PAIR_COLUMNS``) from its attributes."""
    pairs = F.array_sort(
        F.transform(F.map_entries(attributes), lambda e: _pair_hash(e["key"], e["value"]))
    )
    none = F.lit(NO_PAIR).cast("bigint")
    values = {name: F.coalesce(F.get(pairs, F.lit(i)), none) for i, name in enumerate(PAIR_COLUMNS)}
    last = PAIR_COLUMNS[-1]
    more = F.size(pairs) > len(PAIR_COLUMNS)
    return values | {last: F.when(more, F.lit(PAIRS_GO_ON).cast("bigint")).otherwise(values[last])}


def may_have_attribute(attr: Mapping[str, str]) -> Column:
    """False for rows whose pair columns tell that one is missing; simple enough for the file reader, so
    row groups in which no row can have the pair are skipped."""
    terms = [F.lit(True)]
    for key, value in attr.items():
        hashed = pair_hash(key, value)
        found = [F.col(name) == hashed for name in PAIR_COLUMNS]
        terms.append(reduce(Column.__or__, found, F.col(PAIR_COLUMNS[-1]) == PAIRS_GO_ON))
    return reduce(Column.__and__, terms)


def pair_hash(key: str, value: str) -> int:
    """The hash of one pair, by the very function that filled the columns."""
    return SparkSession.active().range(1).select(_pair_hash(F.lit(key), F.lit(value))).first()[0]


def all_filters(
    logs: DataFrame,
    *,
    service: str | None = None,
    level: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    q: str | None = None,
    attr: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows meeting every given filter; an absent or empty filter adds nothing."""
    terms = [F.lit(True)]
    if service:
        terms.append(by_service(service))
    if level:
        terms.append(by_level(level))
    if since or until:
        terms.append(by_time(since, until, day="dt" if "dt" in logs.columns else None))
    if q:
        terms.append(by_message(q))
    if attr:
        if PAIR_COLUMNS[0] in logs.columns:
            terms.append(may_have_attribute(attr))
        terms.append(by_attribute(attr))
    return logs.filter(reduce(Column.__and__, terms))
