"""Argument checks of the query operators; each raises ValueError with a fixed text."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from emberlog.functions.cursors import decode_cursor
from emberlog.functions.time import instant
from emberlog.schema import BUCKET_SECONDS, GROUP_COLUMNS, LEVELS, MAX_LIMIT


def _parsed(value: Any, message: str) -> datetime:
    try:
        return instant(value)
    except (ValueError, TypeError, AttributeError):
        raise ValueError(message) from None


def check_range(since: Any = None, until: Any = None) -> None:
    low = None if since is None else _parsed(since, "invalid since timestamp")
    high = None if until is None else _parsed(until, "invalid until timestamp")
    if low is not None and high is not None and high < low:
        raise ValueError("until must not be before since")


def check_level(level: Any = None) -> None:
    if level is not None and level not in LEVELS:
        raise ValueError("unknown level")


def check_limit(limit: Any) -> None:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise ValueError("limit must be a positive integer")
    if limit > MAX_LIMIT:
        raise ValueError(f"limit must not exceed {MAX_LIMIT}")


def check_text_filters(service: Any = None, q: Any = None, attr: Any = None) -> None:
    if service is not None and not isinstance(service, str):
        raise ValueError("service must be a single string value")
    if q is not None and not isinstance(q, str):
        raise ValueError("q must be a single string value")
    if attr is not None and not (
        isinstance(attr, Mapping) and all(isinstance(value, str) for value in attr.values())
    ):
        raise ValueError("attr.<key> filters must each be a single string value")


def check_search(
    *, service=None, level=None, since=None, until=None, q=None, attr=None, limit=None, cursor=None
) -> None:
    check_range(since, until)
    check_level(level)
    if limit is not None:
        check_limit(limit)
    if cursor is not None:
        decode_cursor(cursor)
    check_text_filters(service, q, attr)


def check_aggregate(
    *,
    bucket,
    since=None,
    until=None,
    group_by=None,
    service=None,
    level=None,
    q=None,
    attr=None,
) -> None:
    if not isinstance(bucket, str) or bucket not in BUCKET_SECONDS:
        raise ValueError("invalid bucket size")
    if not since or not until:
        raise ValueError("for logs/aggregate, since & until timestamps are required")
    check_range(since, until)
    check_level(level)
    if group_by is not None and group_by not in GROUP_COLUMNS:
        raise ValueError("group_by must be 'service' or 'level'")
    check_text_filters(service, q, attr)
