from __future__ import annotations

import base64
import json

import pytest

from emberlog.functions.arguments import check_aggregate, check_search
from emberlog.functions.cursors import decode_cursor
from emberlog.functions.text import contains_pattern
from emberlog.functions.time import ceil_to, floor_to, instant, millis

RANGE = dict(since="2026-07-20T00:00:00Z", until="2026-07-21T00:00:00Z")


def token(body) -> str:
    return base64.b64encode(json.dumps(body).encode()).decode()


@pytest.mark.parametrize(
    ("options", "message"),
    [
        (dict(since="nope"), "invalid since timestamp"),
        (dict(until="nope"), "invalid until timestamp"),
        (dict(since="2026-07-21", until="2026-07-20"), "until must not be before since"),
        (dict(level="critical"), "unknown level"),
        (dict(level=""), "unknown level"),
        (dict(limit=0), "limit must be a positive integer"),
        (dict(limit=1.5), "limit must be a positive integer"),
        (dict(limit=True), "limit must be a positive integer"),
        (dict(limit=1001), "limit must not exceed 1000"),
        (dict(cursor="!!"), "invalid or malformed cursor"),
        (dict(cursor=token({"id": "", "timestamp": "2026-07-20"})), "invalid or malformed cursor"),
        (dict(cursor=token({"id": "a", "timestamp": "x"})), "invalid or malformed cursor"),
        (dict(cursor=token([1])), "invalid or malformed cursor"),
        (dict(service=["a", "b"]), "service must be a single string value"),
        (dict(q=3), "q must be a single string value"),
        (dict(attr={"a": ["1", "2"]}), "attr.<key> filters must each be a single string value"),
        (dict(attr="x"), "attr.<key> filters must each be a single string value"),
    ],
)
def test_search_arguments(options, message):
    with pytest.raises(ValueError) as error:
        check_search(**options)
    assert str(error.value) == message


def test_good_search_arguments():
    check_search(**RANGE, service="a", level="info", q="x", attr={"a": ""}, limit=1000)
    check_search(since="2026-07-20", until="2026-07-20")


@pytest.mark.parametrize(
    ("options", "message"),
    [
        (dict(bucket="2h"), "invalid bucket size"),
        (dict(bucket=None, since="x"), "invalid bucket size"),
        (
            dict(bucket="1h", since="2026-07-20"),
            "for logs/aggregate, since & until timestamps are required",
        ),
        (dict(bucket="1h", since="x", until="y"), "invalid since timestamp"),
        (dict(bucket="1h", level="no", **RANGE), "unknown level"),
        (dict(bucket="1h", group_by="id", **RANGE), "group_by must be 'service' or 'level'"),
        (dict(bucket="1h", q=1, **RANGE), "q must be a single string value"),
    ],
)
def test_aggregate_arguments(options, message):
    with pytest.raises(ValueError) as error:
        check_aggregate(**options)
    assert str(error.value) == message


def test_cursor_round_trip():
    body = {"timestamp": "2026-07-20T14:32:01.123Z", "id": "abc"}
    assert decode_cursor(token(body)) == (instant("2026-07-20T14:32:01.123Z"), "abc")


def test_message_pattern_keeps_wildcards_and_drops_plain_backslashes():
    assert contains_pattern("Payment") == "%payment%"
    assert contains_pattern("50%_x") == "%50%_x%"
    assert contains_pattern(r"a\b") == "%ab%"
    assert contains_pattern("abc\\") == r"%abc\%"
    assert contains_pattern(r"100\%") == r"%100\%%"
    assert contains_pattern("a\\\\b") == "%a\\\\b%"


def test_instants_are_utc_milliseconds():
    assert millis("1970-01-01T00:00:00.0019") == 1
    assert millis("1970-01-01T01:00:00+01:00") == 0
    half = instant("2026-07-20T14:30:30")
    assert floor_to(half, 3600) == instant("2026-07-20T14:00:00")
    assert ceil_to(half, 60) == instant("2026-07-20T14:31:00")
    assert ceil_to(floor_to(half, 60), 60) == floor_to(half, 60)
