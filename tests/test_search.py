from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.predicates import all_filters
from emberlog.operators import search
from emberlog.operators.backfill import backfill
from emberlog.session import scratch
from emberlog.sources import envelopes as env
from tests.conftest import plan_text

BASE = datetime(2026, 7, 20, 10, 0, 0)


def ids(df) -> list[str]:
    return [row.id for row in df.collect()]


@pytest.fixture
def three(logs):
    return logs(
        [
            (str(BASE), "error", "brakes", "Oldest one", {"user": "1", "n": "3"}),
            (str(BASE + timedelta(seconds=1)), "info", "doors", "MIDDLE 100% a_b", {"user": ""}),
            (str(BASE + timedelta(seconds=2)), "warn", "brakes", "newest\\one", {}),
        ]
    )


def test_newest_first_and_limit(three):
    assert ids(search.search_logs(three)) == ["0002", "0001", "0000"]
    assert ids(search.search_logs(three, limit=1)) == ["0002"]
    assert "message_lower" not in search.search_logs(three).columns


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        (dict(service="brakes"), ["0000", "0002"]),
        (dict(service=""), ["0000", "0001", "0002"]),
        (dict(level="info"), ["0001"]),
        (dict(q="middle"), ["0001"]),
        (dict(q="ONE"), ["0000", "0002"]),
        (dict(q="100%"), ["0001"]),
        (dict(q="a_b"), ["0001"]),
        (dict(q="o_dest"), ["0000"]),
        (dict(q="a\\_b"), ["0001"]),
        (dict(q="o\\_dest"), []),
        (dict(q="\\o"), ["0000", "0002"]),
        (dict(q="t\\\\o"), ["0002"]),
        (dict(since=BASE + timedelta(seconds=1)), ["0001", "0002"]),
        (dict(until=BASE + timedelta(seconds=1)), ["0000"]),
        (dict(since=BASE, until=BASE), []),
        (dict(attr={"user": "1", "n": "3"}), ["0000"]),
        (dict(attr={"user": "1", "n": "4"}), []),
        (dict(attr={"user": ""}), ["0001"]),
        (dict(attr={"missing": "1"}), []),
    ],
)
def test_filters(three, options, expected):
    assert sorted(ids(all_filters(three, **options))) == expected


def test_paging_walks_every_row_once(logs):
    same = str(BASE)
    rows = [(same, "info", "a", f"m{i}", {}) for i in range(3)]
    rows += [(str(BASE - timedelta(minutes=i)), "info", "a", "m", {}) for i in range(1, 4)]
    table = logs(rows)
    seen, token = [], None
    for _ in range(10):
        page = search.search_logs(table, limit=2, cursor=token)
        seen += ids(page)
        found = search.next_cursor(page, 2).first()
        if found is None:
            break
        token = found.cursor
    assert seen == ids(search.search_logs(table))
    assert len(seen) == 6


def test_a_full_last_page_still_gives_a_cursor_to_an_empty_one(three):
    page = search.search_logs(three, limit=3)
    token = search.next_cursor(page, 3).first().cursor
    assert ids(search.search_logs(three, limit=3, cursor=token)) == []
    assert search.next_cursor(search.search_logs(three, limit=4), 4).first() is None


@pytest.fixture(scope="module")
def spread(new_store, logs):
    """Four days, one busy hour and many quiet ones, in two batches."""
    store = new_store()
    rows = [
        (str(BASE - timedelta(hours=5 * i)), ("info", "error")[i % 2], ("a", "b")[i % 3 == 0], "x", {"odd": str(i % 2)})
        for i in range(16)
    ]
    rows += [(str(BASE - timedelta(seconds=i)), "info", "a", "busy") for i in range(20)]
    table = logs(rows)
    store.load_batch(table.filter(F.col("message") == "x"), "one")
    store.load_batch(table.filter(F.col("message") == "busy"), "two")
    return store


@pytest.mark.parametrize("limit", [3, 25])
@pytest.mark.parametrize(
    "options",
    [
        {},
        dict(service="b"),
        dict(level="error"),
        dict(service="a", level="info", since=BASE - timedelta(hours=33, minutes=7)),
        dict(until=BASE - timedelta(hours=9, minutes=30)),
        dict(q="x"),
        dict(q="busy", until=BASE),
        dict(q="x", attr={"odd": "1"}, since=BASE - timedelta(hours=50)),
        dict(q="nowhere"),
    ],
)
def test_store_search_equals_plain_search(spread, limit, options):
    pages = []
    for run in (
        lambda **kw: search.search_store(spread, **kw),
        lambda **kw: search.search_logs(spread.scan_logs(), **kw),
    ):
        page = run(limit=limit, **options)
        found = search.next_cursor(page, limit).first()
        rest = run(limit=limit, cursor=found.cursor, **options) if found else None
        pages.append((ids(page), ids(rest) if rest else None))
    assert pages[0] == pages[1]


def test_store_search_reads_each_day_once_and_no_more_than_needed(spread, monkeypatch):
    read = []
    real = type(spread).scan_logs

    def noted(self, since=None, until=None, **options):
        read.append((since, until))
        return real(self, since, until, **options)

    monkeypatch.setattr(type(spread), "scan_logs", noted)
    search.search_store(spread, service="a", limit=5)
    assert len(read) == 1 and read[0][0].replace(tzinfo=None) == BASE - timedelta(hours=1)
    read.clear()
    search.search_store(spread, q="nowhere")
    ends = sorted((low, high) for low, high in read)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    read.clear()
    search.search_store(spread, q="busy", limit=20)
    assert len(read) <= 2


def test_a_page_is_full_even_if_the_rollup_counts_too_much(new_store, logs):
    store = new_store()
    table = logs([(str(BASE - timedelta(hours=h)), "info", "a", "m", {}) for h in (0, 5, 30)])
    store.load_batch(table, "one")
    store.add_counts(table, "hour", "again")
    assert len(ids(search.search_store(store, service="a", limit=3))) == 3


def test_limits_are_refused_not_cut(spread):
    for limit in (5000, 0, "5", True):
        with pytest.raises(ValueError, match="limit must"):
            search.search_store(spread, limit=limit)
        with pytest.raises(ValueError, match="limit must"):
            search.search_logs(spread.scan_logs(), limit=limit)
        with pytest.raises(ValueError, match="limit must"):
            search.next_cursor(spread.scan_logs(), limit)


def test_paging_walks_over_batches_with_equal_file_names(spark, new_store):
    store = new_store()
    for number in (1, 2):
        folder = scratch(spark, f"inbox-{number}")
        body = '{"logs":[{"timestamp":"2026-07-20T10:00:00Z","level":"info","service":"a","message":"m"}]}'
        spark.createDataFrame([(body,)], "value STRING").coalesce(1).write.text(folder)
        renamed = env.read_bodies(spark, folder)
        entries = env.entries_of(env.explode_envelopes(env.name_envelopes(renamed)))
        backfill(store, entries, f"batch-{number}", "2026-07-21")
    first = search.search_store(store, limit=1)
    token = search.next_cursor(first, 1).first().cursor
    second = search.search_store(store, limit=1, cursor=token)
    assert len({*ids(first), *ids(second)}) == 2


def test_plain_search_pushes_its_filters(spread):
    pushed = plan_text(search.search_logs(spread.scan_logs("2026-07-20"), level="info", q="bus"))
    assert "EqualTo(level,info)" in pushed
    assert "StringContains(message_lower,bus)" in pushed
    assert "dt" in pushed.split("PartitionFilters:")[1]
