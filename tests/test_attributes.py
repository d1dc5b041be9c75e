"""Attribute pairs: the same rows as the map alone, from fewer row groups."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.predicates import all_filters, by_attribute, pair_values
from emberlog.schema import LOG_COLUMNS, PAIR_COLUMNS, PAIRS_GO_ON
from emberlog.sources.compaction import compact_day
from tests.conftest import plan_text

BASE = datetime(2026, 7, 20)


def scanned(df) -> int:
    """Rows that left the file reader when ``df`` ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def filled(new_store, logs):
    """Four days of two batches; every day has users of its own."""
    store = new_store()
    rows = [
        (
            str(BASE + timedelta(days=i % 4, seconds=i)), "info", "ab"[i % 2], "x",
            {"user": str(i % 4 * 1000 + i % 50), "region": "ns"[i % 2], f"k{i % 13}": "v", **({"odd": ""} if i % 7 else {})},
        )
        for i in range(800)
    ]
    table = logs(rows)
    store.load_batch(table.filter("cast(id as int) % 3 = 0"), "one")
    store.load_batch(table.filter("cast(id as int) % 3 != 0"), "two")
    return store


PAIRS = [
    {"user": "1013"}, {"user": "1013", "region": "s"}, {"region": "n"}, {"user": "none"}, {"odd": ""},
    {"k5": "v"}, {"k5": "w"}, {"missing": "x"}, {"user": "1013", "k5": "v"},
]


@pytest.mark.parametrize("attr", PAIRS)
def test_same_rows_as_the_map(filled, attr):
    whole = filled.scan_logs()
    found = all_filters(whole, attr=attr).select(*LOG_COLUMNS[:4]).collect()
    assert sorted(found) == sorted(whole.filter(by_attribute(attr)).select(*LOG_COLUMNS[:4]).collect())


def test_row_groups_without_the_pair_are_skipped(filled):
    whole = filled.scan_logs()
    assert scanned(whole.filter(by_attribute({"user": "1013"}))) == 800
    one = all_filters(whole, attr={"user": "1013"})
    assert 0 < scanned(one) <= 200  # one day of four
    assert scanned(all_filters(whole, attr={"user": "none"})) == 0
    pushed = plan_text(one).split("PushedFilters:")[1].split("\n")[0]
    assert "EqualTo(pair_00" in pushed


def test_packed_days_keep_their_filters(new_store, logs):
    store = new_store()
    for name in ("one", "two"):
        store.load_batch(logs([(str(BASE), "info", "a", "x", {"user": name})]), name)
    compact_day(store, BASE.date())
    whole = store.scan_logs()
    assert scanned(all_filters(whole, attr={"user": "three"})) == 0
    assert all_filters(whole, attr={"user": "two"}).count() == 1


def test_rows_with_more_pairs_than_columns(spark):
    draw = random.Random(8)
    rows = [({f"k{draw.randrange(40)}": str(draw.randrange(3)) for _ in range(draw.randrange(30))},) for _ in range(400)]
    rows += [({},), (None,), ({"a": None},)]
    table = spark.createDataFrame(rows, "attributes map<string,string>")
    table = table.withColumns(pair_values(F.col("attributes")))
    assert table.filter(F.col(PAIR_COLUMNS[-1]) == PAIRS_GO_ON).count() == sum(len(a or ()) > 12 for a, in rows)
    for key in range(0, 40, 5):
        attr = {f"k{key}": "1"}
        assert all_filters(table, attr=attr).count() == table.filter(by_attribute(attr)).count()
