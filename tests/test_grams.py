"""The summary of messages: same rows, fewer batches read, never in the way of new rows."""

from __future__ import annotations

from datetime import UTC, date, datetime

from hypothesis import given
from hypothesis import strategies as st

from emberlog.functions.predicates import by_message
from emberlog.operators import search
from emberlog.sources import grams
from emberlog.sources.compaction import compact_day

DAY = date(2026, 7, 21)
MESSAGES = {
    "one": ["Disk full on node 7", "ab", "", "100% done"],
    "two": ["timetable changed", "Ünïcode façade", "a_b c"],
    "three": ["disk ok", "under_score", "back\\slash"],
}
SEARCHES = ("disk full", "DISK", "d_sk", "di%full", "xyz", "ab", "", "100\\%", "0% d", "ünïc", "r\\_s", "k\\\\s", "%", "tab%ged")


def loaded(store, logs):
    for hour, (name, texts) in enumerate(MESSAGES.items()):
        rows = [(f"2026-07-2{k % 2} {hour:02d}:00:0{k}", "info", "a", text) for k, text in enumerate(texts)]
        store.load_batch(logs(rows), name)
    return store


def found(store, q, **how):
    return sorted(r.message for r in store.scan_logs(**how).filter(by_message(q)).collect())


def batches(rows):
    return {f.split("batch_id=")[1].split("/")[0] for f in rows.inputFiles() if "/logs/" in f}


def test_same_rows_from_fewer_batches(store, logs):
    loaded(store, logs)
    expected = {q: found(store, q) for q in SEARCHES}
    assert {q: found(store, q, may_hold=q) for q in SEARCHES} == expected  # no summary yet
    assert grams.refresh(store) == 6 and grams.refresh(store) == 0
    assert {q: found(store, q, may_hold=q) for q in SEARCHES} == expected
    assert batches(store.scan_logs(may_hold="disk full")) == {"one"}
    assert batches(store.scan_logs(may_hold="DISK")) == {"one", "three"}
    assert batches(store.scan_logs(may_hold="xyz")) == set()
    assert batches(store.scan_logs(may_hold="d_k")) == set(MESSAGES)
    page = search.search_store(store, q="tab%ged", limit=10)
    assert [r.message for r in page.collect()] == ["timetable changed"]
    since, until = datetime(2026, 7, 21, tzinfo=UTC), datetime(2026, 7, 22, tzinfo=UTC)
    inside = store.scan_logs(since, until, may_hold="back").filter(by_message("back")).count()
    assert inside == store.scan_logs(since, until).filter(by_message("back")).count()


def test_new_and_repeated_batches_are_read(store, logs):
    loaded(store, logs)
    grams.refresh(store)
    store.load_batch(logs([("2026-07-20 05:00:00", "info", "a", "xyz late")]), "four")
    store.load_batch(logs([("2026-07-20 06:00:00", "info", "a", "xyz again")]), "one")
    store.load_rows(
        logs([("2026-07-20 07:00:00", "info", "a", "xyz moved")]).selectExpr("*", "'stray-1' as batch_id")
    )
    expected = ["xyz again", "xyz late", "xyz moved"]
    assert found(store, "xyz", may_hold="xyz") == expected
    assert grams.refresh(store, date(2026, 7, 20)) == 0
    assert grams.refresh(store) == 2  # rows moved in later stay without a summary
    assert found(store, "xyz", may_hold="xyz") == expected
    assert batches(store.scan_logs(may_hold="xyz")) == {"one", "four", "stray-1"}


def test_packed_and_dropped_days(store, logs):
    loaded(store, logs)
    grams.refresh(store)
    compact_day(store, DAY)
    for _ in range(2):
        assert found(store, "ünïc", may_hold="ünïc") == ["Ünïcode façade"]
        grams.refresh(store)
    store.drop_day(store.logs_path, DAY)
    grams.refresh(store)
    assert found(store, "timetable", may_hold="timetable") == ["timetable changed"]
    assert found(store, "ünïc", may_hold="ünïc") == []


@given(st.text(alphabet="ab%_\\", max_size=12))
def test_every_match_holds_the_grams(q):
    """A text made by filling the wildcards holds every gram."""
    text, escaped = "", False
    for char in q:
        if escaped or char not in "%_\\":
            text, escaped = text + char, False
        elif char == "\\":
            escaped = True
        else:
            text += "z"
    if not escaped:
        assert all(gram in text for gram in grams.pattern_grams(q))
