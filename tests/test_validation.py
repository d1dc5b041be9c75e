from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from emberlog.operators.validation import (
    backfill_dates,
    backfill_plan,
    backfill_report,
    batch_report,
    derive_columns,
    split_batch,
    validate_entries,
)
from emberlog.sources import envelopes as env

AS_OF = datetime(2026, 7, 21, 12, 0, 0)
GOOD = {
    "timestamp": "2026-07-19T06:05:44.917Z",
    "level": "warn",
    "service": "switches",
    "message": "Points heater off",
    "attributes": {"track": "7b", "tries": 12, "frozen": True},
}


def at(delta: timedelta) -> str:
    return (AS_OF + delta).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def entry(**changes) -> str:
    body = {**GOOD, **changes}
    return json.dumps({key: value for key, value in body.items() if value is not ...})


@pytest.fixture
def check(spark):
    def run(*texts, **options):
        rows = [("e", number, text) for number, text in enumerate(texts)]
        df = spark.createDataFrame(rows, "envelope STRING, index INT, entry STRING")
        return validate_entries(df, AS_OF, **options).orderBy("index").collect()

    return run


def test_good_entry(check):
    (row,) = check(entry())
    assert row.reason is None
    assert row.attributes == {"track": "7b", "tries": "12", "frozen": "true"}
    assert (row.level, row.service, row.message) == ("warn", "switches", "Points heater off")


FUTURE = "timestamp is more than 5 minutes in the future"
OLD = "timestamp is older than the retention window (30 days)"
FLAT = "attributes must be a flat object"
SERVICE = "service should be a notNull string"
MESSAGE = "message should be a notNull string"

REASONS = [
    ('"not an object"', "entry must be an object"),
    ("null", "entry must be an object"),
    ("17", "entry must be an object"),
    ("{not json", "entry must be an object"),
    ("[1, 2]", "invalid timestamp"),
    ("{}", "invalid timestamp"),
    (entry(timestamp="not-a-date"), "invalid timestamp"),
    (entry(timestamp=1753000000000), "invalid timestamp"),
    (entry(timestamp=None), "invalid timestamp"),
    (entry(timestamp="12:30"), "invalid timestamp"),
    (entry(timestamp="2026-07-20T14:00:00 America/New_York"), "invalid timestamp"),
    (entry(timestamp=at(timedelta(minutes=5))), None),
    (entry(timestamp=at(timedelta(minutes=5, milliseconds=1))), FUTURE),
    (entry(timestamp=at(timedelta(minutes=6))), FUTURE),
    (entry(timestamp=at(timedelta(days=-30))), None),
    (entry(timestamp=at(timedelta(days=-30, milliseconds=-1))), OLD),
    (entry(timestamp=at(timedelta(days=-31)), level="critical"), OLD),
    (entry(level="critical"), "Invalid level: critical"),
    (entry(level=...), "Invalid level: undefined"),
    (entry(level=None), "Invalid level: null"),
    (entry(level=3), "Invalid level: 3"),
    (entry(level=True), "Invalid level: true"),
    (entry(level={"a": 1}), "Invalid level: [object Object]"),
    (entry(level=["info", None, 2]), "Invalid level: info,,2"),
    (entry(level="Error"), "Invalid level: Error"),
    (entry(service="   "), SERVICE),
    (entry(service="\t\n\u00a0\u2028\ufeff"), SERVICE),
    (entry(service=5), SERVICE),
    (entry(service=...), SERVICE),
    (entry(service="\u0085"), None),
    (entry(message=""), MESSAGE),
    (entry(message=None), MESSAGE),
    (entry(attributes={"a": {"b": 1}}), FLAT),
    (entry(attributes={"a": [1]}), FLAT),
    (entry(attributes={"a": None}), FLAT),
    (entry(attributes={"`x: VOID`": None}), FLAT),
    (entry(attributes=[1]), FLAT),
    (entry(attributes=[]), FLAT),
    (entry(attributes="text"), FLAT),
    (entry(attributes=7), FLAT),
    (entry(attributes=None), None),
    (entry(attributes=...), None),
    (entry(attributes={}), None),
    (entry(attributes={"a: VOID": 1, "OBJECT<": "x", "b`: VOID, c": "ARRAY<"}), None),
]


def test_first_failing_rule_wins(check):
    rows = check(*[text for text, _ in REASONS])
    assert [row.reason for row in rows] == [reason for _, reason in REASONS]


def test_missing_attributes_are_empty(check):
    assert [row.attributes for row in check(entry(attributes=None), entry(attributes=...))] == [
        {},
        {},
    ]


def test_allow_stale_only_lifts_the_age_rule(check):
    rows = check(
        entry(timestamp=at(timedelta(days=-400))),
        entry(timestamp=at(timedelta(days=1))),
        allow_stale=True,
    )
    assert [row.reason for row in rows] == [None, FUTURE]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2026-07-20", "2026-07-20 00:00:00"),
        ("2026-07", "2026-07-01 00:00:00"),
        ("2026-07-20T14:32Z", "2026-07-20 14:32:00"),
        ("2026-07-20T14:32:01", "2026-07-20 14:32:01"),
        ("2026-07-20T14:32:01.9999Z", "2026-07-20 14:32:01.999"),
        ("2026-07-20T14:32:01+05:30", "2026-07-20 09:02:01"),
        ("2026-07-20T14:32+0530", "2026-07-20 09:02:00"),
        ("2026-07-19T24:00:00Z", "2026-07-20 00:00:00"),
        ("2026-07-19T24:00Z", "2026-07-20 00:00:00"),
    ],
)
def test_iso_8601_forms(check, text, expected):
    (row,) = check(entry(timestamp=text))
    assert row.reason is None
    assert row.timestamp == datetime.fromisoformat(expected)


def test_numbers_print_like_javascript(check):
    numbers = {
        "3": "3",
        "3.0": "3",
        "-0": "0",
        "1e2": "100",
        "0.1": "0.1",
        "1.50": "1.5",
        "1e21": "1e+21",
        "1.5e-7": "1.5e-7",
        "0.000001": "0.000001",
        "0.0000001": "1e-7",
        "123456789.125": "123456789.125",
        "-123456789012": "-123456789012",
        "9007199254740993": "9007199254740992",
        "12345678901234567890": "12345678901234567000",
        "1.7976931348623157e308": "1.7976931348623157e+308",
    }
    rows = check(
        *[
            '{"timestamp":"2026-07-20T00:00:00Z","level":"info","service":"s","message":"m",'
            f'"attributes":{{"n":{text},"s":"{text}","b":true}}}}'
            for text in numbers
        ]
    )
    for row, (text, expected) in zip(rows, numbers.items(), strict=True):
        assert row.attributes == {"n": expected, "s": text, "b": "true"}, text


def test_a_repeated_key_keeps_its_last_value(check):
    (row,) = check(entry()[:-1] + ', "level": "info"}')
    assert (row.reason, row.level) == (None, "info")


def test_split_keeps_positions_and_report_counts_them(spark):
    bodies = [
        ("a", json.dumps({"logs": ["x", GOOD, {**GOOD, "level": "no"}, GOOD]})),
        ("b", json.dumps({"logs": [1]})),
        ("c", json.dumps({"logs": []})),
        ("d", json.dumps({"logs": {}})),
        ("e", "{oops"),
        ("f", "5"),
        ("g", "[]"),
        ("h", ""),
    ]
    df = spark.createDataFrame(bodies, "envelope STRING, body STRING")
    checked = validate_entries(env.explode_envelopes(df), AS_OF)
    accepted, rejected = split_batch(checked.filter("index IS NOT NULL"))
    assert accepted.count() == 2
    assert sorted((r.envelope, r["index"]) for r in rejected.collect()) == [
        ("a", 0),
        ("a", 2),
        ("b", 0),
    ]
    report = {r.envelope: r for r in batch_report(checked).collect()}
    assert {k: (r.accepted, r.n_rejected, r.status) for k, r in report.items()} == {
        "a": (2, 2, 200),
        "b": (0, 1, 400),
        **{name: (0, 0, 400) for name in "cdefgh"},
    }
    no_logs = "request body must be { logs: [...] }"
    assert [report[name].error for name in "cdefgh"] == [
        None,
        no_logs,
        "Malformed JSON",
        "Malformed JSON",
        no_logs,
        no_logs,
    ]


def test_derived_columns_do_not_change_between_runs(spark):
    rows = [("e", i, entry()) for i in range(3)]
    df = spark.createDataFrame(rows, "envelope STRING, index INT, entry STRING")
    derived = derive_columns(split_batch(validate_entries(df, AS_OF))[0])
    first, again = derived.collect(), derived.collect()
    assert first == again
    assert len({row.id for row in first}) == 3
    assert all(len(row.id) == 36 for row in first)
    assert first[0].message_lower == "points heater off"


def test_backfill_discards_what_is_beyond_retention(spark):
    rows = [
        entry(timestamp=at(timedelta(days=-45))),
        entry(timestamp=at(timedelta(days=-2))),
        entry(level="no"),
    ]
    df = spark.createDataFrame(
        [("e", i, text) for i, text in enumerate(rows)], "envelope STRING, index INT, entry STRING"
    )
    to_insert, rejected, outcome = backfill_plan(df, AS_OF, 30)
    assert to_insert.count() == 1
    assert [(r["index"], r.reason) for r in rejected.collect()] == [(2, "Invalid level: no")]
    line = backfill_report(outcome).first()
    assert (line.accepted, line.discarded, line.rejected, line.status) == (1, 1, 1, 200)
    assert [str(r.dt) for r in backfill_dates(outcome).collect()] == ["2026-07-19"]


def test_filtering_on_the_reason_does_not_copy_the_parsing(spark):
    df = spark.createDataFrame([("e", 0, entry())], "envelope STRING, index INT, entry STRING")
    accepted, _ = split_batch(validate_entries(df, AS_OF))
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert "PythonUDF" not in plan
    assert accepted.count() == 1
