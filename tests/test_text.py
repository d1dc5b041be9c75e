"""Text and time expressions against plain Python on many values."""

from __future__ import annotations

import random
from datetime import UTC, datetime
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions.text import contains_pattern, number_text
from emberlog.functions.time import time_bucket
from emberlog.schema import BUCKET_SECONDS


def javascript_text(value: float) -> str:
    """Shortest digits; plain between 1e-6 and 1e21, otherwise with an exponent."""
    if value == 0:
        return "0"
    number = Decimal(repr(abs(value))).normalize()
    minus = "-" if value < 0 else ""
    _, digits, exponent = number.as_tuple()
    text = "".join(map(str, digits))
    power = len(text) + exponent - 1
    if -7 < power < 21:
        return f"{minus}{number:f}"
    mantissa = text[0] + ("." + text[1:] if text[1:] else "")
    return f"{minus}{mantissa}e{'+' if power > 0 else '-'}{abs(power)}"


def test_numbers_print_like_javascript(spark):
    rng = random.Random(7)
    values = [0.0, 1e21, 1e-6, 1e-7, 999999999999999900000.0, 0.1 + 0.2, 1e-300, 123456.789]
    for _ in range(400):
        digits = rng.randint(1, 15)
        value = rng.randint(1, 10**digits) * 10.0 ** rng.randint(-24, 24)
        values.append(float(f"{value:.{digits}g}") * rng.choice((1, -1)))
    df = spark.createDataFrame([(value,) for value in values], "v DOUBLE")
    found = df.select("v", number_text(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in found if r.t != javascript_text(r.v)] == []


def test_buckets_start_at_multiples_counted_from_2000(spark):
    rng = random.Random(11)
    origin = datetime(2000, 1, 1, tzinfo=UTC).timestamp()
    seconds = [rng.randint(-(10**9), 4 * 10**9) for _ in range(300)]
    df = spark.createDataFrame([(value,) for value in seconds], "s BIGINT")
    ts = F.timestamp_seconds("s")
    starts = [F.unix_seconds(time_bucket(ts, bucket)).alias(bucket) for bucket in BUCKET_SECONDS]
    for row in df.select("s", *starts).collect():
        for bucket, step in BUCKET_SECONDS.items():
            assert row[bucket] == origin + (row.s - origin) // step * step


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB%_\\ .", max_size=8))
def test_message_patterns_never_hold_a_stray_backslash(q):
    inner = contains_pattern(q)[1:]
    i = 0
    while i < len(inner):
        if inner[i] == "\\":
            assert inner[i + 1] in "%_\\"
            i += 1
        i += 1
