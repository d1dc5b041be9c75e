"""Table shapes and fixed vocabularies of the log store."""

from __future__ import annotations

from pyspark.sql import types as T

# Log levels, bucket sizes and limits of the query contract.
LEVELS = ("debug", "info", "warn", "error")
BUCKET_SECONDS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}
DEFAULT_LOOKBACK = {"1m": 60, "5m": 48, "1h": 24, "1d": 14}
GROUP_COLUMNS = ("service", "level")
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
MAX_SERIES_BUCKETS = 2000
DEFAULT_RETENTION_DAYS = 30
DEFAULT_LOOKAHEAD_DAYS = 7
FUTURE_TOLERANCE_MINUTES = 5
LIVE_WINDOW_MINUTES = 15
DEAD_LETTER_LIMIT = 50
TABLE_ROWS_SHOWN = 50
TAIL_ROWS_KEPT = 120

_ATTRIBUTES = T.MapType(T.StringType(), T.StringType())

#: Every attribute of a row also stands, as a hash of key and value, in one of a few plain columns, the
#: smallest hash first.  Plain columns have Bloom filters, which a map does not, so row groups without a
#: pair can be skipped.  A row with more attributes than columns has a mark in the last one, one with
#: fewer another in the rest: a reader skips by Bloom filters only if every column asked has one.
PAIR_COLUMNS = tuple(f"pair_{i:02d}" for i in range(12))
PAIRS_GO_ON, NO_PAIR = 0, -1

#: Stored log rows. ``dt`` and ``batch_id`` are partition columns.
LOGS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("message_lower", T.StringType()),
        T.StructField("attributes", _ATTRIBUTES),
        *[T.StructField(name, T.LongType()) for name in PAIR_COLUMNS],
        T.StructField("dt", T.DateType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

#: Partial counts of one batch at one grain; the true count is their sum.
ROLLUP = T.StructType(
    [
        T.StructField("bucket", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("dt", T.DateType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

#: One entry of a dead-lettered batch. The timestamp stays text because a
#: dead entry may hold one that cannot be parsed.  ``id`` is the one the entry keeps.
DEAD_ENTRIES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", _ATTRIBUTES),
        T.StructField("failed_ms", T.LongType()),
        T.StructField("dead_id", T.StringType()),
    ]
)

#: A dead letter in the queue: its place (day of failure and write), time of failure and id.
DEAD_LETTER = T.StructType(
    [
        T.StructField("failed_ms", T.LongType()),
        T.StructField("dead_id", T.StringType()),
        T.StructField("failed_dt", T.DateType()),
        T.StructField("written", T.StringType()),
    ]
)

#: Entries as they are stored; the place is a partition.
QUEUED = T.StructType([*DEAD_ENTRIES.fields, *DEAD_LETTER.fields[2:]])

REJECTED = T.StructType(
    [
        T.StructField("envelope", T.StringType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

LIVE = T.StructType(
    [
        T.StructField("bucket", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("epoch", T.LongType()),
    ]
)

#: The batches a live table has counted.
COUNTED = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("epoch", T.LongType()),
    ]
)

LOG_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")
