"""The test tables as logs, raw entries, envelopes, dead letters and a filled store."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.time import ISO_FORMAT, millis
from emberlog.session import configure, scratch
from emberlog.sources import folders
from emberlog.sources.store import LogStore

AS_OF = datetime(2024, 1, 31, tzinfo=UTC)
RETENTION_DAYS = 20
ENTRIES_PER_ENVELOPE = 100

# The vocabulary of the log rows made from the event table.
SERVICES = (
    "signals", "switches", "ticketing", "platforms", "rolling-stock", "power", "timetable"
)
REGIONS = ("north", "coast", "valley", "summit")
MESSAGES = (
    "train departed",
    "door sensor stuck",
    "fare gate closed",
    "axle counter reset",
    "platform display stale",
    "brake test passed",
    "signal lamp replaced",
    "timetable reloaded",
    "overhead line voltage low",
)
LEVEL_OF_EVENT = {"error": "error", "purchase": "warn", "view": "debug"}


def pick(values: tuple[str, ...], number: Column) -> Column:
    index = (F.pmod(number, F.lit(len(values))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(value) for value in values]), index)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log rows; ``event_id`` stays for splitting into batches."""
    events = read(spark, sf_dir, "events")
    number = F.col("event_id")
    level = F.lit("info")
    for event, name in LEVEL_OF_EVENT.items():
        level = F.when(F.col("event_type") == event, F.lit(name)).otherwise(level)
    text = pick(MESSAGES, number)
    return events.select(
        "event_id",
        F.lpad(number.cast("string"), 12, "0").alias("id"),
        F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp")).alias("timestamp"),
        level.alias("level"),
        pick(SERVICES, F.col("user_id")).alias("service"),
        F.when(number % 3 == 0, F.upper(text)).otherwise(text).alias("message"),
        F.create_map(
            F.lit("user_id"),
            F.col("user_id").cast("string"),
            F.lit("region"),
            pick(REGIONS, F.col("user_id")),
            F.lit("retries"),
            F.pmod(number, F.lit(5)).cast("string"),
            F.lit("k"),
            F.get_json_object("props", "$.k"),
        ).alias("attributes"),
    ).transform(stored_columns)


def stored_columns(logs: DataFrame) -> DataFrame:
    return logs.withColumn("message_lower", F.lower("message")).withColumn(
        "dt", F.to_date("timestamp")
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as logs with long messages, one a minute."""
    docs = read(spark, sf_dir, "documents")
    number = F.col("doc_id")
    return docs.select(
        number.cast("string").alias("id"),
        F.timestamp_millis(F.lit(millis("2024-01-01")) + number * 60_000).alias("timestamp"),
        pick(("debug", "info", "warn", "error"), number).alias("level"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("attributes"),
    ).transform(stored_columns)


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as logs: the role is the service, one turn a minute."""
    turns = read(spark, sf_dir, "conversations")
    minute = F.col("conv_id") * 60 + F.col("turn")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.timestamp_millis(F.lit(millis("2024-01-01")) + minute * 60_000).alias("timestamp"),
        F.lit("info").alias("level"),
        F.col("role").alias("service"),
        F.col("text").alias("message"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("attributes"),
    ).transform(stored_columns)


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, envelope, index, entry JSON): eleven of twelve have some oddity."""
    logs = event_logs(spark, sf_dir)
    number = F.col("event_id")
    kind = F.pmod(number, F.lit(12))
    ts = F.date_format("timestamp", ISO_FORMAT)
    rest = F.substring(ts, 5, 30)

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), text, F.lit('"'))

    attr = F.col("attributes")
    common = F.concat(
        F.lit('"user_id":'),
        quoted(attr["user_id"]),
        F.lit(',"region":'),
        quoted(attr["region"]),
        F.lit(',"retries":'),
        attr["retries"],
        F.lit(',"k":'),
        attr["k"],
    )
    attributes = (
        F.when(kind == 5, F.concat(F.lit("{"), common, F.lit(',"nested":{"a":1}}')))
        .when(kind == 6, F.lit('["a",1]'))
        .when(kind == 7, F.lit("null"))
        .when(kind == 8, F.concat(F.lit("{"), common, F.lit(',"f":3.0,"b":false}')))
        .otherwise(F.concat(F.lit("{"), common, F.lit("}")))
    )
    when = (
        F.when(kind == 3, F.concat(F.lit("bad"), rest))
        .when(kind == 10, F.concat(F.lit("2031"), rest))
        .otherwise(ts)
    )
    entry = F.concat(
        F.lit('{"timestamp":'),
        quoted(when),
        F.lit(',"level":'),
        quoted(F.when(kind == 2, F.concat(F.lit("x"), "level")).otherwise(F.col("level"))),
        F.lit(',"service":'),
        quoted(F.when(kind == 4, F.lit("  ")).otherwise(F.col("service"))),
        F.lit(',"message":'),
        quoted(F.when(kind == 9, F.lit("")).otherwise(F.col("message"))),
        F.lit(',"attributes":'),
        attributes,
        F.lit("}"),
    )
    per = F.lit(ENTRIES_PER_ENVELOPE)
    return logs.select(
        "event_id",
        F.floor(number / per).cast("string").alias("envelope"),
        F.pmod(number, per).cast("int").alias("index"),
        F.when(kind == 0, F.lit('"not an object"'))
        .when(kind == 1, F.lit("[1]"))
        .otherwise(entry)
        .alias("entry"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(envelope, body): 100 entries each by construction, so the lists stay short."""
    listed = (
        raw_entries(spark, sf_dir)
        .groupBy("envelope")
        .agg(F.sort_array(F.collect_list(F.struct("index", "entry"))).alias("items"))
    )
    return listed.select(
        "envelope",
        F.concat(
            F.lit('{"logs":['), F.array_join(F.col("items.entry"), ","), F.lit("]}")
        ).alias("body"),
    )


def odd_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refused or empty envelope next to each good one."""
    number = F.floor(F.col("event_id") / ENTRIES_PER_ENVELOPE)
    bodies = ('{"logs": 5}', '{"logs": [', "[]", '{"logs": []}')
    return (
        read(spark, sf_dir, "events")
        .groupBy(number.alias("number"))
        .agg(F.lit(1).alias("one"))
        .select(
            F.concat(F.lit("odd-"), F.col("number").cast("string")).alias("envelope"),
            pick(bodies, F.col("number")).alias("body"),
        )
    )


def write_bodies(bodies: DataFrame, path: str) -> str:
    """Envelopes as text files, one request body per line, in envelope order."""
    ordered = bodies.orderBy(F.expr("try_cast(envelope AS BIGINT)"), "envelope")
    ordered.select(F.col("body").alias("value")).write.text(path)
    return path


def dead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dead letter per 100 events; every third holds one entry of unknown level."""
    number = F.col("event_id")
    batch = F.floor(number / ENTRIES_PER_ENVELOPE)
    spoiled = (batch % 3 == 0) & (F.pmod(number, F.lit(ENTRIES_PER_ENVELOPE)) == 7)
    return event_logs(spark, sf_dir).select(
        "id",
        F.lit("simulated failure").alias("reason"),
        F.date_format("timestamp", ISO_FORMAT).alias("timestamp"),
        F.when(spoiled, F.lit("not-a-real-level")).otherwise(F.col("level")).alias("level"),
        "service",
        "message",
        "attributes",
        (F.lit(millis(AS_OF)) - batch * 60_000).alias("failed_ms"),
        F.format_string("dead-%08d", batch).alias("dead_id"),
    )


def new_store(spark: SparkSession, name: str) -> LogStore:
    return LogStore(configure(spark), scratch(spark, name))


def fill_store(store: LogStore, logs: DataFrame) -> LogStore:
    """Load logs in three batches, the second one twice: counts really are added up."""
    for number in (0, 1, 1, 2):
        part = logs.filter(F.pmod(F.col("event_id"), F.lit(3)) == number)
        store.load_batch(part, f"part-{number}")
    return store


_filled: dict[tuple[str, str], LogStore] = {}


def main_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """The whole event table as a store; written once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    store = _filled.get(key)
    if store is None or not folders.exists(spark, store.rollup_path("hour")):
        store = fill_store(new_store(spark, "main"), event_logs(spark, sf_dir))
        _filled[key] = store
    return store
