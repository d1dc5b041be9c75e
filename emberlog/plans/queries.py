"""Every operator as a query over the test tables; keys match ``oracle.ORACLE``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import variants
from emberlog.functions.predicates import all_filters, by_message
from emberlog.functions.time import instant, is_stale, iso_text, time_bucket
from emberlog.operators import aggregate as agg
from emberlog.operators import dead_letters as dead
from emberlog.operators import quality, retention, search, series, stats, validation
from emberlog.operators.backfill import backfill
from emberlog.plans import tables
from emberlog.plans.tables import AS_OF, RETENTION_DAYS
from emberlog.schema import DEAD_LETTER_LIMIT
from emberlog.session import configure, scratch
from emberlog.sources import envelopes as env
from emberlog.sources import folders, grams
from emberlog.sources.compaction import compact_days, remove_replaced
from emberlog.sources.store import GRAINS, LogStore
from emberlog.streaming import ingest, live, tail

Query = Callable[[SparkSession, str], DataFrame]

#: A range cutting buckets of every size, and one of whole days.
SINCE, UNTIL = datetime(2024, 1, 5, 7, 13, 20), datetime(2024, 1, 24, 18, 47, 5)
FIRST, LAST = datetime(2024, 1, 1), datetime(2024, 2, 1)
NOON = datetime(2024, 1, 15, 12, 0, 30)
LIVE_NOW = datetime(2024, 1, 30, 23, 59, 30)

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def named(name: str, run: Query) -> None:
    QUERIES[name] = run


def log_rows(logs: DataFrame) -> DataFrame:
    """Logs with text timestamps and unpacked attributes, as both engines print them."""
    return logs.select(
        "id",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        *[F.col("attributes")[key].alias(key) for key in ("user_id", "region", "retries", "k")],
    )


def bucket_rows(buckets: DataFrame) -> DataFrame:
    return buckets.select(iso_text(F.col("start")).alias("start"), "group", "count")


def rollup_rows(counts: DataFrame) -> DataFrame:
    return counts.select(iso_text(F.col("bucket")).alias("bucket"), "service", "level", "count")


def names(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(value,) for value in values], "name STRING")


def contents(store: LogStore) -> DataFrame:
    """(rows, hour_count, minute_count) of a store; the three agree unless it drifted."""
    parts = [
        store.scan_logs().select(F.lit("rows").alias("part"), F.lit(1).alias("n")),
        store.scan_partials("hour").select(F.lit("hour_count"), "count"),
        store.scan_partials("minute").select(F.lit("minute_count"), "count"),
    ]
    both = parts[0].union(parts[1]).union(parts[2])
    return both.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("part") == name, F.col("n"))), F.lit(0)).alias(name)
            for name in ("rows", "hour_count", "minute_count")
        ]
    )


def with_ids(store: LogStore) -> DataFrame:
    """``contents`` and the number of distinct ids."""
    ids = store.scan_logs().agg(F.count_distinct("id").alias("ids"))
    return contents(store).withColumn("ids", ids.scalar())


# -- sources -----------------------------------------------------------------


def entry_rows(entries: DataFrame) -> DataFrame:
    entry = F.col("entry")
    field = {
        name: F.try_variant_get(entry, f"$.{name}", "string")
        for name in ("timestamp", "level", "service", "message")
    }
    attribute = F.try_variant_get(entry, "$.attributes", "map<string,variant>")
    kind = F.regexp_extract(variants.kind(entry), "^[A-Z]+", 0)
    return entries.select(
        "index",
        kind.alias("kind"),
        *[value.alias(name) for name, value in field.items()],
        F.size(attribute).cast("bigint").alias("n_attributes"),
    )


@query
def s1_read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_bodies(tables.envelopes(spark, sf_dir), scratch(spark, "bodies"))
    return entry_rows(env.read_batches(spark, path))


@query
def s1_refused_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = tables.envelopes(spark, sf_dir).unionByName(tables.odd_envelopes(spark, sf_dir))
    path = tables.write_bodies(bodies, scratch(spark, "bodies"))
    refused = env.refused_envelopes(env.read_envelopes(spark, path))
    return refused.groupBy("error").agg(F.count("*").alias("count"))


@query
def s2_scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(tables.main_store(spark, sf_dir).scan_logs(SINCE, UNTIL))


@query
def s3_scan_rollup_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_rows(tables.main_store(spark, sf_dir).scan_rollup("hour", SINCE, UNTIL))


@query
def s3_scan_rollup_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_rows(tables.main_store(spark, sf_dir).scan_rollup("minute", SINCE, UNTIL))


@query
def s4_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_bodies(tables.envelopes(spark, sf_dir), scratch(spark, "bodies"))
    out = scratch(spark, "streamed")
    stream = env.stream_batches(spark, path, max_files_per_trigger=2)
    (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    bodies = spark.read.parquet(out)
    return entry_rows(env.entries_of(env.explode_envelopes(env.name_envelopes(bodies))))


# -- validation --------------------------------------------------------------


def validated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    entries = tables.raw_entries(spark, sf_dir)
    return validation.validate_entries(entries, AS_OF, retention_days=RETENTION_DAYS, **options)


def validated_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = tables.envelopes(spark, sf_dir).unionByName(tables.odd_envelopes(spark, sf_dir))
    return validation.validate_entries(
        env.explode_envelopes(bodies), AS_OF, retention_days=RETENTION_DAYS
    )


@query
def v1_validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("event_id", "reason")


@query
def v1_validate_allow_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, allow_stale=True).select("event_id", "reason")


@query
def v2_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = validation.split_batch(validated(spark, sf_dir))
    return accepted.select(
        "envelope",
        "index",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
    )


@query
def v2_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.split_batch(validated(spark, sf_dir))[1]


@query
def v3_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validation.batch_report(validated_envelopes(spark, sf_dir))
    return report.withColumn("status", F.col("status").cast("bigint"))


@query
def v4_normalize_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = validation.split_batch(validated(spark, sf_dir))
    keys = ("user_id", "region", "retries", "k", "f", "b")
    return accepted.select(
        "event_id",
        F.size("attributes").cast("bigint").alias("n_keys"),
        *[F.col("attributes")[key].alias(key) for key in keys],
    )


@query
def v5_stale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = tables.event_logs(spark, sf_dir)
    return logs.select("id", is_stale(F.col("timestamp"), NOON, 7).alias("stale"))


def backfill_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = tables.raw_entries(spark, sf_dir)
    return validation.backfill_plan(entries, AS_OF, RETENTION_DAYS)[2]


@query
def v6_backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validation.backfill_report(backfill_outcome(spark, sf_dir))
    return report.withColumn("status", F.col("status").cast("bigint"))


@query
def v6_backfill_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = validation.backfill_dates(backfill_outcome(spark, sf_dir))
    return dates.select(F.col("dt").cast("string").alias("dt"))


@query
def v6_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.new_store(spark, "backfill")
    backfill(store, tables.raw_entries(spark, sf_dir), "history", AS_OF, RETENTION_DAYS)
    return with_ids(store)


@query
def v6_backfill_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.new_store(spark, "backfill")
    entries = tables.raw_entries(spark, sf_dir)
    done = backfill(store, entries, "history", AS_OF, RETENTION_DAYS)
    return done.rejected_rows.select("envelope", "index", "reason")


@query
def v7_derive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = validation.split_batch(validated(spark, sf_dir))
    derived = validation.derive_columns(accepted)
    return derived.select(
        "id",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "message_lower",
        F.col("dt").cast("string").alias("dt"),
    )


# -- sinks, rollup upkeep, dead letters ---------------------------------------


@query
def w1_append_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, logs = tables.new_store(spark, "append"), tables.event_logs(spark, sf_dir)
    for half in (0, 1, 1):
        store.append_logs(logs.filter(F.pmod("event_id", F.lit(2)) == half), f"half-{half}")
    return log_rows(store.scan_logs())


@query
def w2_rollup_increment_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_rows(tables.main_store(spark, sf_dir).scan_rollup("hour"))


@query
def w3_rollup_increment_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_rows(tables.main_store(spark, sf_dir).scan_rollup("minute"))


@query
def w3_rollup_increment_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_rows(tables.main_store(spark, sf_dir).scan_rollup("day"))


@query
def w4_rollup_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, logs = tables.new_store(spark, "rebuild"), tables.event_logs(spark, sf_dir)
    store.append_logs(logs, "all")
    store.add_counts(logs, "hour", "counted-twice")
    out = []
    for grain in ("hour", "minute"):
        for _ in range(2):
            store.rebuild_rollup(grain)
        out.append(rollup_rows(store.scan_rollup(grain)).withColumn("grain", F.lit(grain)))
    return out[0].unionByName(out[1])


@query
def w5_dead_letter_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.new_store(spark, "dead")
    entries = tables.event_logs(spark, sf_dir).withColumn(
        "timestamp_text", iso_text(F.col("timestamp"))
    )
    for _ in range(2):
        dead.dead_letter_write(store, entries, "simulated failure", AS_OF, "dead-1")
    dead.dead_letter_write(store, entries.filter("false"), "nothing to keep", AS_OF, "dead-2")
    rows = store.scan_dead()
    return rows.groupBy("dead_id", "reason", "level", "service").agg(F.count("*").alias("count"))


def dead_store(spark: SparkSession, sf_dir: str) -> LogStore:
    store = tables.new_store(spark, "dead")
    dead.write_dead(store, tables.dead_rows(spark, sf_dir))
    return store


@query
def w6_dead_letter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the queue."""
    pages = dead.dead_letter_pages(dead_store(spark, sf_dir), DEAD_LETTER_LIMIT)
    return pages.drop("page").withColumn("failed_at", iso_text(F.col("failed_at")))


@query
def w6_dead_letter_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dead.dead_letter_entries(dead_store(spark, sf_dir), limit=None)
    return entries.select("id", "entry_id", "timestamp", "level", "service", "message")


@query
def w7_dead_letter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = dead_store(spark, sf_dir)
    done = dead.dead_letter_replay(store)
    waiting = dead.waiting(store)
    return with_ids(store).select(
        F.lit(done.replayed).cast("bigint").alias("replayed"),
        F.lit(done.still_failed).cast("bigint").alias("still_failed"),
        F.lit(waiting).cast("bigint").alias("waiting"),
        "rows",
        "hour_count",
        "minute_count",
        "ids",
    )


@query
def w8_flush_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.new_store(spark, "flush")
    accepted, _ = validation.split_batch(validated(spark, sf_dir))
    for name in ("first", "second", "second"):
        ingest.flush_batch(store, accepted, name, AS_OF)
    return with_ids(store)


@query
def w9_compact_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day packed, new batches and one that is packed already, every day packed again, one
    more batch, and what was replaced removed."""
    store = tables.new_store(spark, "compact")
    logs = tables.event_logs(spark, sf_dir)
    part = F.pmod("event_id", F.lit(6))
    for number in (0, 1, 2):
        store.load_batch(logs.filter(part == number), f"part-{number}")
    days = store.days()
    compact_days(store, days)
    for number in (3, 4, 1):  # the last of these is packed already
        store.load_batch(logs.filter(part == number), f"part-{number}")
    compact_days(store, days)
    store.load_batch(logs.filter(part == 5), "part-5")
    for day in days:
        remove_replaced(store, day)
    rows = log_rows(store.scan_logs())
    hours = rollup_rows(store.scan_rollup("hour"))
    nothing = F.lit(None).cast("string")
    return rows.select("id", "timestamp", "level", "service", nothing.alias("grain"), F.lit(1).alias("count")).union(
        hours.select(nothing, "bucket", "level", "service", F.lit("hour"), "count")
    )


# -- filters -------------------------------------------------------------------

FILTERS = {
    "f1_by_service": dict(service="signals"),
    "f2_by_level": dict(level="error"),
    "f3_by_time": dict(since=SINCE, until=UNTIL),
    "f4_by_message": dict(q="Si%Ced"),
    "f5_by_attribute": dict(attr={"region": "valley", "retries": "3"}),
    "f6_all_filters": dict(
        service="platforms",
        level="info",
        since=SINCE,
        until=UNTIL,
        q="re",
        attr={"retries": "2"},
    ),
    "f6_no_filters": dict(service="", q=""),
}


def _filter(options: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return log_rows(all_filters(tables.main_store(spark, sf_dir).scan_logs(), **options))

    return run


for _name, _options in FILTERS.items():
    named(_name, _filter(_options))


@query
def f4_by_message_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_filters(tables.document_logs(spark, sf_dir), q="The_")
    return found.select("id", "service", "level", F.length("message").alias("n_chars"))


@query
def f4_by_message_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_filters(tables.conversation_logs(spark, sf_dir), q="QUE ")
    return found.select("id", "service", F.length("message").alias("n_chars"))


@query
def f4_by_message_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches over the batches that the summary of messages leaves."""
    store = tables.fill_store(tables.new_store(spark, "grams"), tables.event_logs(spark, sf_dir))
    grams.refresh(store)
    found = [
        log_rows(store.scan_logs(may_hold=q).filter(by_message(q))).withColumn("q", F.lit(q))
        for q in ("timetable", "Si%Ced", "c_")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def f7_project_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(search.project_log(tables.main_store(spark, sf_dir).scan_logs()))


# -- search --------------------------------------------------------------------


@query
def q1_search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(search.search_store(tables.main_store(spark, sf_dir)))


@query
def q1_search_service_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.main_store(spark, sf_dir)
    return log_rows(
        search.search_store(
            store, service="switches", level="error", since=SINCE, until=UNTIL, limit=40
        )
    )


@query
def q1_search_message_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.main_store(spark, sf_dir)
    return log_rows(
        search.search_store(store, q="sensor", attr={"region": "coast"}, until=UNTIL, limit=50)
    )


@query
def q1_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = tables.document_logs(spark, sf_dir)
    page = search.search_logs(logs, q="ation", level="warn", limit=25)
    return page.select("id", iso_text(F.col("timestamp")).alias("timestamp"), "service")


PAGE = 60


@query
def q2_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, reached by following cursors; empty where the rows end before it."""
    store = tables.main_store(spark, sf_dir)
    pages = search.pages(store, service="timetable", limit=PAGE)
    third = next(islice(pages, 2, None), None)
    return log_rows(search.no_rows(store) if third is None else third)


@query
def q2_walk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of one service in a range, page after page to the end, with its page number."""
    store = tables.main_store(spark, sf_dir)
    keys = dict(service="signals", level="error", since=SINCE, until=UNTIL)
    walked = [
        log_rows(page).withColumn("page", F.lit(number))
        for number, page in enumerate(search.pages(store, **keys, limit=1000))
    ]
    return reduce(DataFrame.unionByName, walked)


@query
def q3_next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.search_store(tables.main_store(spark, sf_dir), level="warn", limit=PAGE)
    found = search.next_cursor(page, PAGE)
    return found.select(iso_text(F.col("timestamp")).alias("timestamp"), "id", "cursor")


@query
def q4_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.main_store(spark, sf_dir)
    return bucket_rows(search.first_rows(agg.aggregate(store, SINCE, UNTIL, "1h", "service")))


# -- aggregates ------------------------------------------------------------------


@query
def a1_time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = tables.event_logs(spark, sf_dir)
    starts = {"1m": "minute", "5m": "five_minutes", "1h": "hour", "1d": "day"}
    return logs.select(
        "id",
        *[
            iso_text(time_bucket(F.col("timestamp"), bucket)).alias(name)
            for bucket, name in starts.items()
        ],
    )


RAW_COUNTS = {
    "a2_bucket_counts_1m": dict(bucket="1m"),
    "a2_bucket_counts_5m": dict(bucket="5m", service="ticketing"),
    "a2_bucket_counts_1h": dict(bucket="1h", q="closed"),
    "a2_bucket_counts_1d": dict(bucket="1d", attr={"region": "summit"}),
    "a3_bucket_counts_by_service": dict(bucket="1h", group_by="service"),
    "a3_bucket_counts_by_level": dict(bucket="5m", group_by="level", q="stale"),
}

ROLLUP_COUNTS = {
    "a4_hourly_rollup_1h": ("hour", dict(bucket="1h", group_by="service")),
    "a4_hourly_rollup_1h_level": ("hour", dict(bucket="1h", level="error")),
    "a5_hourly_rollup_1d": ("hour", dict(bucket="1d", group_by="level")),
    "a6_minute_rollup_1m": ("minute", dict(bucket="1m", service="switches", group_by="level")),
    "a7_minute_rollup_5m": ("minute", dict(bucket="5m", group_by="service")),
}

ROUTED_COUNTS = {
    "a8_aggregate_1m": dict(bucket="1m", group_by="level"),
    "a8_aggregate_5m": dict(bucket="5m", service="power"),
    "a8_aggregate_1h": dict(bucket="1h", group_by="service"),
    "a8_aggregate_1d": dict(bucket="1d", level="warn"),
    "a8_aggregate_1d_by_service": dict(bucket="1d", group_by="service"),
    "a8_aggregate_message": dict(bucket="1d", group_by="service", q="sensor_"),
    "a8_aggregate_attribute": dict(bucket="1h", attr={"retries": "4"}),
}


def _raw(options: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = tables.main_store(spark, sf_dir).scan_logs(SINCE, UNTIL)
        return bucket_rows(agg.bucket_counts(logs, SINCE, UNTIL, **options))

    return run


def _rolled(grain: str, options: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        partials = tables.main_store(spark, sf_dir).scan_partials(grain, SINCE, UNTIL)
        return bucket_rows(agg.rollup_counts(partials, SINCE, UNTIL, **options))

    return run


def _routed(options: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bucket_rows(
            agg.aggregate(tables.main_store(spark, sf_dir), SINCE, UNTIL, **options)
        )

    return run


for _name, _options in RAW_COUNTS.items():
    named(_name, _raw(_options))
for _name, (_grain, _options) in ROLLUP_COUNTS.items():
    named(_name, _rolled(_grain, _options))
for _name, _options in ROUTED_COUNTS.items():
    named(_name, _routed(_options))


@query
def a9_live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = tables.main_store(spark, sf_dir).scan_logs()
    found = agg.live_window(
        logs, LIVE_NOW, LIVE_NOW - timedelta(minutes=13), LIVE_NOW, group_by="service"
    )
    return bucket_rows(found)


def live_table(spark: SparkSession, sf_dir: str) -> live.LiveTable:
    """A live table begun late: everything was committed before its stream started."""
    store, path = tables.main_store(spark, sf_dir), scratch(spark, "live")
    live.live_counts_stream(
        tail.committed_entries(store), path, scratch(spark, "checkpoint"), clock=lambda: LIVE_NOW
    ).awaitTermination()
    return live.LiveTable(store, path)


LIVE_SINCE, LIVE_UNTIL = datetime(2024, 1, 30, 23, 46), datetime(2024, 1, 30, 23, 59)


@query
def a8_aggregate_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = live_table(spark, sf_dir)
    assert table.covers(LIVE_SINCE, LIVE_UNTIL)
    return bucket_rows(
        agg.aggregate(
            table.store, LIVE_SINCE, LIVE_UNTIL, "1m", "service", as_of=LIVE_NOW, live=table
        )
    )


@query
def a9_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.live_counts(
        live_table(spark, sf_dir).counts(), LIVE_NOW, LIVE_NOW - timedelta(minutes=13), LIVE_NOW,
        group_by="service",
    )
    return bucket_rows(found)


# -- statistics --------------------------------------------------------------------


@query
def t1_count_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_level(tables.main_store(spark, sf_dir).scan_logs())


@query
def t2_count_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_service(tables.main_store(spark, sf_dir).scan_logs())


@query
def t3_total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.total_rows(tables.main_store(spark, sf_dir).scan_logs())


@query
def t4_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.time_range(tables.main_store(spark, sf_dir).scan_logs())
    return found.select(*[iso_text(F.col(c)).alias(c) for c in ("oldest", "newest")])


@query
def t5_ingestion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ingestion_rate(tables.main_store(spark, sf_dir).scan_logs(), NOON)


@query
def t6_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stats.partition_stats(tables.main_store(spark, sf_dir))
    bounds = [F.col(c).cast("string").alias(c) for c in ("from", "to")]
    return parts.select("name", *bounds, "rows", (F.col("bytes") > 0).alias("has_bytes"))


@query
def t7_store_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal to the sum over the partitions and to the sizes in the listing?"""
    store = tables.main_store(spark, sf_dir)
    listed = folders.size(spark, store.logs_path, ".parquet")
    parts = stats.partition_stats(store).agg(F.sum("bytes").alias("parts"))
    same = (F.col("bytes") == parts.scalar()) & (F.col("bytes") == F.lit(listed))
    return stats.store_bytes(store).select(same.alias("agrees"))


@query
def t8_store_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.main_store(spark, sf_dir)
    report = stats.store_report(store, NOON, retention_days=RETENTION_DAYS)
    sized = F.col("section").isin("partitions", "store")
    return report.select(
        "section",
        "name",
        F.when(F.col("section") == "store", F.lit(None)).otherwise(F.col("rows")).alias("rows"),
        F.when(~sized, F.col("text")).alias("text"),
    )


# -- retention and repair -------------------------------------------------------------

CUT = datetime(2024, 1, 30, 9, 30)


def whole_store(spark: SparkSession, sf_dir: str, name: str) -> LogStore:
    store = tables.new_store(spark, name)
    store.load_batch(tables.event_logs(spark, sf_dir), "all")
    return store


def split_store(spark: SparkSession, sf_dir: str, name: str) -> LogStore:
    """Two of a hundred rows are parked, the others loaded."""
    store, logs = tables.new_store(spark, name), tables.event_logs(spark, sf_dir)
    parked = F.pmod("event_id", F.lit(50)) == 0
    store.load_batch(logs.filter(~parked), "all")
    store.park_stray(logs.filter(parked), "late")
    return store


@query
def r1_drop_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = whole_store(spark, sf_dir, "drop")
    dropped = names(spark, retention.drop_expired(store, CUT, RETENTION_DAYS))
    left = stats.partition_stats(store).select("name", "rows")
    return left.withColumn("dropped", F.lit(False)).unionByName(
        dropped.select("name", F.lit(None).cast("bigint").alias("rows"), F.lit(True).alias("dropped"))
    )


@query
def r2_prune_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = whole_store(spark, sf_dir, "prune")
    retention.prune_rollups(store, CUT, RETENTION_DAYS)
    out = [
        rollup_rows(store.scan_rollup(grain)).withColumn("grain", F.lit(grain))
        for grain in ("hour", "minute")
    ]
    return out[0].unionByName(out[1])


@query
def r3_stray_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = split_store(spark, sf_dir, "stray")
    days = retention.stray_days(store.scan_stray())
    return days.select(F.col("day").cast("string").alias("day"))


@query
def r4_backfill_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = split_store(spark, sf_dir, "day")
    moved = [retention.backfill_day(store, date(2024, 1, 12)) for _ in range(2)]
    return contents(store).select(
        F.lit(moved[0]).cast("bigint").alias("moved"),
        F.lit(moved[1]).cast("bigint").alias("moved_again"),
        "rows",
        "hour_count",
        "minute_count",
    )


@query
def r5_reconcile_stray(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = split_store(spark, sf_dir, "reconcile")
    done = retention.reconcile_stray(store, CUT, RETENTION_DAYS)
    return contents(store).select(
        F.lit(done.deleted).cast("bigint").alias("deleted"),
        F.lit(",".join(done.backfilled)).alias("backfilled"),
        "rows",
        "hour_count",
        "minute_count",
    )


@query
def r6_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = split_store(spark, sf_dir, "retain")
    done = retention.retain(store, CUT, RETENTION_DAYS)
    return contents(store).select(
        F.lit(len(done.dropped)).cast("bigint").alias("dropped"),
        F.lit(done.reconciled.deleted).cast("bigint").alias("deleted"),
        F.lit(len(done.reconciled.backfilled)).cast("bigint").alias("backfilled"),
        "rows",
        "hour_count",
        "minute_count",
    )


# -- streams --------------------------------------------------------------------------


@query
def st1_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_bodies(tables.envelopes(spark, sf_dir), scratch(spark, "bodies"))
    store = tables.new_store(spark, "stream")
    ingest.ingest_stream(
        spark,
        path,
        store,
        scratch(spark, "checkpoint"),
        clock=lambda: AS_OF,
        retention_days=RETENTION_DAYS,
        max_files_per_trigger=4,
    ).awaitTermination()
    hours = rollup_rows(store.scan_rollup("hour")).withColumn("part", F.lit("hour"))
    raw = (
        store.scan_logs()
        .groupBy(time_bucket(F.col("timestamp"), "1h").alias("bucket"), "service", "level")
        .agg(F.count("*").alias("count"))
    )
    refused = store.scan_rejected().groupBy("reason").agg(F.count("*").alias("count"))
    nothing = F.lit(None).cast("string")
    return (
        hours.unionByName(rollup_rows(raw).withColumn("part", F.lit("raw")))
        .withColumn("reason", nothing)
        .unionByName(
            refused.select(
                nothing.alias("bucket"),
                nothing.alias("service"),
                nothing.alias("level"),
                "count",
                F.lit("rejected").alias("part"),
                "reason",
            )
        )
    )


def in_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of parts in time order, several files each."""
    logs = tables.event_logs(spark, sf_dir).drop("event_id")
    path = scratch(spark, "in-order")
    limits = [None, date(2024, 1, 11), date(2024, 1, 21), None]
    for low, high in zip(limits, limits[1:], strict=False):
        part = logs
        if low:
            part = part.filter(F.col("dt") >= F.lit(low))
        if high:
            part = part.filter(F.col("dt") < F.lit(high))
        # Files of one part share their time, so a trigger may mix them; parts stay in order.
        part.repartitionByRange(4, "timestamp").write.mode("append").parquet(path)
    return spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query
def st2_live_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "live")
    live.live_counts_stream(
        in_time_order(spark, sf_dir), path, scratch(spark, "checkpoint")
    ).awaitTermination()
    return rollup_rows(live.read_live(spark, path))


@query
def st2_live_counts_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream with a clock: only the minutes of the window are kept."""
    path = scratch(spark, "live")
    live.live_counts_stream(
        in_time_order(spark, sf_dir), path, scratch(spark, "checkpoint"), clock=lambda: LIVE_NOW
    ).awaitTermination()
    return rollup_rows(live.read_live(spark, path))


@query
def st2_live_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that ends with the newest event, from watermarked state."""
    path = scratch(spark, "live-state")
    live.live_state_stream(
        in_time_order(spark, sf_dir), path, scratch(spark, "checkpoint")
    ).awaitTermination()
    return rollup_rows(live.read_live_state(spark, path))


@query
def st3_live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_tail(spark, sf_dir).select(
        iso_text(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        F.col("attributes")["user_id"].alias("user_id"),
    )


def run_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tail")
    rows = tail.live_tail(
        tables.main_store(spark, sf_dir),
        service="rolling-stock",
        level="warn",
        started_at="2000-01-01",
        max_files_per_trigger=200,
    )
    (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(out)


@query
def q5_tail_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = search.tail_last(run_tail(spark, sf_dir))
    return last.select(
        iso_text(F.col("timestamp")).alias("timestamp"), "level", "service", "message"
    )


# -- derived tables and checks -----------------------------------------------------------


def counts_for(spark, sf_dir, group_by: str | None, since=SINCE, until=UNTIL, bucket="1h"):
    return agg.aggregate(tables.main_store(spark, sf_dir), since, until, bucket, group_by)


def series_rows(rows: DataFrame) -> DataFrame:
    return rows.select("group", "slot", iso_text(F.col("start")).alias("start"), "count")


def _dense(group_by: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = counts_for(spark, sf_dir, group_by)
        return series_rows(series.dense_series(counts, SINCE, UNTIL, "1h", group_by))

    return run


named("d1_dense_series", _dense(None))
named("d1_dense_series_by_level", _dense("level"))
named("d1_dense_series_by_service", _dense("service"))


@query
def d1_dense_series_many_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute slots of the whole month: more than the dashboard would show."""
    counts = counts_for(spark, sf_dir, "level", FIRST, LAST, "5m")
    return series_rows(series.dense_series(counts, FIRST, LAST, "5m", "level"))


@query
def d2_group_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.group_ranking(counts_for(spark, sf_dir, "service"))


@query
def d3_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counts_for(spark, sf_dir, "level")
    return series.peak(series.dense_series(counts, SINCE, UNTIL, "1h", "level"))


@query
def d4_share_of_max_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = tables.main_store(spark, sf_dir).scan_logs()
    return series.share_of_max(stats.count_by_level(logs), "level")


@query
def d4_share_of_max_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = tables.main_store(spark, sf_dir).scan_logs()
    return series.share_of_max(stats.count_by_service(logs), "service")


@query
def d5_default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's first view at every bucket size."""
    out = []
    for bucket in ("1m", "5m", "1h", "1d"):
        since, until = series.default_range(bucket, NOON)
        counts = counts_for(spark, sf_dir, "level", since, until, bucket)
        rows = series.dense_series(counts, since, until, bucket, "level")
        out.append(series_rows(rows).withColumn("bucket", F.lit(bucket)))
    first, *others = out
    for other in others:
        first = first.unionByName(other)
    return first


def _drift(grain: str) -> Query:
    """Drift of a store whose last batch was stored and never counted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = tables.new_store(spark, "drift")
        logs = tables.event_logs(spark, sf_dir)
        last = F.pmod("event_id", F.lit(3)) == 2
        store.load_batch(logs.filter(~last), "counted")
        store.append_logs(logs.filter(last), "uncounted")
        found = quality.rollup_drift(store.scan_logs(), store.scan_partials(grain), grain)
        return found.withColumn("bucket", iso_text(F.col("bucket")))

    return run


named("c1_rollup_drift_hour", _drift("hour"))
named("c1_rollup_drift_minute", _drift("minute"))
named("c1_rollup_drift_day", _drift("day"))


@query
def c1_no_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.main_store(spark, sf_dir)
    found = [
        quality.rollup_drift(store.scan_logs(), store.scan_partials(grain), grain)
        for grain in GRAINS
    ]
    return reduce(DataFrame.unionByName, found).agg(F.count("*").alias("differences"))


@query
def c2_run_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_of: Column = F.concat(F.lit("run-"), F.pmod("event_id", F.lit(4)).cast("string"))
    logs = tables.event_logs(spark, sf_dir)
    logs = logs.withColumn(
        "attributes", F.map_concat("attributes", F.create_map(F.lit("load_run_id"), run_of))
    )
    return quality.run_visibility(logs, "run-2", instant(SINCE), instant(UNTIL))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per service straight from the event table."""
    logs = tables.event_logs(configure(spark), sf_dir)
    return bucket_rows(agg.bucket_counts(logs, FIRST, LAST, "1h", "service"))


named("flagship", flagship)
