"""Store statistics: exact counts, time range, ingest rate and partition sizes."""

from __future__ import annotations

from datetime import UTC, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.time import day_lit, instant, iso_text, ts_lit
from emberlog.schema import DEFAULT_LOOKAHEAD_DAYS, DEFAULT_RETENTION_DAYS
from emberlog.sources.store import LogStore

PARTITION_NAME = "'logs_'yyyy_MM_dd"
STRAY_NAME = "logs_default"


def count_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("count"))


def count_by_service(logs: DataFrame) -> DataFrame:
    counts = logs.groupBy("service").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "service")


def total_rows(logs: DataFrame) -> DataFrame:
    return count_by_level(logs).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))


def time_range(logs: DataFrame) -> DataFrame:
    return logs.agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def per_second(last_minute: Column) -> Column:
    return F.round(last_minute / F.lit(60), 2)


def ingestion_rate(logs: DataFrame, as_of: str | datetime) -> DataFrame:
    """Rows of the last 1 and 5 minutes; entries slightly ahead of the clock count too."""
    now = instant(as_of)
    five = now - timedelta(minutes=5)
    recent = logs.filter(F.col("timestamp") >= ts_lit(five))
    if "dt" in logs.columns:
        recent = recent.filter(F.col("dt") >= day_lit(five))
    one = F.col("timestamp") >= ts_lit(now - timedelta(minutes=1))
    return recent.agg(
        F.count_if(one).alias("last_1m"), F.count("*").alias("last_5m")
    ).withColumn("per_second_1m", per_second(F.col("last_1m")))


def _files(rows: DataFrame, name: Column) -> DataFrame:
    """Rows and bytes per file: its size is taken once, not per row."""
    return rows.groupBy(name.alias("name"), F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )


def _sizes(store: LogStore, *groups: list[str]) -> DataFrame:
    """(name, rows, bytes) per partition, or overall where ``groups`` has an empty list.

    Counting reads no data column.
    """
    if not store.days() and not store.days(store.stray_path):
        return store.spark.createDataFrame([], "name STRING, rows BIGINT, bytes BIGINT")
    files = []
    if store.days():
        files.append(_files(store.scan_logs(), F.date_format("dt", PARTITION_NAME)))
    if store.days(store.stray_path):
        files.append(_files(store.scan_stray(), F.lit(STRAY_NAME)))
    both = files[0] if len(files) == 1 else files[0].unionByName(files[1])
    return both.groupingSets(list(groups), "name").agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")
    )


def partition_stats(store: LogStore) -> DataFrame:
    """Exact rows and bytes per day partition, and of the stray rows if there are any."""
    sizes = _sizes(store, ["name"])
    day = F.try_to_date("name", PARTITION_NAME)
    return sizes.select(
        "name", day.alias("from"), F.date_add(day, 1).alias("to"), "rows", "bytes"
    ).orderBy("name")


def store_bytes(store: LogStore) -> DataFrame:
    return _sizes(store, ["name"]).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def _folded(logs: DataFrame, as_of: str | datetime) -> DataFrame:
    """One row per (level, service), so that nothing large is expanded into totals."""
    now = instant(as_of)
    ts = F.col("timestamp")
    return logs.groupBy("level", "service").agg(
        F.count("*").alias("rows"),
        F.min(ts).alias("oldest"),
        F.max(ts).alias("newest"),
        F.count_if(ts >= ts_lit(now - timedelta(minutes=1))).alias("last_1m"),
        F.count_if(ts >= ts_lit(now - timedelta(minutes=5))).alias("last_5m"),
    )


def totals(logs: DataFrame, as_of: str | datetime) -> DataFrame:
    """T1 to T5 from one scan of rows: (section, name, rows, text)."""
    return _lines(_folded(logs, as_of))


def store_totals(store: LogStore, as_of: str | datetime) -> DataFrame:
    """``totals`` of a store, parked rows included, without a scan of its rows.

    Numbers of rows come from the daily counts.  Of the raw rows only the first and the last day
    are read, where the oldest and the newest stand, and the days of the last five minutes.
    """
    parts = [_folded(store.scan_stray(), as_of)]
    days = store.days()
    if days:
        begin, end = (datetime.combine(day, time(), UTC) for day in (days[0], days[-1] + timedelta(days=1)))
        one = timedelta(days=1)
        recent = instant(as_of) - timedelta(minutes=5)
        spans = [(begin, begin + one), (end - one, end)]
        if recent < end:
            spans.append((recent, end))
        seen = _folded(store.scan_logs_in(spans), as_of).withColumn("rows", F.lit(0).cast("bigint"))
        parts.append(seen)
    empty = F.lit(None).cast("timestamp")
    none = F.lit(0).cast("bigint")
    both = store.scan_partials("day").select(
        "level", "service", F.col("count").alias("rows"), empty.alias("oldest"), empty.alias("newest"),
        none.alias("last_1m"), none.alias("last_5m"),
    )
    for part in parts:
        both = both.unionByName(part)
    return _lines(both)


def _lines(base: DataFrame) -> DataFrame:
    """(section, name, rows, text) by level, by service and overall."""
    sets = base.groupingSets([["level"], ["service"], []], "level", "service").agg(
        F.grouping_id().alias("part"),
        F.sum("rows").alias("rows"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.sum("last_1m").alias("last_1m"),
        F.sum("last_5m").alias("last_5m"),
    )

    def line(section: str, name: Column, rows: Column, text: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            name.alias("name"),
            rows.cast("bigint").alias("rows"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    zero = F.lit(0)
    by_level, by_service = F.col("part") == 1, F.col("part") == 2
    overall = F.array(
        line("totals", F.lit("rows"), F.coalesce("rows", zero)),
        line("time_range", F.lit("oldest"), F.lit(None), iso_text(F.col("oldest"))),
        line("time_range", F.lit("newest"), F.lit(None), iso_text(F.col("newest"))),
        line("ingestion_rate", F.lit("last_1m"), F.coalesce("last_1m", zero)),
        line("ingestion_rate", F.lit("last_5m"), F.coalesce("last_5m", zero)),
        line(
            "ingestion_rate",
            F.lit("per_second_1m"),
            F.lit(None),
            F.format_string("%.2f", per_second(F.coalesce("last_1m", zero))),
        ),
    )
    lines = (
        F.when(by_level, F.array(line("by_level", F.col("level"), F.col("rows"))))
        .when(by_service, F.array(line("by_service", F.col("service"), F.col("rows"))))
        .otherwise(overall)
    )
    return sets.select(F.inline(lines))


def store_report(
    store: LogStore,
    as_of: str | datetime,
    *,
    retention_days: int = DEFAULT_RETENTION_DAYS,
    lookahead_days: int = DEFAULT_LOOKAHEAD_DAYS,
    source: str = "rollup",
) -> DataFrame:
    """Everything known about the store, as (section, name, rows, text).

    ``source="raw"`` counts the rows themselves, for a store whose daily counts are missing or in doubt.
    """
    if source not in ("rollup", "raw"):
        raise ValueError("source must be 'rollup' or 'raw'")
    whole = F.col("name").isNull()
    sizes = _sizes(store, ["name"], []).select(
        F.when(whole, F.lit("store")).otherwise(F.lit("partitions")).alias("section"),
        F.coalesce("name", F.lit("bytes")).alias("name"),
        F.when(whole, F.col("bytes")).otherwise(F.col("rows")).alias("rows"),
        F.when(~whole, F.col("bytes").cast("string")).alias("text"),
    )
    config = store.spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("retention_config").alias("section"),
                        F.lit(name).alias("name"),
                        F.lit(value).cast("bigint").alias("rows"),
                        F.lit(None).cast("string").alias("text"),
                    )
                    for name, value in (
                        ("retention_days", retention_days),
                        ("partition_lookahead_days", lookahead_days),
                    )
                ]
            )
        )
    )
    if source == "raw":
        report = totals(store.scan_logs(include_stray=True), as_of)
    else:
        report = store_totals(store, as_of)
    return report.unionByName(sizes).unionByName(config)
