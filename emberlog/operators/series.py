"""Tables derived from bucket counts: dense series, rankings, peaks, shares."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.time import instant, millis, ts_lit
from emberlog.schema import (
    BUCKET_SECONDS,
    DEFAULT_LOOKBACK,
    GROUP_COLUMNS,
    LEVELS,
    MAX_SERIES_BUCKETS,
)

ALL = "all"


def half_up(value: Column) -> Column:
    """Round half towards plus infinity (−0.5 gives 0), unlike SQL ``round``."""
    return F.floor(value + F.lit(0.5))


def slot_count(since: str | datetime, until: str | datetime, bucket: str) -> int:
    """Number of slots of a series; ValueError for less than one."""
    step = BUCKET_SECONDS[bucket] * 1000
    span = millis(until) - millis(since)
    if span < 0:
        raise ValueError("until must not be before since")
    slots = (2 * span + step) // (2 * step)
    if slots <= 0:
        raise ValueError("range must span at least one bucket")
    return slots


def check_view(since: str | datetime, until: str | datetime, bucket: str) -> int:
    """``slot_count`` of a range a dashboard may ask for; ValueError beyond 2000."""
    slots = slot_count(since, until, bucket)
    if slots > MAX_SERIES_BUCKETS:
        raise ValueError(f"range too wide for {bucket} buckets ({slots} buckets)")
    return slots


def default_range(bucket: str, as_of: str | datetime) -> tuple[datetime, datetime]:
    until = instant(as_of)
    return until - timedelta(seconds=DEFAULT_LOOKBACK[bucket] * BUCKET_SECONDS[bucket]), until


def dense_series(
    buckets: DataFrame,
    since: str | datetime,
    until: str | datetime,
    bucket: str,
    group_by: str | None = None,
) -> DataFrame:
    """(group, slot, start, count) with a row for every slot of every group.

    Slots outside the range are dropped.  All four levels appear when grouping
    by level; a service appears when it has a bucket, in range or not.  Each filled
    slot writes the empty ones up to the next one of its group, and a mark before the
    first slot those in front: nothing is gathered and no grid of groups and slots is
    joined, so a series may have any number of slots.
    """
    if group_by is not None and group_by not in GROUP_COLUMNS:
        raise ValueError("group_by must be 'service' or 'level'")
    slots = slot_count(since, until, bucket)
    step = BUCKET_SECONDS[bucket] * 1000
    zero, last = (F.lit(value).cast("bigint") for value in (0, slots - 1))
    place = half_up((F.unix_millis("start") - F.lit(millis(since))) / F.lit(step))
    name = F.col("group") if group_by else F.lit(ALL)
    counts = buckets.select(
        name.alias("group"), F.when(place.between(zero, last), place).alias("slot"), "count"
    ).filter(F.col("group").isNotNull())
    known = None if group_by == "service" else LEVELS if group_by else (ALL,)
    if known is not None:
        counts = counts.filter(F.col("group").isin(*known))
        groups = buckets.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(value) for value in known])).alias("group")
        )
    else:
        groups = counts.select("group").distinct()
    before = F.lit(-1).cast("bigint")
    marks = groups.select("group", before.alias("slot"), zero.alias("count"))
    filled = (
        counts.filter(F.col("slot").isNotNull())
        .groupBy("group", "slot")
        .agg(F.sum("count").alias("count"))
        .unionByName(marks)
    )
    in_turn = Window.partitionBy("group").orderBy("slot")
    following = F.lead("slot", 1, slots).over(in_turn)
    run = F.sequence(F.col("slot"), following.cast("bigint") - 1)
    spread = filled.withColumn("run", run).select(
        "group", F.col("slot").alias("at"), "count", F.explode("run").alias("slot")
    )
    start = F.timestamp_millis(F.unix_millis(ts_lit(since)) + F.col("slot") * step)
    return (
        spread.filter(F.col("slot") >= 0)
        .withColumn("count", F.when(F.col("slot") == F.col("at"), F.col("count")).otherwise(zero))
        .select("group", "slot", start.alias("start"), "count")
        .orderBy("group", "slot")
    )


def group_ranking(buckets: DataFrame) -> DataFrame:
    return (
        buckets.filter(F.col("group").isNotNull())
        .groupBy("group")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "group")
    )


def peak(series: DataFrame) -> DataFrame:
    """Highest single count of a series, at least 1."""
    return series.agg(
        F.greatest(F.coalesce(F.max("count"), F.lit(0)), F.lit(1)).cast("bigint").alias("peak")
    )


def share_of_max(counts: DataFrame, name: str) -> DataFrame:
    """(name, count, pct of the largest).  By level, all four levels are listed."""
    rows = counts.select(F.col(name).alias("name"), "count")
    if name == "level":
        levels = F.array(*[F.lit(value) for value in LEVELS])
        zeros = counts.sparkSession.range(1).select(
            F.explode(levels).alias("name"), F.lit(0).cast("bigint").alias("count")
        )
        rows = (
            rows.filter(F.col("name").isin(*LEVELS))
            .unionByName(zeros)
            .groupBy("name")
            .agg(F.sum("count").alias("count"))
        )
    largest = rows.agg(F.greatest(F.coalesce(F.max("count"), F.lit(1)), F.lit(1))).scalar()
    pct = half_up(F.col("count") / largest * 100).cast("bigint")
    return rows.withColumn("pct", pct).orderBy(F.desc("count"), "name")
