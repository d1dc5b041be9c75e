"""Checks that compare tables of the store with each other."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.time import instant, time_bucket, ts_lit
from emberlog.operators.aggregate import bucket_counts
from emberlog.sources.store import GRAINS


#: Bits of a hash that are summed: counts of up to 2**36 rows per day and side stay within a long.
_HASH_BITS = 26
_KEYS = ("bucket", "service", "level")


def _sides(logs: DataFrame, partials: DataFrame, grain: str) -> DataFrame:
    """(bucket, service, level, raw, rollup): raw rows count 1 on one side, partials on the other."""
    one, zero = (F.lit(value).cast("bigint") for value in (1, 0))
    start = time_bucket(F.col("timestamp"), GRAINS[grain]).alias("bucket")
    raw = logs.select(start, "service", "level", one.alias("raw"), zero.alias("rollup"))
    rolled = partials.select(*_KEYS, zero.alias("raw"), F.col("count").alias("rollup"))
    return raw.unionByName(rolled)


def _unlike(sides: DataFrame, part: Column) -> DataFrame:
    """Parts whose two sides do not hold the same keys equally often.

    Sums of hashes do not depend on any order: what is shuffled is one row per part and task,
    however many keys and rows there are.  Three sums of 26 bits of hash and the count itself have to
    agree.
    """
    gap = F.col("raw") - F.col("rollup")
    sums = [F.sum(gap).alias("rows")]
    for seed in range(3):
        own = F.pmod(F.xxhash64(F.lit(seed), *_KEYS), F.lit(1 << _HASH_BITS))
        sums.append(F.sum(own * gap).alias(f"sum_{seed}"))
    folded = sides.groupBy(part.alias("part")).agg(*sums)
    differs = reduce(Column.__or__, [F.col(c) != 0 for c in folded.columns[1:]])
    return folded.filter(differs).select("part")


def _within(rows: DataFrame, column: str, hours: list[datetime]) -> DataFrame:
    """Rows of some hours; the days they lie in also prune directories."""
    of = F.col(column)
    hour = time_bucket(of, "1h").isin([ts_lit(h) for h in hours])
    if "dt" in rows.columns:
        rows = rows.filter(F.col("dt").isin(sorted({h.date() for h in hours})))
    return rows.filter(hour)


def rollup_drift(
    logs: DataFrame, partials: DataFrame, grain: str, *, skip_day: date | None = None
) -> DataFrame:
    """(bucket, service, level, raw, rollup) wherever the two counts differ.

    Sums of hashes are compared per day first, in the days that differ per hour, and only the hours
    that differ are counted by key.  A clean store shuffles one row per day and task and is read
    once; days and hours that differ pass through the driver.  ``skip_day`` leaves out the
    retention cutoff day, where rollups are trimmed and raw rows are not yet.
    """
    spark = logs.sparkSession
    if skip_day is not None:
        logs = logs.filter(F.to_date("timestamp") != F.lit(skip_day))
        partials = partials.filter(F.to_date("bucket") != F.lit(skip_day))
    days = [r.part for r in _unlike(_sides(logs, partials, grain), F.to_date("bucket")).collect()]
    if not days:
        return spark.createDataFrame([], _sides(logs, partials, grain).schema)
    hours = [instant(day) + timedelta(hours=h) for day in days for h in range(24)]
    if grain != "day":
        some = _sides(_within(logs, "timestamp", hours), _within(partials, "bucket", hours), grain)
        found = _unlike(some, F.unix_seconds(time_bucket(F.col("bucket"), "1h")))
        hours = [datetime.fromtimestamp(r.part, UTC) for r in found.collect()]
    both = _sides(_within(logs, "timestamp", hours), _within(partials, "bucket", hours), grain)
    return (
        both.groupBy(*_KEYS)
        .agg(F.sum("raw").alias("raw"), F.sum("rollup").alias("rollup"))
        .filter(F.col("raw") != F.col("rollup"))
    )


def run_visibility(
    logs: DataFrame,
    run_id: str,
    since: str | datetime,
    until: str | datetime,
    *,
    key: str = "load_run_id",
) -> DataFrame:
    """How many rows of one load run can be seen: the total over its day buckets."""
    days = bucket_counts(logs, since, until, "1d", attr={key: run_id})
    return days.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("visible"))
