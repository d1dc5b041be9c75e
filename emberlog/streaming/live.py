"""Live minute counts kept by a stream, answered by ``operators.aggregate``.

Two forms: ``live_counts_stream`` adds up partials by the clock, ``live_state_stream`` keeps windows by
event time in the state store.  Of the first:

Every epoch adds the counts of its own new entries, so the table is a sum of partials like
the rollups: nothing is lost to a watermark, and an epoch that runs again replaces its partial.
Beside the counts stand the batches they come from; the table answers for a range only when
it has counted every committed batch of the range's days.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.time import floor_to, instant, time_bucket, ts_lit
from emberlog.schema import COUNTED, LIVE, LIVE_WINDOW_MINUTES
from emberlog.sources import folders, packs
from emberlog.sources.store import LogStore


def count_minutes(entries: DataFrame) -> DataFrame:
    """Minute counts of some entries."""
    start = time_bucket(F.col("timestamp"), "1m").alias("bucket")
    return entries.groupBy(start, "service", "level").agg(F.count("*").alias("count"))


def window_start(as_of: str | datetime) -> datetime:
    """First whole minute of the live window."""
    return floor_to(instant(as_of), 60) - timedelta(minutes=LIVE_WINDOW_MINUTES - 1)


def prune_live(spark: SparkSession, path: str, as_of: str | datetime) -> None:
    """Remove the epochs that hold nothing but minutes which left the window, and the
    batches of days before it.

    The table is as small as the window, and one row per epoch comes back.
    """
    first = window_start(as_of)
    counts = f"{path}/counts"
    if folders.exists(spark, counts):
        epochs = spark.read.schema(LIVE).parquet(counts).groupBy("epoch")
        over = epochs.agg(F.max("bucket").alias("last")).filter(F.col("last") < ts_lit(first))
        for row in over.collect():
            folders.remove(spark, f"{counts}/epoch={row.epoch}")
    for part in folders.matching(spark, f"{path}/batches/dt=*"):
        if date.fromisoformat(folders.partition_values(part)["dt"]) < first.date():
            folders.remove(spark, part)


def live_counts_stream(
    entries: DataFrame,
    path: str,
    checkpoint: str,
    *,
    clock: Callable[[], datetime] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keep the live table of a stream of committed entries (``streaming.tail``).

    With ``clock`` entries that already left the window are not counted and the table is
    kept down to the window.
    """
    spark = entries.sparkSession

    def store_partial(new: DataFrame, epoch: int) -> None:
        if clock is not None:
            first = window_start(clock())
            new = new.filter(F.col("dt") >= F.lit(first.date()))
        new = new.persist()
        try:
            fresh = new if clock is None else new.filter(F.col("timestamp") >= ts_lit(first))
            folders.remove(spark, f"{path}/counts/epoch={epoch}")
            _add(count_minutes(fresh).select(*LIVE.fieldNames()[:-1]), f"{path}/counts", epoch)
            if "batch_id" in new.columns:
                _add_batches(new.select("dt", "batch_id").distinct(), f"{path}/batches", epoch)
        finally:
            new.unpersist()
        if clock is not None:
            prune_live(spark, path, clock())

    writer = entries.writeStream.foreachBatch(store_partial).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def live_state_stream(
    entries: DataFrame, path: str, checkpoint: str, *, every: str | None = None
) -> StreamingQuery:
    """Keep the last minutes of a stream by event time, counted in the state store.

    The window ends with the newest entry and not with a clock.  The watermark lies the whole window
    behind that entry, so a late entry of a minute in the window is always counted and the state of older
    minutes is given up.  Every epoch writes the new totals of the minutes it changed; an epoch that
    runs again replaces them.  Minutes that have left the window are not written: one that was given
    up may come back with a part of its count.  The grouping column is the window itself, as
    its start alone would carry no watermark.
    """
    spark = entries.sparkSession
    late = f"{LIVE_WINDOW_MINUTES} minutes"
    totals = (
        entries.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", "1 minute").alias("minute"), "service", "level")
        .agg(F.count("*").alias("count"))
    )

    def store_totals(changed: DataFrame, epoch: int) -> None:
        rows = changed.select(F.col("minute.start").alias("bucket"), "service", "level", "count").persist()
        try:
            folders.remove(spark, f"{path}/counts/epoch={epoch}")
            newest = _newest(spark, path, rows)
            if newest is not None:
                kept = rows.filter(F.col("bucket") >= ts_lit(window_start(newest)))
                _add(kept, f"{path}/counts", epoch)
                prune_live(spark, path, newest)
        finally:
            rows.unpersist()

    writer = totals.writeStream.outputMode("update").foreachBatch(store_totals)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _newest(spark: SparkSession, path: str, rows: DataFrame | None = None) -> datetime | None:
    """The newest minute of a state table and some new rows, in UTC."""
    known = spark.createDataFrame([], LIVE).select("bucket")
    if folders.exists(spark, f"{path}/counts"):
        known = spark.read.schema(LIVE).parquet(f"{path}/counts").select("bucket")
    if rows is not None:
        known = known.unionByName(rows.select("bucket"))
    seconds = known.agg(F.max(F.unix_seconds("bucket"))).first()[0]
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC)


def read_live_state(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, service, level, count) of the minutes in the window that ``live_state_stream`` keeps: of every
    key the total its last epoch wrote."""
    newest = _newest(spark, path)
    if newest is None:
        return spark.createDataFrame([], LIVE).select("bucket", "service", "level", "count")
    rows = spark.read.schema(LIVE).parquet(f"{path}/counts")
    return (
        rows.filter(F.col("bucket") >= ts_lit(window_start(newest)))
        .groupBy("bucket", "service", "level")
        .agg(F.max_by("count", "epoch").alias("count"))
    )


def _add(rows: DataFrame, path: str, epoch: int) -> None:
    (
        rows.withColumn("epoch", F.lit(epoch).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch")
        .parquet(path)
    )


def _add_batches(rows: DataFrame, path: str, epoch: int) -> None:
    (
        rows.withColumn("epoch", F.lit(epoch).cast("bigint"))
        .select(COUNTED.fieldNames())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "epoch")
        .parquet(path)
    )


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The partial counts per (minute, service, level), summed."""
    if not folders.exists(spark, f"{path}/counts"):
        return spark.createDataFrame([], LIVE).select("bucket", "service", "level", "count")
    return (
        spark.read.schema(LIVE)
        .parquet(f"{path}/counts")
        .groupBy("bucket", "service", "level")
        .agg(F.sum("count").alias("count"))
    )


@dataclass(frozen=True)
class LiveTable:
    """The live table of a store, for ``aggregate(live=…)``."""

    store: LogStore
    path: str

    def counts(self) -> DataFrame:
        return read_live(self.store.spark, self.path)

    def covers(self, since: str | datetime, until: str | datetime) -> bool:
        """Has every committed batch of the days of a range been counted?

        Compares names of batches of at most two days or so: the window is short.
        """
        spark, low, high = self.store.spark, instant(since).date(), instant(until).date()
        published = packs.published(spark, self.store.root)
        if not folders.exists(spark, f"{self.path}/batches"):
            return not self.store.newest_days(low, high)
        counted = spark.read.schema(COUNTED).parquet(f"{self.path}/batches")
        counted = counted.filter((F.col("dt") >= F.lit(low)) & (F.col("dt") <= F.lit(high)))
        # A batch met in two epochs may have been loaded twice; the rollup answers then.
        once = counted.groupBy("dt", "batch_id").agg(F.count_distinct("epoch").alias("epochs"))
        seen = {(row.dt, row.batch_id) for row in once.filter("epochs = 1").collect()}
        for day in self.store.newest_days(low, high):
            held = published[day].batches if day in published else frozenset()
            parts = folders.matching(
                spark, f"{self.store.logs_path}/dt={day.isoformat()}/batch_id=*"
            )
            names = {folders.partition_values(part)["batch_id"] for part in parts} | held
            if any((day, name) not in seen for name in names if not packs.is_pack(name)):
                return False
        return True
