"""The log store: raw rows, three count rollups, parked stray rows and dead letters.

Layout below ``root`` (all Parquet)::

    logs/dt=…/batch_id=…            accepted rows
    minute_counts/dt=…/batch_id=…   partial counts per (minute, service, level)
    hourly_counts/dt=…/batch_id=…   partial counts per (hour, service, level)
    daily_counts/dt=…/batch_id=…    partial counts per (day, service, level)
    stray/dt=…/batch_id=…           rows waiting to be moved into their day
    rejected/batch_id=…             what ingestion refused, and why
    dead_letters/failed_dt=…/written=…  entries of batches that failed to load, many to a directory
    dead_gone/note=…                which of them left the queue
    dead_done/…                     the notes that count
    message_grams/dt=…/batch_id=…   summaries of messages, where they were asked for
    packs/dt=…/…                    what each packed copy of a day replaces

Every write replaces exactly the ``(dt, batch_id)`` directories of its own batch,
so repeating a batch after a lost executor or driver changes nothing.  Counts are
kept as one partial per batch and summed on read: adding a batch never rewrites
another one.  A batch that a packed copy of its day already holds is not stored again.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.predicates import by_spans, by_time, pair_values
from emberlog.functions.time import instant, time_bucket
from emberlog.schema import (
    DEAD_ENTRIES,
    DEAD_LETTER,
    LOGS,
    PAIR_COLUMNS,
    QUEUED,
    REJECTED,
    ROLLUP,
)
from emberlog.sources import folders, grams, packs

GRAINS = {"minute": "1m", "hour": "1h", "day": "1d"}
_FOLDERS = {"minute": "minute", "hour": "hourly", "day": "daily"}

#: Bytes of a Bloom filter, at most; with more values it lets more row groups through.
FILTER_BYTES = 1 << 17

_BATCH_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def check_batch_id(batch_id: str) -> str:
    """Batch names become directory names, so they stay within plain characters."""
    if not _BATCH_NAME.fullmatch(batch_id):
        raise ValueError(f"batch id may hold letters, digits, '_', '.', '-': {batch_id!r}")
    return batch_id


def with_filters(writer: DataFrameWriter) -> DataFrameWriter:
    """Bloom filters for the pair columns (of tables that have them), sized by their content."""
    for name in PAIR_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        # A column with a dictionary gets no Bloom filter.
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    return writer.options(
        **{
            "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.candidates.number": "3",
            "parquet.bloom.filter.max.bytes": str(FILTER_BYTES),
        }
    )


def among(
    rows: DataFrame,
    letters: DataFrame,
    how: str,
    keys: tuple[str, ...] = tuple(DEAD_LETTER.fieldNames()),
) -> DataFrame:
    """Rows whose keys are among ``letters`` (``left_semi``) or are not (``left_anti``)."""
    same = [F.col(f"rows.{key}").eqNullSafe(F.col(f"letters.{key}")) for key in keys]
    return rows.alias("rows").join(letters.select(*keys).alias("letters"), same, how)


@dataclass(frozen=True)
class LogStore:
    spark: SparkSession
    root: str

    # -- paths ---------------------------------------------------------------

    @property
    def logs_path(self) -> str:
        return f"{self.root}/logs"

    @property
    def stray_path(self) -> str:
        return f"{self.root}/stray"

    @property
    def rejected_path(self) -> str:
        return f"{self.root}/rejected"

    @property
    def dead_path(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def gone_path(self) -> str:
        return f"{self.root}/dead_gone"

    @property
    def done_path(self) -> str:
        return f"{self.root}/dead_done"

    @property
    def grams_path(self) -> str:
        return f"{self.root}/message_grams"

    def rollup_path(self, grain: str) -> str:
        return f"{self.root}/{_FOLDERS[grain]}_counts"

    # -- reads ---------------------------------------------------------------

    def _read(self, path: str, schema: T.StructType, sub: list[str] | None = None) -> DataFrame:
        if sub is not None:
            if not sub:
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).option("basePath", path).parquet(*sub)
        if not folders.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _read_days(
        self,
        path: str,
        schema: T.StructType,
        since: str | datetime | None,
        until: str | datetime | None,
    ) -> DataFrame:
        """Rows of the days a range touches; directories of other days are not even listed.

        Whatever is being packed, each row shows once.
        """
        if not since and not until:
            return packs.visible(self._read(path, schema), path, self.root)
        low = instant(since) if since else datetime.min
        high = instant(until) if until else datetime.max
        return self._read_spans(path, schema, [(low, high)])

    def _read_spans(
        self, path: str, schema: T.StructType, spans: list[tuple[datetime, datetime]]
    ) -> DataFrame:
        days = [(low.date(), high.date()) for low, high in spans]
        parts = []
        for part in folders.matching(self.spark, f"{path}/dt=*"):
            day = date.fromisoformat(folders.partition_values(part)["dt"])
            if any(low <= day <= high for low, high in days):
                parts.append(part)
        return packs.visible(self._read(path, schema, parts), path, self.root)

    def read_parts(self, path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
        """Rows of exactly these batch directories."""
        return self._read(path, schema, parts)

    def scan_logs(
        self,
        since: str | datetime | None = None,
        until: str | datetime | None = None,
        *,
        include_stray: bool = False,
        may_hold: str | None = None,
    ) -> DataFrame:
        """Stored rows in ``[since, until)``; the bounds also prune day directories.

        ``may_hold`` leaves out batches whose summary shows that no message matches this search;
        the rows of the others are not filtered by it.
        """
        parts = grams.parts_to_read(self, may_hold, since, until) if may_hold else None
        if parts is None:
            rows = self._read_days(self.logs_path, LOGS, since, until)
        else:
            rows = packs.visible(self.read_logs(parts), self.logs_path, self.root)
        if include_stray:
            rows = rows.unionByName(self.scan_stray())
        return rows.filter(by_time(since, until, day="dt"))

    def read_logs(self, parts: list[str]) -> DataFrame:
        return self._read(self.logs_path, LOGS, parts)

    def scan_stray(self) -> DataFrame:
        return self._read(self.stray_path, LOGS)

    def read_stray(self, parts: list[str]) -> DataFrame:
        return self._read(self.stray_path, LOGS, parts)

    def scan_partials(
        self,
        grain: str,
        since: str | datetime | None = None,
        until: str | datetime | None = None,
    ) -> DataFrame:
        """The per-batch partial counts whose bucket starts in the range, not yet summed."""
        rows = self._read_days(self.rollup_path(grain), ROLLUP, since, until)
        return rows.filter(by_time(since, until, column="bucket", day="dt"))

    def scan_logs_in(self, spans: list[tuple[datetime, datetime]]) -> DataFrame:
        """Stored rows in any of some ranges, in one scan of the days they touch."""
        rows = self._read_spans(self.logs_path, LOGS, spans)
        return rows.filter(by_spans(spans, "timestamp", "dt"))

    def scan_partials_in(self, grain: str, spans: list[tuple[datetime, datetime]]) -> DataFrame:
        """The partial counts whose bucket starts in any of some ranges, in one scan."""
        rows = self._read_spans(self.rollup_path(grain), ROLLUP, spans)
        return rows.filter(by_spans(spans, "bucket", "dt"))

    def scan_rollup(
        self,
        grain: str,
        since: str | datetime | None = None,
        until: str | datetime | None = None,
    ) -> DataFrame:
        """True counts per (bucket, service, level)."""
        return (
            self.scan_partials(grain, since, until)
            .groupBy("bucket", "service", "level")
            .agg(F.sum("count").alias("count"))
        )

    def scan_batch(self, batch_id: str) -> DataFrame:
        """Rows of one batch, found by directory and not by listing the whole table."""
        parts = folders.matching(self.spark, f"{self.logs_path}/dt=*/batch_id={batch_id}")
        return self._read(self.logs_path, LOGS, parts)

    def scan_rejected(self) -> DataFrame:
        return self._read(self.rejected_path, REJECTED)

    def scan_dead(self) -> DataFrame:
        return self.scan_queued().select(DEAD_ENTRIES.fieldNames())

    def scan_queued(self) -> DataFrame:
        """Entries of the dead letters that wait, each with its place."""
        rows, gone = self._read(self.dead_path, QUEUED), self.notes()
        return among(rows, self.scan_notes(gone), "left_anti") if gone else rows

    def notes(self, done: bool = True) -> list[str]:
        """Names of the notes that count, or of those that do not yet."""
        closed = {path.rsplit("/", 1)[1] for path in folders.matching(self.spark, f"{self.done_path}/*")}
        found = folders.matching(self.spark, f"{self.gone_path}/note=*")
        names = [folders.partition_values(path)["note"] for path in found]
        return [name for name in names if (name in closed) == done]

    def scan_notes(self, names: list[str]) -> DataFrame:
        """The dead letters that some notes name."""
        paths = [f"{self.gone_path}/note={name}" for name in names]
        return self.spark.read.schema(DEAD_LETTER).parquet(*paths)

    # -- writes --------------------------------------------------------------

    def _replace_parts(self, df: DataFrame, path: str, *order: str) -> None:
        """Replace the (dt, batch_id) directories present in ``df`` and no others.

        The rebalance hint shuffles by directory but lets the adaptive planner
        split a hot day over many tasks and pack small days together, so one day
        holding a third of the rows becomes many files, not one long task.
        Sorting gives row groups narrow service and time ranges to skip by.
        """
        (
            with_filters(
                df.hint("rebalance", F.col("dt"), F.col("batch_id"))
                .sortWithinPartitions("dt", "batch_id", *order)
                .write.mode("overwrite")
            )
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch_id")
            .parquet(path)
        )

    def append_logs(self, logs: DataFrame, batch_id: str | None = None) -> None:
        """Store accepted rows under ``batch_id`` (or the one each row carries)."""
        if batch_id is not None:
            logs = logs.withColumn("batch_id", F.lit(check_batch_id(batch_id)))
            self._remove_parts(self.grams_path, batch_id)
        logs = logs.withColumns(pair_values(F.col("attributes")))
        self._replace_parts(logs.select(LOGS.fieldNames()), self.logs_path, "service", "timestamp")

    def replace_grams(self, found: DataFrame) -> None:
        """Put the summaries of whole (dt, batch_id) directories; sorted, so few row groups match."""
        self._replace_parts(found, self.grams_path, "gram")

    def park_stray(self, logs: DataFrame, batch_id: str) -> None:
        """Store rows outside the table proper, to be moved or dropped by the repair job."""
        logs = logs.withColumn("batch_id", F.lit(check_batch_id(batch_id)))
        logs = logs.withColumns(pair_values(F.col("attributes")))
        self._replace_parts(logs.select(LOGS.fieldNames()), self.stray_path, "service", "timestamp")

    def add_counts(self, entries: DataFrame, grain: str, batch_id: str | None = None) -> None:
        """Add the counts of new log rows to one rollup, as this batch's partial.

        Repeating the batch replaces its partial.
        """
        if batch_id is not None:
            entries = entries.withColumn("batch_id", F.lit(check_batch_id(batch_id)))
        start = time_bucket(F.col("timestamp"), GRAINS[grain])
        counts = (
            entries.groupBy(start.alias("bucket"), "service", "level", "batch_id")
            .agg(F.count("*").alias("count"))
            .withColumn("dt", F.to_date("bucket"))
            .select(ROLLUP.fieldNames())
        )
        self.replace_counts(counts, grain)

    def replace_counts(self, partials: DataFrame, grain: str) -> None:
        """Put back the partials of whole (dt, batch_id) directories."""
        self._replace_parts(partials, self.rollup_path(grain), "service", "level", "bucket")

    def add_all_counts(self, entries: DataFrame, batch_id: str | None = None) -> None:
        """All rollups at once: small independent jobs, side by side."""
        with ThreadPoolExecutor(len(GRAINS)) as pool:
            jobs = [
                pool.submit(
                    inheritable_thread_target(self.spark)(self.add_counts), entries, grain, batch_id
                )
                for grain in GRAINS
            ]
        for job in jobs:
            job.result()

    def load_rows(self, logs: DataFrame) -> None:
        """Raw rows and all rollups, for rows that carry their own ``batch_id``."""
        held = None
        for day, pack in packs.published(self.spark, self.root).items():
            names = [name for name in pack.batches if name.startswith(("stray-", "replay-"))]
            if names:
                own = (F.col("dt") == F.lit(day)) & F.col("batch_id").isin(names)
                held = own if held is None else held | own
        logs = logs if held is None else logs.filter(~held)
        self.append_logs(logs)
        self.add_all_counts(logs)

    def rebuild_rollup(self, grain: str) -> None:
        """Recompute the partial of every batch of one rollup from its raw rows.

        Each partial is a function of its batch alone, so this may run beside loads and
        readers: a batch that is counted meanwhile gets the same numbers.  Partials
        that were there before and have no raw rows are removed.
        """
        path = self.rollup_path(grain)
        listed = folders.matching(self.spark, f"{path}/dt=*/batch_id=*")
        start = time_bucket(F.col("timestamp"), GRAINS[grain]).alias("bucket")
        counts = (
            self.scan_logs()
            .groupBy(start, "service", "level", "batch_id")
            .agg(F.count("*").alias("count"))
            .withColumn("dt", F.to_date("bucket"))
        )
        self.replace_counts(counts.select(ROLLUP.fieldNames()), grain)
        raw = {
            tuple(sorted(folders.partition_values(part).items()))
            for part in folders.matching(self.spark, f"{self.logs_path}/dt=*/batch_id=*")
        }
        for part in listed:
            if tuple(sorted(folders.partition_values(part).items())) not in raw:
                folders.remove(self.spark, part)

    def load_batch(self, logs: DataFrame, batch_id: str) -> None:
        """Raw rows first, then all rollups counted from what was stored.

        Reading three narrow columns back is much cheaper than parsing the entries
        a second time.  Leftovers of an earlier attempt go first: a retry
        may touch fewer days than the attempt it repeats.  Days whose packed copy
        already holds the batch are left alone.
        """
        held = packs.days_holding(self.spark, self.root, batch_id)
        if held:
            logs = logs.filter(~F.col("dt").isin(held))
        self.discard_batch(batch_id)
        self.append_logs(logs, batch_id)
        self.add_all_counts(self.scan_batch(batch_id), batch_id)

    def discard_batch(self, batch_id: str) -> None:
        check_batch_id(batch_id)
        for path in (*map(self.rollup_path, GRAINS), self.grams_path, self.logs_path):
            self._remove_parts(path, batch_id)

    def _remove_parts(self, path: str, batch_id: str) -> None:
        for part in folders.matching(self.spark, f"{path}/dt=*/batch_id={batch_id}"):
            folders.remove(self.spark, part)

    # -- day directories -----------------------------------------------------

    def days(self, path: str | None = None) -> list[date]:
        """Days that hold a batch, from the listing alone."""
        found = folders.matching(self.spark, f"{path or self.logs_path}/dt=*/batch_id=*")
        return sorted({date.fromisoformat(folders.partition_values(p)["dt"]) for p in found})

    def newest_days(self, since: date | None = None, until: date | None = None) -> list[date]:
        """Days of the raw rows in a range, newest first; their batches are not listed."""
        found = folders.matching(self.spark, f"{self.logs_path}/dt=*")
        days = [date.fromisoformat(folders.partition_values(part)["dt"]) for part in found]
        low, high = since or date.min, until or date.max
        return sorted((day for day in days if low <= day <= high), reverse=True)

    def drop_day(self, path: str, day: date) -> bool:
        if path == self.logs_path:
            folders.remove(self.spark, f"{self.root}/packs/dt={day.isoformat()}")
            folders.remove(self.spark, f"{self.grams_path}/dt={day.isoformat()}")
        return folders.remove(self.spark, f"{path}/dt={day.isoformat()}")
