"""The live tail: newly committed entries, by service and level."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.time import ts_lit
from emberlog.schema import LEVELS, LOGS
from emberlog.sources import folders, packs
from emberlog.sources.store import LogStore

TAIL_COLUMNS = ("timestamp", "level", "service", "message", "attributes")


def committed_entries(
    store: LogStore, *, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the store's raw rows as batches are committed.

    Packed copies of a day hold nothing new and are left out by their directory's
    name, without being opened.
    """
    folders.make(store.spark, store.logs_path)
    reader = store.spark.readStream.schema(LOGS)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(store.logs_path).filter(~F.col("batch_id").startswith(packs.new_name("")))


def live_tail(
    store: LogStore,
    *,
    service: str | None = None,
    level: str | None = None,
    started_at: str | datetime | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Entries as they are committed; a tailed entry has no id.

    ``started_at`` leaves out files written before the tail began.  The filter is
    on the file's own time, so older files are skipped without being opened.
    """
    if level is not None and level not in LEVELS:
        raise ValueError(f"invalid level: '{level}'")
    rows = committed_entries(store, max_files_per_trigger=max_files_per_trigger)
    # Rows that the repair job moved into their day are not new.
    rows = rows.filter(~F.col("batch_id").startswith("stray-"))
    if started_at is not None:
        rows = rows.filter(F.col("_metadata.file_modification_time") >= ts_lit(started_at))
    if service is not None:
        rows = rows.filter(F.col("service") == service)
    if level is not None:
        rows = rows.filter(F.col("level") == level)
    return rows.select(*TAIL_COLUMNS)
