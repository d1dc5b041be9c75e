"""Continuous ingestion: request bodies in, validated rows and rollups out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.time import instant
from emberlog.operators.dead_letters import dead_letter_write, discard_dead
from emberlog.operators.validation import derive_columns, split_batch, validate_entries
from emberlog.schema import DEFAULT_RETENTION_DAYS, REJECTED
from emberlog.sources import folders
from emberlog.sources.envelopes import (
    explode_envelopes,
    name_envelopes,
    refused_envelopes,
    stream_batches,
)
from emberlog.sources.store import LogStore, check_batch_id


def flush_batch(
    store: LogStore, accepted: DataFrame, batch_id: str, as_of: str | datetime
) -> str | None:
    """Load one batch into the raw rows and both rollups, or dead-letter all of it.

    On an error whatever was written goes again before the batch is queued, so a
    later replay does not count rows twice.  Returns the error text, if any.
    If queueing fails as well the error is raised: a stream then keeps the batch
    in its checkpoint and tries it again.
    """
    discard_dead(store, batch_id)
    try:
        store.load_batch(derive_columns(accepted, batch_id), batch_id)
    except Exception as error:  # noqa: BLE001 - any failure at all sends the batch to the queue
        store.discard_batch(batch_id)
        reason = str(error).strip().split("\n", 1)[0] or type(error).__name__
        dead_letter_write(store, accepted, reason, as_of, dead_id=batch_id)
        return reason
    return None


def write_rejected(store: LogStore, rejected: DataFrame, batch_id: str) -> None:
    """Keep what a batch refused, in place of what an earlier attempt refused."""
    rows = rejected.withColumn("batch_id", F.lit(check_batch_id(batch_id)))
    folders.remove(store.spark, f"{store.rejected_path}/batch_id={batch_id}")
    (
        rows.select(REJECTED.fieldNames())
        .hint("rebalance")  # a few files of fair size, however many tasks parsed the input
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(store.rejected_path)
    )


def ingest_bodies(
    store: LogStore,
    bodies: DataFrame,
    batch_id: str,
    as_of: str | datetime,
    *,
    retention_days: int = DEFAULT_RETENTION_DAYS,
    keep_parsed: bool = False,
) -> None:
    """Validate request bodies and store the outcome as one batch.

    A body refused as a whole is kept among the rejected with no index.
    ``keep_parsed`` caches the validated rows so that they are parsed once for
    both outcomes; it suits a micro-batch.  A large historical load parses twice
    instead of holding everything.
    """
    envelopes = name_envelopes(bodies, prefix=f"{batch_id}/")
    validated = validate_entries(
        explode_envelopes(envelopes), as_of, retention_days=retention_days
    )
    if keep_parsed:
        validated = validated.persist()
    try:
        accepted, rejected = split_batch(validated.filter(F.col("index").isNotNull()))
        rejected = rejected.unionByName(
            refused_envelopes(validated).select(
                "envelope", F.lit(None).cast("int").alias("index"), F.col("error").alias("reason")
            )
        )
        with ThreadPoolExecutor(1) as pool:
            run = inheritable_thread_target(store.spark)(write_rejected)
            refused = pool.submit(run, store, rejected, batch_id)
            flush_batch(store, accepted, batch_id, as_of)
        refused.result()
    finally:
        if keep_parsed:
            validated.unpersist()


def epoch_time(
    spark: SparkSession, checkpoint: str, epoch: int, clock: Callable[[], datetime]
) -> str:
    """The time an epoch is judged by, fixed beside the checkpoint on its first attempt, so that
    a retry accepts and refuses the same entries."""
    path = f"{checkpoint}/times/{epoch:010d}"
    folders.create(spark, path, instant(clock()).isoformat())
    return folders.read_text(spark, path)


def ingest_stream(
    spark: SparkSession,
    path: str,
    store: LogStore,
    checkpoint: str,
    *,
    clock: Callable[[], datetime] = lambda: datetime.now(UTC),
    retention_days: int = DEFAULT_RETENTION_DAYS,
    max_files_per_trigger: int | None = 1000,
    every: str | None = None,
) -> StreamingQuery:
    """Start ingestion from a folder that request bodies arrive in.

    Without ``every`` the stream takes what is there and stops.  The batch name
    follows from the checkpoint's own id and the epoch, so an epoch that runs again
    replaces its own rows and never those of another stream.
    """

    def load(bodies: DataFrame, epoch: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_bodies(
            store,
            bodies,
            f"{stream}-{epoch:010d}",
            epoch_time(spark, checkpoint, epoch, clock),
            retention_days=retention_days,
            keep_parsed=True,
        )

    bodies = stream_batches(spark, path, max_files_per_trigger=max_files_per_trigger)
    writer = bodies.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
