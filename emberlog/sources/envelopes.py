"""Request bodies (``{"logs": […]}``, one JSON document per line) to one row per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Why a whole envelope is refused.
MALFORMED = "Malformed JSON"
NO_LOGS = "request body must be { logs: [...] }"

#: Batch and streaming readers agree on this shape.
BODY_SCHEMA = "value STRING"


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files below ``path`` with the full path of their file: bare names may
    be the same in two folders."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def stream_batches(
    spark: SparkSession, path: str, *, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same as a stream; the file limit per trigger bounds a micro-batch."""
    reader = spark.readStream.schema(BODY_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def name_envelopes(bodies: DataFrame, prefix: str = "") -> DataFrame:
    """Give each line a name of its own: file plus a number unique to the line.

    The number follows from the order of the scan, so a task that runs again
    gives the same names.
    """
    return bodies.select(
        F.concat(
            F.lit(prefix), F.col("file"), F.lit("#"), F.monotonically_increasing_id()
        ).alias("envelope"),
        F.col("value").alias("body"),
    )


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """(envelope, body) to one row per entry: (envelope, error, index, entry VARIANT).

    An envelope that is refused or empty still gives one row, with a NULL index,
    so nothing has to be joined back later to report on it.
    """
    parsed = envelopes.select("envelope", F.try_parse_json("body").alias("doc"), "body")
    typed = parsed.select(
        "envelope",
        F.try_variant_get("doc", "$.logs", "array<variant>").alias("logs"),
        (
            F.try_variant_get("doc", "$", "map<string,variant>").isNotNull()
            | F.try_variant_get("doc", "$", "array<variant>").isNotNull()
            | (F.trim("body") == "")
        ).alias("is_document"),
    )
    checked = typed.select(
        "envelope",
        "logs",
        F.when(~F.col("is_document"), F.lit(MALFORMED))
        .when(F.col("logs").isNull(), F.lit(NO_LOGS))
        .alias("error"),
    )
    return checked.select(
        "envelope", "error", F.posexplode_outer("logs").alias("index", "entry")
    )


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return explode_envelopes(name_envelopes(read_bodies(spark, path)))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry with its position in the batch."""
    return entries_of(read_envelopes(spark, path))


def entries_of(exploded: DataFrame) -> DataFrame:
    return exploded.filter(F.col("index").isNotNull()).drop("error")


def refused_envelopes(exploded: DataFrame) -> DataFrame:
    return exploded.filter(F.col("error").isNotNull()).select("envelope", "error")
