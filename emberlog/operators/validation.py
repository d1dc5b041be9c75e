"""Entry validation, normalisation and the reports made from it.

``validate_entries`` is pure column expressions, so the batch job, the backfill
and the stream all use the same plan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import variants
from emberlog.functions.text import entry_id, has_text
from emberlog.functions.time import instant, is_stale, parse_iso, ts_lit
from emberlog.schema import DEFAULT_RETENTION_DAYS, FUTURE_TOLERANCE_MINUTES, LEVELS

FIELDS = ("timestamp", "level", "service", "message", "attributes")

# Rejection reasons.
NOT_OBJECT = "entry must be an object"
BAD_TIMESTAMP = "invalid timestamp"
IN_FUTURE = "timestamp is more than 5 minutes in the future"
TOO_OLD = "timestamp is older than the retention window ({days} days)"
BAD_LEVEL = "Invalid level: "
BAD_SERVICE = "service should be a notNull string"
BAD_MESSAGE = "message should be a notNull string"
BAD_ATTRIBUTES = "attributes must be a flat object"

# Patterns over the type text of a JSON object, such as OBJECT<a: BIGINT, b: STRING>.
QUOTED_KEY = r"`([^`]|``)*`"
NESTED = r"<.*(OBJECT|ARRAY)<|: VOID"


def normalize_attributes(value: Column, shape: Column) -> Column:
    """Attributes as MAP<STRING,STRING>; missing or null gives an empty map.

    NULL means the value is not a flat object, which its type text ``shape`` tells.
    """
    types = F.when(shape.contains("`"), F.regexp_replace(shape, QUOTED_KEY, "x")).otherwise(shape)
    # Strings, booleans and whole numbers of up to 15 digits read alike everywhere; only
    # other numbers need the slower rule, value by value.
    plain = variants.get(value, "map<string,string>")
    long = F.exists(F.map_values(plain), lambda text: F.length(text) > 15)
    odd_numbers = shape.rlike("DOUBLE|DECIMAL") | (shape.contains("BIGINT") & long)
    values = variants.get(value, "map<string,variant>")
    return (
        F.when(shape.isNull() | (shape == "VOID"), F.create_map().cast("map<string,string>"))
        .when(~shape.startswith("OBJECT") | types.rlike(NESTED), F.lit(None))
        .when(~odd_numbers, plain)
        .otherwise(F.transform_values(values, lambda _, item: variants.scalar_text(item)))
    )


def validate_entries(
    entries: DataFrame,
    as_of: str | datetime,
    *,
    retention_days: int = DEFAULT_RETENTION_DAYS,
    allow_stale: bool = False,
) -> DataFrame:
    """Replace ``entry`` (VARIANT or JSON text) by its parsed columns and ``reason``.

    ``reason`` is NULL for a valid entry; otherwise it names the first failing
    rule.  All other input columns stay.
    """
    now = instant(as_of)
    kept = [name for name in entries.columns if name != "entry"]
    entry = F.col("entry")
    if isinstance(entries.schema["entry"].dataType, T.StringType):
        entry = F.try_parse_json(entry)

    shape = "struct<" + ",".join(f"{name}:variant" for name in FIELDS) + ">"
    fields = entries.select(*kept, entry.alias("entry")).select(
        *kept,
        variants.get(F.col("entry"), shape).alias("f"),
        variants.get(F.col("entry"), "array<variant>").isNotNull().alias("is_array"),
    )
    typed = fields.select(
        *kept,
        (F.col("f").isNotNull() | F.col("is_array")).alias("is_object"),
        variants.only_text(F.col("f.timestamp")).alias("timestamp_text"),
        F.col("f.level").alias("level_value"),
        variants.only_text(F.col("f.level")).alias("level"),
        variants.only_text(F.col("f.service")).alias("service"),
        variants.only_text(F.col("f.message")).alias("message"),
        F.col("f.attributes").alias("attributes_value"),
        variants.kind(F.col("f.attributes")).alias("attributes_shape"),
    )
    parsed = typed.withColumns(
        {
            "timestamp": parse_iso(F.col("timestamp_text")),
            "attributes": normalize_attributes(
                F.col("attributes_value"), F.col("attributes_shape")
            ),
        }
    )

    ts = F.col("timestamp")
    horizon = ts_lit(now) + F.expr(f"INTERVAL {FUTURE_TOLERANCE_MINUTES} MINUTES")
    rules = (
        F.when(~F.col("is_object"), F.lit(NOT_OBJECT))
        .when(ts.isNull(), F.lit(BAD_TIMESTAMP))
        .when(ts > horizon, F.lit(IN_FUTURE))
    )
    if not allow_stale:
        rules = rules.when(
            is_stale(ts, now, retention_days), F.lit(TOO_OLD.format(days=retention_days))
        )
    known = F.coalesce(F.col("level").isin(*LEVELS), F.lit(False))
    reason = (
        rules.when(~known, F.concat(F.lit(BAD_LEVEL), variants.any_text(F.col("level_value"))))
        .when(~F.coalesce(has_text(F.col("service")), F.lit(False)), F.lit(BAD_SERVICE))
        .when(~F.coalesce(has_text(F.col("message")), F.lit(False)), F.lit(BAD_MESSAGE))
        .when(F.col("attributes").isNull(), F.lit(BAD_ATTRIBUTES))
    )
    # Filters on ``reason`` must run on the finished value.  The optimizer would copy
    # them, and with them all of the parsing, below the projections; it does not move
    # them below a generator, and a one-element inline is one.
    outcome = F.struct(
        reason.alias("reason"),
        "timestamp",
        "timestamp_text",
        "level",
        "service",
        "message",
        "attributes",
    )
    return parsed.select(*kept, F.inline(F.array(outcome)))


def split_batch(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); one bad entry never takes others with it."""
    accepted = validated.filter(F.col("reason").isNull()).drop("reason")
    rejected = validated.filter(F.col("reason").isNotNull()).select("envelope", "index", "reason")
    return accepted, rejected


def derive_columns(accepted: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Add the stored columns: id, lower-cased message and day.

    The id is a name-based UUID of the batch, the envelope and the position in it.
    Unlike a random one it survives a task that has to run again.
    """
    batch = [] if batch_id is None else [F.lit(batch_id)]
    return accepted.select(
        entry_id(*batch, F.col("envelope"), F.col("index").cast("string")).alias("id"),
        "timestamp",
        "level",
        "service",
        "message",
        F.lower("message").alias("message_lower"),
        "attributes",
        F.to_date("timestamp").alias("dt"),
    )


def batch_report(validated: DataFrame) -> DataFrame:
    """Per envelope: accepted, rejected, HTTP-like status and envelope error.

    Give it the validated rows of ``read_envelopes``, which hold one row even for
    an empty or refused envelope; that makes the report one partial aggregation
    without a join.  The reasons stay rows (``split_batch``): a list per
    envelope would have to gather a group of any size in one task.
    """
    is_entry = F.col("index").isNotNull()
    is_valid = is_entry & F.col("reason").isNull()
    accepted = F.count_if(is_valid)
    return (
        validated.groupBy("envelope")
        .agg(
            accepted.alias("accepted"),
            F.count_if(is_entry & ~is_valid).alias("n_rejected"),
            F.max("error").alias("error"),
        )
        .withColumn("status", F.when(F.col("accepted") > 0, 200).otherwise(400))
    )


def backfill_plan(
    entries: DataFrame, as_of: str | datetime, days: int = DEFAULT_RETENTION_DAYS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan of a historical load: (to_insert, rejected, outcome).

    Old entries are valid here, but those beyond the retention window are
    discarded: they would go again at the next retention run.  ``outcome`` counts
    (outcome, dt) with the day of accepted entries only, at most one row per day
    of the window and two more; report and dates both come from it.
    """
    validated = validate_entries(entries, as_of, retention_days=days, allow_stale=True)
    return split_backfill(validated, as_of, days)


def split_backfill(
    validated: DataFrame, as_of: str | datetime, days: int = DEFAULT_RETENTION_DAYS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three parts of ``backfill_plan`` from entries that were validated before."""
    now = instant(as_of)
    stale = is_stale(F.col("timestamp"), now, days)
    accepted, rejected = split_batch(validated)
    outcome = (
        F.when(F.col("reason").isNotNull(), F.lit("rejected"))
        .when(stale, F.lit("discarded"))
        .otherwise(F.lit("accepted"))
    )
    counted = (
        validated.select(outcome.alias("outcome"), "timestamp")
        .withColumn("dt", F.when(F.col("outcome") == "accepted", F.to_date("timestamp")))
        .groupBy("outcome", "dt")
        .agg(F.count("*").alias("count"))
    )
    return accepted.filter(~stale), rejected, counted


def backfill_report(outcome: DataFrame) -> DataFrame:
    """(accepted, discarded, rejected, status) of a planned historical load."""
    counts = [
        F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("count"))), F.lit(0)).alias(name)
        for name in ("accepted", "discarded", "rejected")
    ]
    status = F.when(F.col("accepted") > 0, 200).otherwise(400)
    return outcome.agg(*counts).withColumn("status", status)


def backfill_dates(outcome: DataFrame) -> DataFrame:
    """The UTC days a planned historical load touches."""
    return outcome.filter(F.col("dt").isNotNull()).select("dt")
