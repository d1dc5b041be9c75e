"""A summary of messages: the distinct three-character strings of every batch and day.

``message_grams/dt=…/batch_id=…`` is a plain table kept by one aggregation (``refresh``), some
thousandth of the rows it describes.  A message search joins the strings of its pattern with
it and leaves out the batches that lack one; the exact match still decides about every row.  A batch
without a summary is always read, and storing a batch again removes its summary first, so
the summary may lag behind or be missing without changing a result.
"""

from __future__ import annotations

from datetime import date, datetime
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from emberlog.functions.text import contains_pattern
from emberlog.functions.time import instant
from emberlog.sources import folders

if TYPE_CHECKING:
    from emberlog.sources.store import LogStore

SIZE = 3
SCHEMA = "gram STRING, dt DATE, batch_id STRING"
#: Batches under these names are rows moved later, which may be added to.
UNSETTLED = ("stray-", "replay-")


def pattern_grams(q: str) -> list[str]:
    """The strings that every match of a message search holds; none if its literal parts are short."""
    parts, literal = [""], contains_pattern(q)
    at = 0
    while at < len(literal):
        char = literal[at]
        if char in "%_":
            parts.append("")
        else:
            at += char == "\\"
            parts[-1] += literal[at]
        at += 1
    return sorted({part[i : i + SIZE] for part in parts for i in range(len(part) - SIZE + 1)})


def _named(path: str) -> tuple[str, str]:
    values = folders.partition_values(path)
    return values["dt"], values["batch_id"]


def _listed(store: LogStore, table: str, day: str = "*") -> dict[tuple[str, str], str]:
    found = folders.matching(store.spark, f"{table}/dt={day}/batch_id=*")
    return {_named(path): path for path in found}


def refresh(store: LogStore, until: date | None = None) -> int:
    """Summarise the batches that have no summary, of days before ``until`` (all days if None), and
    drop summaries of batches that are gone; the number of batches summarised.

    Meant for days that loads have finished with.  It may run again after a failure at any point.
    """
    rows, known = _listed(store, store.logs_path), _listed(store, store.grams_path)
    for name in known.keys() - rows.keys():
        folders.remove(store.spark, known[name])
    new = [
        path
        for name, path in rows.items()
        if name not in known
        and not name[1].startswith(UNSETTLED)
        and (until is None or date.fromisoformat(name[0]) < until)
    ]
    if new:
        message = F.col("message_lower")
        grams = F.transform(
            F.sequence(F.lit(1), F.length(message) - (SIZE - 1)), lambda at: F.substring(message, at, F.lit(SIZE))
        )
        found = (
            store.read_logs(new)
            .where(F.length(message) >= SIZE)
            .select(F.explode(F.array_distinct(grams)).alias("gram"), "dt", "batch_id")
            .distinct()
        )
        store.replace_grams(found)
    return len(new)


def parts_to_read(
    store: LogStore, q: str, since: str | datetime | None = None, until: str | datetime | None = None
) -> list[str] | None:
    """The batch directories that may hold a match, or None if the summary cannot tell.

    Names of directories pass through the driver, as in any listing; the strings do not.
    """
    grams = pattern_grams(q)
    known = _listed(store, store.grams_path) if grams else {}
    if not known:
        return None
    low = instant(since).date() if since else date.min
    high = instant(until).date() if until else date.max
    held = store.spark.read.schema(SCHEMA).parquet(store.grams_path).where(F.col("gram").isin(grams))
    if since:
        held = held.where(F.col("dt") >= F.lit(low))
    if until:
        held = held.where(F.col("dt") <= F.lit(high))
    counts = held.groupBy("dt", "batch_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    hits = {(row.dt.isoformat(), row.batch_id) for row in counts.collect()}
    return [
        path
        for name, path in _listed(store, store.logs_path).items()
        if low <= date.fromisoformat(name[0]) <= high and (name in hits or name not in known)
    ]
