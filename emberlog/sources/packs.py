"""The published copies of packed days: one small file each, written once.

``packs/dt=…/NUMBER-NAME`` lists the batches that the directory ``batch_id=NAME`` of that day
holds, in the raw rows and both rollups alike.  A later copy of the day lists everything the
earlier ones did.  Files never change once they exist, so their content is kept in memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources import folders

_PREFIX = "packed-"
_content: dict[str, frozenset[str]] = {}


@dataclass(frozen=True)
class Pack:
    day: date
    number: int
    name: str
    path: str
    batches: frozenset[str]


def new_name(unique: str) -> str:
    return _PREFIX + unique


def is_pack(batch: str) -> bool:
    return batch.startswith(_PREFIX)


def _read(spark: SparkSession, path: str) -> Pack:
    if path not in _content:
        _content[path] = frozenset(folders.read_text(spark, path).split("\n"))
    number, name = path.rsplit("/", 1)[1].split("-", 1)
    day = date.fromisoformat(folders.partition_values(path)["dt"])
    return Pack(day, int(number), name, path, _content[path])


def of_day(spark: SparkSession, root: str, day: date | str) -> list[Pack]:
    """Published copies of one day (or of all, for ``*``), oldest first."""
    text = day if isinstance(day, str) else day.isoformat()
    found = folders.matching(spark, f"{root}/packs/dt={text}/[0-9]*-{_PREFIX}*")
    return sorted((_read(spark, path) for path in found), key=lambda p: (p.day, p.number))


def published(spark: SparkSession, root: str) -> dict[date, Pack]:
    """The newest copy of every packed day; at most one file per retained day is read."""
    return {pack.day: pack for pack in of_day(spark, root, "*")}


def publish(spark: SparkSession, root: str, day: date, name: str, batches: list[str]) -> None:
    """Make a finished copy visible and what it replaces invisible, in one step."""
    earlier = of_day(spark, root, day)
    number = earlier[-1].number + 1 if earlier else 1
    path = f"{root}/packs/dt={day.isoformat()}/{number:08d}-{name}"
    folders.create(spark, path, "\n".join(batches))


def visible(rows: DataFrame, table: str, root: str) -> DataFrame:
    """Leave out unpublished copies and the batches that a published one holds."""
    spark = rows.sparkSession
    packs = published(spark, root)
    batch = F.col("batch_id")
    rows = rows.filter(~batch.startswith(_PREFIX) | batch.isin([p.name for p in packs.values()]))
    hidden: Column | None = None
    for day, pack in packs.items():
        parts = folders.matching(spark, f"{table}/dt={day.isoformat()}/batch_id=*")
        names = {folders.partition_values(part)["batch_id"] for part in parts} & pack.batches
        if names:  # only until they are removed
            own = (F.col("dt") == F.lit(day)) & batch.isin(sorted(names))
            hidden = own if hidden is None else hidden | own
    return rows if hidden is None else rows.filter(~hidden)


def days_holding(spark: SparkSession, root: str, batch: str) -> list[date]:
    """Days whose published copy already holds this batch."""
    return [day for day, pack in published(spark, root).items() if batch in pack.batches]
