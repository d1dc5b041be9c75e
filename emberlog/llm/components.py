"""Connected components of a table of links, by alternating stars.

Every round first contracts what meets in one task, then links all larger neighbours of a
node to its smallest one, then all smaller neighbours likewise.  Each round is written
to the shared folder, so a lost executor costs one round.  A graph that has become smaller than what a
task contracts at a time needs no further round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import scratch

#: Links contracted together inside a task.
FOREST_LINKS = 1 << 19
_LINKS = "low long, high long"


def _forest(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for all but the smallest, from some links."""
    nodes, ends = np.unique(np.concatenate([low, high]), return_inverse=True)
    a, b = ends[: len(low)], ends[len(low) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        small, large = np.minimum(ra, rb), np.maximum(ra, rb)
        if (small == large).all():
            break
        np.minimum.at(root, large, small)
        while not (root[root] == root).all():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        low, high = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["low", "high"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
        if count >= FOREST_LINKS:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def sort_joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the rows: never broadcast, as that would pass through the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _ordered(links: DataFrame) -> DataFrame:
    links = links.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
    return links.where("low < high").distinct()


def _stars(links: DataFrame) -> DataFrame:
    """One round: larger neighbours to the smallest neighbour, then smaller ones to it."""
    both = links.select(F.col("low").alias("node"), F.col("high").alias("other")).union(
        links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    large = (
        sort_joined(both, least, ["node"])
        .where("other > node")
        .select(F.least("node", "least").alias("low"), F.col("other").alias("high"))
        .distinct()
    )
    least = large.groupBy("high").agg(F.min("low").alias("least"))
    small = sort_joined(large, least, ["high"])
    return _ordered(
        small.where("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
        .union(small.where("low = least").select("low", "high"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns, in any order); the
    component is the smallest node reachable.  Null ends and self links link nothing."""
    spark = links.sparkSession
    a, b = links.columns[:2]
    links = links.select(F.col(a).alias("low"), F.col(b).alias("high")).dropna()
    links = links.where("low != high")

    def written(rows: DataFrame) -> DataFrame:
        path = scratch(spark, "links")
        rows.write.parquet(path)
        return spark.read.schema(_LINKS).parquet(path)

    links = written(links.mapInArrow(_contract, _LINKS))
    before = None
    while True:
        if links.limit(FOREST_LINKS).count() < FOREST_LINKS:
            # So few are left that one task holds them, as it held its own share before.
            links = written(links.coalesce(1).mapInArrow(_contract, _LINKS))
            break
        links = written(_stars(links.mapInArrow(_contract, _LINKS)))
        now = links.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(low, high))"), F.sum(F.xxhash64("high") % 65536)
        ).first()
        if now == before or now[0] == 0:
            break
        before = now
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
