"""Operator 1: near-duplicate vectors through a pivot-permutation index.

Reference vectors (pivots) are a bounded sample that covers the space; a vector is described
by its nearest pivots in order.  It is put into the inverted list of every pair among the first
few of them, under its label.  Two vectors of a list are candidates if they share enough of
their nearest pivots; candidates are verified by cosine in double precision.

Equal vectors are one entry.  A list is worked on in tiles, so one with any number of vectors
fits; a pair that meets in several lists counts in the one of its two smallest shared pivots.
A tile gives every vector its number of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.components import _forest, components
from emberlog.llm.text import bounded_batches, id_of, null_id
from emberlog.session import scratch

#: Pivots, and the size of the sample they are chosen from.
PIVOTS = 1024
SAMPLE = 4096
#: Chosen pivots are no closer to each other than this cosine.
APART = 0.7
#: Nearest pivots that describe a vector, those whose pairs have lists, and how many must be shared.
DESCRIBED, LISTED, SHARED = 12, 6, 4
#: Vectors of one half of a tile.
TILE = 1024
#: Rows of a similarity matrix held at a time.
BLOCK = 512


def choose_pivots(sample: np.ndarray, count: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """The first ``count`` unit vectors of ``sample`` that are not close to one chosen before;
    filled up to 16 with fixed pseudorandom directions, so that small tables have pairs too."""
    dim = sample.shape[1]
    chosen = np.empty((0, dim))
    left = unit_rows(sample) if len(sample) else sample
    while len(left) and len(chosen) < count:
        chosen = np.vstack([chosen, left[:1]])
        left = left[1:][left[1:] @ left[0] < apart]
    if len(chosen) < 16:
        more = np.random.default_rng(dim).standard_normal((16 - len(chosen), dim))
        chosen = np.vstack([chosen, more / np.linalg.norm(more, axis=1, keepdims=True)])
    return chosen


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one.  The largest component is taken out first, so that squares of very
    small or very large ones neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the nearest pivots of every unit vector, nearest first."""
    count = min(count, len(pivots))
    near = vectors @ pivots.T
    some = np.argpartition(-near, count - 1, axis=1)[:, :count]
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.int32)


def _tile_links(list_key: tuple[int, int], rows: list[tuple], least: float):
    """(nodes, links of each, forest as two arrays) of the pairs that one tile owns.

    ``rows`` are (half, node, weight, vector, prefix); with two halves only pairs across count."""
    half = np.array([r[0] for r in rows])
    node = np.array([r[1] for r in rows], np.int64)
    weight = np.array([r[2] for r in rows], np.int64)
    x = unit_rows(np.stack([np.frombuffer(r[3], np.float64) for r in rows]))
    prefix = np.stack([np.frombuffer(r[4], np.int32) for r in rows])
    names = np.unique(prefix)
    has = np.zeros((len(rows), len(names)), np.float32)
    has[np.arange(len(rows))[:, None], np.searchsorted(names, prefix)] = 1
    listed = np.zeros_like(has)
    first = prefix[:, : min(LISTED, prefix.shape[1])]
    listed[np.arange(len(rows))[:, None], np.searchsorted(names, first)] = 1
    p, q = list_key
    earlier = listed[:, (names < q) & (names != p)]
    shared = min(SHARED, prefix.shape[1])
    across = len(np.unique(half)) > 1
    links = np.zeros(len(rows), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(rows), BLOCK):
        own = slice(at, at + BLOCK)
        close = (x[own] @ x.T >= least) & (has[own] @ has.T >= shared) & (earlier[own] @ earlier.T == 0)
        close &= half[own][:, None] != half[None, :] if across else True
        close[np.arange(close.shape[0]), np.arange(at, at + close.shape[0])] = False
        links[own] = close @ weight
        a, b = np.nonzero(close)
        if len(a):
            ends.append(_forest(node[a + at], node[b]))
    if not ends:
        return None
    low, high = _forest(*(np.concatenate(e) for e in zip(*ends, strict=True)))
    met = links > 0
    return node[met], links[met], low, high


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Links between vectors of one label with at least this cosine, as one row per input row:
    ``id_col, n_links, component_id, kept``.

    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id reachable
    and ``kept`` says whether that is the row itself.  Links below the cosine never appear; some above
    it may be missed where too few pivots are shared.  Vectors that are null or zero, have null or
    non-finite components or no label link with nothing; vectors of different lengths never link.  Rows
    repeating an id and its vector are one vector, answered on every row; a null id counts as
    the largest id.  Unlike vectors under one id, or without one, are vectors of their own, and at most
    one of them in a component is kept.  Other columns are not read, whatever their names; an empty table gives an
    empty table.  The pivots are chosen from ``SAMPLE`` vectors with the smallest hashes of their ids.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    raw = vectors.select(
        id_of(id_col).alias("id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).withColumn("d1", F.xxhash64("vector")).withColumn("d2", F.xxhash64(F.lit(1), "vector"))
    finite = F.forall(
        "vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    useful = (
        F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    )
    path = scratch(spark, "vectors")
    (
        raw.where(useful)
        .groupBy("label", "d1", "d2")
        .agg(
            F.min("id").alias("id"),
            F.count_distinct("id").alias("weight"),
            F.first("vector").alias("vector"),
        )
        .withColumn("node", F.monotonically_increasing_id())  # (label, d1, d2), numbered in no order
        .write.parquet(path)
    )
    classes = spark.read.parquet(path)
    drawn = classes.orderBy(F.xxhash64("id"), "id", "d1", "d2", "label")
    chosen = drawn.limit(SAMPLE).select("vector").collect()
    sample = [r.vector for r in chosen]
    dims = sorted({len(v) for v in sample}, key=lambda d: -sum(len(v) == d for v in sample))
    held = (
        {dims[0]: choose_pivots(np.array([v for v in sample if len(v) == dims[0]]), pivots)}
        if dims else {}
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(held)
        for batch in batches:
            flat, size = batch.column(1).flatten().to_numpy(), np.array(
                [len(v) for v in batch.column(1)], np.int64
            )
            begin = np.cumsum(size) - size
            described = np.empty(batch.num_rows, object)
            packed = np.empty(batch.num_rows, object)
            for dim in np.unique(size).tolist():
                if dim not in own:
                    own[dim] = choose_pivots(np.empty((0, dim)))
                at = np.flatnonzero(size == dim)
                for part in np.array_split(at, max(1, len(at) // 1024)):
                    x = flat[begin[part][:, None] + np.arange(dim)]
                    for i, row, near in zip(part, x, nearest_pivots(unit_rows(x), own[dim], DESCRIBED), strict=True):
                        described[i], packed[i] = near, row.tobytes()
            pairs = [
                [int(min(a, b)) << 32 | int(max(a, b)) for a, b in combinations(d[:LISTED], 2)]
                for d in described
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(packed.tolist(), pa.binary()),
                    pa.array([d.tobytes() for d in described], pa.binary()),
                    pa.array(pairs, pa.list_(pa.int64())),
                ],
                names=["row", "dim", "packed", "prefix", "pairs"],
            )

    rows = classes.select(F.struct("node", "label", "weight", "d1", "d2").alias("row"), "vector")
    kind = rows.schema["row"].dataType.simpleString()
    path = scratch(spark, "described")
    rows.mapInArrow(
        describe, f"row {kind}, dim long, packed binary, prefix binary, pairs array<long>"
    ).select("row.*", "dim", "packed", "prefix", "pairs").write.parquet(path)
    entries = spark.read.parquet(path)

    lists = entries.select("label", "dim", "d1", "d2", F.explode("pairs").alias("pair"))
    sizes = lists.groupBy("label", "dim", "pair").agg(F.count("*").alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    placed = lists.join(sizes, ["label", "dim", "pair"]).withColumn("tiles", tiles).withColumn(
        "own", F.pmod(F.xxhash64("d1", "d2"), F.col("tiles")).cast("int")
    )
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = spread.select(
        "label", "dim", "pair", "d1", "d2",
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("half"),
    )
    cell = ["label", "dim", "pair", "a", "b"]
    full = cells.join(
        entries.select("label", "d1", "d2", "node", "weight", "packed", "prefix"), ["label", "d1", "d2"]
    ).select(
        F.xxhash64(*cell).alias("deal"), *cell, "half", "node", "weight", "packed", "prefix"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if current is None or len(rows) < 2:
                return
            found = _tile_links((current[2] >> 32, current[2] & 0xFFFFFFFF), rows, cosine)
            if found is not None:
                node, links, low, high = found
                none = np.zeros(len(low), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(node, high)),
                        pa.array(np.append(links, none)),
                        pa.array(np.append(node, low)),
                    ],
                    names=["node", "links", "low"],
                )

        for batch in batches:
            columns = [batch[c].to_pylist() for c in (*cell, "half", "node", "weight", "packed", "prefix")]
            for row in zip(*columns, strict=True):
                if row[:5] != current:
                    yield from finish()
                    current, rows = row[:5], []
                rows.append(row[5:])
        yield from finish()

    path = scratch(spark, "links")
    full.repartition("deal").sortWithinPartitions("deal", *cell).drop("deal").mapInArrow(
        verify, "node long, links long, low long"
    ).write.parquet(path)
    linked = spark.read.schema("node long, links long, low long").parquet(path)
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(linked.select("low", "node"))
    placed = found.join(classes.select("node", "id"), "node")
    least = placed.groupBy("component").agg(F.min(F.struct("id", "node")).alias("least"))
    placed = placed.join(least, "component").select("node", "least")
    answer = (
        classes.select("label", "d1", "d2", "id", "node", "weight")
        .join(counts, "node", "left")
        .join(placed, "node", "left")
        .select(
            F.col("label").alias("l"), F.col("d1").alias("e1"), F.col("d2").alias("e2"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("least.id", "id").alias("component"),
            F.when(F.coalesce("least.node", "node") == F.col("node"), F.col("id")).alias("stays"),
        )
    )
    same = (F.col("label") == F.col("l")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    out = raw.withColumn("useful", useful).join(answer, same & F.col("useful"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        null_id("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        null_id(component).alias("component_id"),
        (F.col("component").isNull() | F.col("stays").eqNullSafe(F.col("id"))).alias("kept"),
    )
