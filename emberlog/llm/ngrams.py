"""Operator 2: Jaccard join of word n-gram sets through token-combination prefixes.

Tokens (the shingles of a document) have one global order: first those that one document
holds, then rare ones, then frequent ones, each by hash; two sketches of fixed size tell
the classes.  A set misses at most ``n - ceil(t * n)`` of its tokens in a partner, so one
more token than that from the front is enough to meet it.  Rare tokens are indexed one by
one.  Where a prefix reaches the frequent class it is extended and indexed by combinations
of two neighbouring frequent tokens: a token missing in the partner breaks two of them, an
additional one in the partner breaks one, and the extension outweighs both.

Equal sets are one class and compared once.  Candidates go through an exact bound (parity
bitmaps never differ in more bits than the sets in tokens) before sets are shipped.  The
first pass compares every indexed list with its smallest document only, the second the closest
members of components that meet in a list, the third all the rest of a list, but only documents
that are not connected yet.  A long list is cut into tiles for that, and no task holds more than
two; tiles of one component are not compared with each other.  So a family of thousands of near
copies costs passes over its lists, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.components import components, sort_joined
from emberlog.llm.sketches import Classes, members, merged, sketch_rows
from emberlog.llm.text import keyed, mix, null_id, shingle_sets
from emberlog.session import scratch

#: Below this percentage the combinations cannot outweigh the changes; frequent tokens
#: are then indexed one by one as well.
LEAST_COMBINED = 80
#: Documents compared with one centre in one task.
STAR_ROWS = 1024
#: Rows of one tile; a longer list is cut into tiles.
TILE = 1024
_SETS = "doc long, fp long, n long, d1 long, d2 long, sigs array<long>, bits binary, items binary"


def most_missing(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that a linked set may lack."""
    return n - -(-percent * n // 100)


def most_different(a: int, b: int, percent: int) -> int:
    """Tokens in one but not both of two linked sets."""
    return (a + b) * (100 - percent) // (100 + percent)


def signatures(
    tokens: np.ndarray, once: np.ndarray, frequent: np.ndarray, percent: int
) -> np.ndarray:
    """What a set (sorted token hashes with their classes) is indexed by."""
    n = len(tokens)
    budget = most_different(n, 100 * n // percent, percent)
    if not budget:
        return tokens[:0]  # only an equal set is close enough
    missing = most_missing(n, percent)
    need = missing + 1 - int(once.sum())
    if need <= 0:
        return tokens[:0]
    rare, common = tokens[~once & ~frequent], tokens[frequent & ~once]
    singles = mix(rare[:need], 41)
    if len(rare) >= need:
        return singles
    if percent < LEAST_COMBINED:
        return np.append(singles, mix(common[: need - len(rare)], 41))
    ahead = n - len(common)
    budget, missing = budget - ahead, missing - ahead
    reach = budget + min(missing, budget) + 2
    front = common[:reach]
    return np.append(singles, mix(mix(front[:-1], 42) * np.uint64(3) + front[1:], 43))


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of two to four bits per token; each token flips its bit.  At this size unrelated sets of
    ``n`` tokens differ in 0.86 n bits or more, and linked ones at 85 % in 0.16 n at most."""
    size = 1 << max(7, (2 * max(len(tokens), 1) - 1).bit_length())
    at = (mix(tokens, 44) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1, bitorder="little").tobytes()


def apart(one: int, one_bits: int, two: int, two_bits: int) -> int:
    """Bits in which two parity bitmaps (as numbers) differ, the larger folded to the smaller."""
    while one_bits > two_bits:
        one_bits >>= 1
        one = (one >> one_bits) ^ (one & ((1 << one_bits) - 1))
    while two_bits > one_bits:
        two_bits >>= 1
        two = (two >> two_bits) ^ (two & ((1 << two_bits) - 1))
    return (one ^ two).bit_count()


def _index(texts: DataFrame, width: int, percent: int, make) -> tuple[DataFrame, Broadcast]:
    """One row per text: its set's size and digest, signatures, bitmap and tokens (the last
    three only if it has signatures); and the sketch to release when the rows are written."""

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, size = [], 0
        for _, tokens in shingle_sets(batch.column(0), width):
            held.append(tokens)
            size += len(tokens)
            if size > 1 << 18:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    classes = merged(sketch_rows(texts.select("text"), make, values), make(), make().cells)
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc", "fp", "n", "d1", "d2")]
        + [("sigs", pa.list_(pa.int64())), ("bits", pa.binary()), ("items", pa.binary())]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = make()
        for batch in batches:
            rows: list[tuple] = []
            for _, tokens in shingle_sets(batch.column(2), width):
                if not len(tokens):
                    rows.append((0, None, None, [], None, None))
                    continue
                once, frequent = sketch.of(classes.value, tokens)
                sigs = signatures(tokens, once, frequent, percent)
                digest = np.frombuffer(blake2b(tokens, digest_size=16).digest(), np.int64)
                found = len(sigs) > 0
                rows.append(
                    (
                        len(tokens),
                        *digest.tolist(),
                        sigs.view(np.int64),
                        parity(tokens) if found else None,
                        tokens.tobytes() if found else None,
                    )
                )
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array(list(c), t.type) for c, t in zip(columns, list(schema)[2:], strict=True)],
                schema=schema,
            )

    return texts.mapInArrow(index, _SETS), classes


def _close_bitmaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps do not rule them out."""
    bits = sets.where("bits is not null").select("node", "bits")
    wide = sort_joined(pairs, bits.toDF("a", "bits_a"), ["a"])
    wide = sort_joined(wide, bits.toDF("b", "bits_b"), ["b"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            columns = [batch[c].to_pylist() for c in ("na", "nb", "bits_a", "bits_b")]
            for na, nb, x, y in zip(*columns, strict=True):
                one, two = int.from_bytes(x, "little"), int.from_bytes(y, "little")
                far = apart(one, 8 * len(x), two, 8 * len(y))
                kept.append(far <= most_different(na, nb, percent))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return wide.mapInArrow(prune, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(one, two) of the written pairs whose sets are really so close.  Pairs come as stars: a centre's
    set travels once per task, the others' once per pair; a large star is split."""
    # Only the sets of these pairs travel; the filter's size is fixed.
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    items = members(ends, 1 << 24)(sets.where("items is not null").select("node", "items"), "node")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    split = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / STAR_ROWS))
    others = sort_joined(pairs.select("a", "b"), sizes, ["a"]).withColumn("part", split.cast("long"))
    centres = others.select("a", "part").distinct()
    rows = (
        sort_joined(centres, items.toDF("a", "items"), ["a"])
        .select("a", "part", F.lit(False).alias("other"), F.col("a").alias("b"), "items")
        .union(
            sort_joined(others, items.toDF("b", "items"), ["b"]).select(
                "a", "part", F.lit(True).alias("other"), "b", "items"
            )
        )
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            columns = [batch[c].to_pylist() for c in ("a", "b", "other", "items")]
            for a, b, other, data in zip(*columns, strict=True):
                tokens = np.frombuffer(data, np.uint64)
                if not other:
                    centre = tokens
                    continue
                both = np.concatenate([centre, tokens])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    found.append((a, b))
            if found:
                ends = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in ends], names=["one", "two"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "other")
    return dealt.mapInArrow(verify, "one long, two long")


def _cells(placed: DataFrame, percent: int) -> DataFrame:
    """(sig, cell, half) and the columns of ``placed``: the rows of lists with several components.  A
    short list is one cell (-1).  A long one is cut into tiles by size band, component if that
    alone fills a tile, and hash; a cell is a pair of tiles (halves 0 and 1) that may hold close
    rows of different components, or a tile by itself (half null)."""
    spark = placed.sparkSession
    path = scratch(spark, "open")
    placed.groupBy("sig").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    ).where("low != high").select("sig", "size").write.parquet(path)
    lists = spark.read.parquet(path)
    columns = ("sig", "cell", "half", *(c for c in placed.columns if c != "sig"))
    whole = sort_joined(placed, lists.where(F.col("size") <= TILE), ["sig"], "left_semi").select(
        "*", F.lit(-1).cast("long").alias("cell"), F.lit(None).cast("int").alias("half")
    ).select(*columns)
    long = lists.where(F.col("size") > TILE)
    if not long.take(1):
        return whole

    # Rows two bands apart are never of comparable size; the bands are a little too wide for that.
    band = F.floor(F.log("n") / F.log(F.lit(100.1 / percent))).alias("band")
    rows = sort_joined(placed, long, ["sig"], "left_semi").select("*", band)
    groups = rows.groupBy("sig", "band", "component").agg(F.count("*").alias("size"))
    alone = F.col("size") > TILE
    mixed = groups.where(~alone).groupBy("sig", "band").agg(F.sum("size").alias("total"))
    owners = sort_joined(groups, mixed, ["sig", "band"], "left").select(
        "sig", "band", "component",
        F.when(alone, F.col("component")).otherwise(F.lit(-1)).alias("owner"),
        F.ceil(F.when(alone, F.col("size")).otherwise(F.col("total")) / TILE).alias("parts"),
    )
    dealt = F.when(F.col("owner") < 0, F.xxhash64("component")).otherwise(F.xxhash64("node"))
    path = scratch(spark, "tiles")
    sort_joined(rows, owners, ["sig", "band", "component"]).withColumn(
        "part", F.pmod(dealt, F.col("parts"))
    ).drop("parts").write.parquet(path)
    rows = spark.read.parquet(path)

    tile = ("band", "owner", "part")
    tiles = rows.select("sig", *tile).distinct()
    one, two = (F.struct(*(F.col(f"{c}_{end}").alias(c) for c in tile)) for end in "ab")
    path = scratch(spark, "cells")
    sort_joined(
        tiles.toDF("sig", *(f"{c}_a" for c in tile)), tiles.toDF("sig", *(f"{c}_b" for c in tile)), ["sig"]
    ).where(one <= two).where("band_b - band_a <= 1 and (owner_a < 0 or owner_a != owner_b)").withColumn(
        "cell", F.monotonically_increasing_id()
    ).withColumn("itself", one == two).write.parquet(path)
    cells = spark.read.parquet(path)
    half = F.when(~F.col("itself"), F.lit(0)).alias("half")
    ends = cells.select("sig", *(F.col(f"{c}_a").alias(c) for c in tile), "cell", half).union(
        cells.where("not itself").select("sig", *(f"{c}_b" for c in tile), "cell", F.lit(1))
    )
    return whole.union(sort_joined(rows, ends, ["sig", *tile]).select(*columns))


def _rest_of_lists(rows: DataFrame, percent: int, one_each: bool) -> DataFrame:
    """Pairs of one cell that are in different components, close in size and by bitmap.  Rows
    come sorted by cell and size, so only those of comparable size are held.

    With ``one_each`` a row is paired with the closest member of each other component only,
    and counts as joined to it from then on: at most about one pair per row and list.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}  # of the cell: the rows of each component
        for batch in batches:
            found = []
            names = ("sig", "cell", "half", "node", "n", "component", "bits")
            for sig, cell, half, node, n, component, bits in zip(
                *[batch[c].to_pylist() for c in names], strict=True
            ):
                if (sig, cell) != current:
                    current, held, now_in = (sig, cell), {}, {}
                while component in now_in:
                    component = now_in[component]
                own = int.from_bytes(bits, "little"), 8 * len(bits)
                for group in list(held):
                    members = held[group]
                    while members and 100 * members[0][1] < percent * n:
                        members.pop(0)
                    if group == component:
                        continue
                    near = []
                    for d, m, b, other in members:
                        if half is not None and other == half:
                            continue
                        far = apart(*own, *b)
                        if far <= most_different(n, m, percent):
                            near.append((far, (d, m)))
                    if one_each and near:
                        near = [min(near)]
                        now_in[group] = component
                        joined = held.setdefault(component, [])
                        joined.extend(held.pop(group))
                        joined.sort(key=lambda row: row[1])
                    for _, other in near:
                        low, high = sorted([(node, n), other])
                        found.append((*low, *high))
                held.setdefault(component, []).append((node, n, own, half))
            if found:
                columns = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["a", "na", "b", "nb"]
                )

    dealt = rows.repartition("sig", "cell").sortWithinPartitions("sig", "cell", "n")
    return dealt.mapInArrow(compare, "a long, na long, b long, nb long").distinct()


def similarity_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    filter_bits: int = 1 << 28,
    counters: int = 1 << 23,
    often: int = 32,
) -> DataFrame:
    """Components of documents whose word shingle sets have a Jaccard similarity of ``percent``.

    Words are lower-cased (A-Z) and split at white space; a set holds the distinct ``width``-word
    shingles as 64-bit hashes, of a shorter text its whole sequence.  Returns per row ``id_col,
    n_shingles, component_id``, the smallest id reachable by links.  A text that is null or without
    words has an empty set and no links.  A null id counts as the largest id; texts under one id,
    or without one, are documents of their own, and rows repeating an id and its text are one.
    Other columns of ``docs`` are not read, whatever their names; an empty table gives an empty
    table.  ``filter_bits`` and ``counters`` size the sketches, ``often`` is the number of documents
    from which a token counts as frequent: they decide how many candidates are looked at and
    never the result.
    """
    found = row_classes(docs, id_col, text_col, width, percent, filter_bits, counters, often)
    return found.select(
        null_id("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        null_id("first").alias("component_id"),
    )


def row_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    filter_bits: int = 1 << 28,
    counters: int = 1 << 23,
    often: int = 32,
) -> DataFrame:
    """``similarity_classes`` by the names that ``keyed`` gives rows: per row ``doc, fp, n`` and
    ``first, first_fp``, the smallest (doc, fp) reachable by links."""
    spark = docs.sparkSession
    path = scratch(spark, "sets")
    rows, sketch = _index(
        keyed(docs, id_col, text_col), width, percent, lambda: Classes(filter_bits, counters, often)
    )
    # A node of the graph is a row, numbered in no order; equal rows are linked as equal sets are.
    rows.withColumn("node", F.monotonically_increasing_id()).write.parquet(path)
    sketch.destroy()
    sets = spark.read.schema(f"node long, {_SETS}").parquet(path)

    full = sets.where("n > 0").select("node", "d1", "d2")
    classes = full.groupBy("d1", "d2").agg(F.min("node").alias("first"))
    same = sort_joined(full, classes, ["d1", "d2"]).where("node != first")
    same = same.select(F.col("node").alias("one"), F.col("first").alias("two"))

    path = scratch(spark, "lists")
    firsts = classes.select(F.col("first").alias("node"))
    listed = sort_joined(
        sets.where(F.size("sigs") > 0).select("node", "n", "sigs"), firsts, ["node"], "left_semi"
    ).select("node", "n", F.explode(F.array_distinct("sigs")).alias("sig"))
    centres = listed.groupBy("sig").agg(
        F.min(F.struct("node", "n")).alias("centre"), F.count("*").alias("size")
    )
    sort_joined(listed, centres.where("size > 1"), ["sig"]).drop("size").write.parquet(path)
    listed = spark.read.parquet(path)

    def near(a: str, b: str):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    path = scratch(spark, "stars")
    listed.where("node != centre.node").select(
        F.col("centre.node").alias("a"), F.col("centre.n").alias("na"),
        F.col("node").alias("b"), F.col("n").alias("nb"),
    ).where(near("na", "nb")).distinct().write.parquet(path)
    stars = spark.read.parquet(path)
    path = scratch(spark, "pairs")
    _close_bitmaps(stars, sets, percent).write.parquet(path)
    close = spark.read.parquet(path)
    path = scratch(spark, "linked")
    _links(close, sets, percent).union(same).distinct().write.parquet(path)
    linked = spark.read.parquet(path)
    found = components(linked)

    # First one pair for every two components that may touch, then, with what is connected
    # by now left out, all the others.
    tested = stars.select("a", "b")
    for one_each in (True, False):
        placed = sort_joined(listed.select("sig", "n", "node"), found, ["node"], "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        bits = sets.where("bits is not null").select("node", "bits")
        cells = sort_joined(_cells(placed, percent), bits, ["node"])
        rest = _rest_of_lists(cells, percent, one_each)
        path = scratch(spark, "rest")
        sort_joined(rest, tested, ["a", "b"], "left_anti").write.parquet(path)
        rest = spark.read.parquet(path)
        if not rest.take(1):
            if one_each:
                continue  # all these pairs may be known, and others not yet
            break
        tested = tested.union(rest.select("a", "b"))
        path = scratch(spark, "linked")
        _links(rest, sets, percent).write.parquet(path)  # whose bitmaps have been compared
        later = spark.read.parquet(path)
        if later.take(1):
            found = components(later.union(found.select("node", "component")))
    # A row without links is a component of its own.
    placed = sort_joined(sets.select("node", "doc", "fp", "n"), found, ["node"], "left")
    placed = placed.withColumn("component", F.coalesce("component", "node")).drop("node")
    least = placed.groupBy("component").agg(F.min(F.struct("doc", "fp")).alias("least"))
    return sort_joined(placed, least, ["component"]).select(
        "doc", "fp", "n", F.col("least.doc").alias("first"), F.col("least.fp").alias("first_fp")
    )
