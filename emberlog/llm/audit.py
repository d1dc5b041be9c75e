"""Operator 13: how filters interact, from a sparse document-term matrix.

Every task cuts its documents into shards of a few megabytes of text and counts each shard's words
in CSR form, by a dictionary of the shard.  The shards are written; their dictionaries meet in one
global dictionary with dense numbers, and come back to the shards, so that only distinct words of
a shard are shuffled and a word found everywhere is one row per shard.  The row sums and
nonzero counts of the matrix decide the filters on words; the other filters need no words.  What is
left is counted per set of failed filters, and all orders of the filters follow from these counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.text import bounded_batches, chunks, id_of, word_codes
from emberlog.session import scratch

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Documents in a shard, at most.
SHARD_ROWS = 1 << 14
#: Filters in the order of their bits.
FILTERS = "ABCDE"
FEWEST_WORDS = 50
FEWEST_DISTINCT = 65
MOST_CAPITALS = 5
MARKS = b"#$%&*|"

#: Bits of a term's number; the words of a shard, fewer than its bytes, have the rest.
_TERM_BITS = 36

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True

#: One shard: its documents (number of the row, and what its text alone decides), the words of its
#: dictionary, and the matrix: ``ends`` of the rows, then ``terms`` and ``counts`` of their entries.
_SHARD = (
    "shard long, docs array<struct<doc:long,part:string,print:binary,flags:int>>, "
    "words array<binary>, matrix binary, n_entries long"
)


def _pack(ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> bytes:
    """CSR arrays as bytes; terms rise inside a row, so their steps are what is compressed."""
    step = np.diff(terms, prepend=0).astype(np.int64)
    flat = np.concatenate([ends, step, counts]).astype("<i8")
    flat = flat.view(np.uint8).reshape(-1, 8).T  # equal places of the numbers lie together
    return pa.compress(flat.tobytes(), "zstd", asbytes=True)


def unpack(matrix: bytes, rows: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, term numbers, counts) of a shard: document ``i`` has the entries from
    ``pointers[i]`` to ``pointers[i + 1]``."""
    size = rows + 2 * entries
    raw = np.frombuffer(pa.decompress(matrix, 8 * size, "zstd"), np.uint8).reshape(8, size)
    flat = np.ascontiguousarray(raw.T).view("<i8").ravel()
    pointers = np.append(0, flat[:rows])
    return pointers, np.cumsum(flat[rows : rows + entries]), flat[rows + entries :]


def _count(owner: np.ndarray, codes: np.ndarray, rows: int, terms: int):
    """CSR arrays of (row, term) pairs that may repeat."""
    entry, counts = np.unique(owner * max(terms, 1) + codes, return_counts=True)
    row, term = np.divmod(entry, max(terms, 1))
    return np.cumsum(np.bincount(row, minlength=rows)), term, counts


def _text_flags(chunk) -> np.ndarray:
    """Bits of the filters C and D for every text of a chunk."""

    def total(chosen: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(chosen, dtype=np.int64))[chunk.edges])

    points = total((chunk.data & 0xC0) != 0x80)
    capitals = 100 * total(_CAPITAL[chunk.data]) > MOST_CAPITALS * points
    return capitals * 4 + (total(_MARK[chunk.data]) > 0) * 8


def _local_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    kind = pa.schema(
        [
            ("shard", pa.int64()),
            ("docs", pa.list_(pa.struct([
                ("doc", pa.int64()), ("part", pa.string()), ("print", pa.binary()), ("flags", pa.int32())
            ]))),
            ("words", pa.list_(pa.binary())), ("matrix", pa.binary()), ("n_entries", pa.int64()),
        ]
    )
    for batch in batches:
        texts = batch.column(2)
        for chunk in chunks(texts, SHARD_BYTES, SHARD_ROWS):
            codes, words, edges = word_codes(chunk)
            rows = len(chunk.edges) - 1
            owner = np.repeat(np.arange(rows), np.diff(edges))
            ends, terms, counts = _count(owner, codes, rows, len(words))
            data = chunk.data.tobytes()
            prints = [
                hashlib.blake2b(data[a:b], digest_size=16).digest()
                for a, b in zip(chunk.edges[:-1].tolist(), chunk.edges[1:].tolist(), strict=True)
            ]
            own = slice(chunk.first, chunk.last)
            docs = pa.StructArray.from_arrays(
                [
                    batch.column(0)[own].cast(pa.int64()), batch.column(1)[own].cast(pa.string()),
                    pa.array(prints, pa.binary()), pa.array(_text_flags(chunk).astype(np.int32)),
                ],
                ["doc", "part", "print", "flags"],
            )
            one = [
                pa.array([(task << 32) + made], pa.int64()),
                pa.ListArray.from_arrays([0, rows], docs),
                pa.ListArray.from_arrays([0, len(words)], words.cast(pa.binary())),
                pa.array([_pack(ends, terms, counts)], pa.binary()),
                pa.array([len(terms)], pa.int64()),
            ]
            made += 1
            yield pa.RecordBatch.from_arrays(one, schema=kind)


def _dictionary(words: DataFrame) -> DataFrame:
    """(word, term): distinct words numbered from 0 without gaps."""
    spark = words.sparkSession
    path = scratch(spark, "dictionary")
    place = F.monotonically_increasing_id()
    words.distinct().withColumn("place", place).write.parquet(path)
    table = spark.read.parquet(path)
    # One row per writing task, whatever the number of words.
    part = F.shiftright("place", 33)
    sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return table.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "word", (F.col("start") + inside).alias("term")
    )


def document_term_matrix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """The words of all texts as CSR shards: ``shard, docs, terms, matrix, n_entries``.

    ``docs`` lists the documents of a shard (doc, part, print, flags), ``terms`` the global numbers of
    the words of its dictionary and ``matrix`` the counts (``unpack``, whose term numbers are places in
    ``terms``).  Words are maximal runs without white space, case counts.  A null text has none, a
    null part is the empty one and a null id the largest.  Every row of ``docs`` is a row of the matrix,
    repeated ones too; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    read = docs.select(
        id_of(id_col).alias("doc"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    path = scratch(spark, "shards")
    read.mapInArrow(_local_shards, _SHARD).write.parquet(path)
    shards = spark.read.schema(_SHARD).parquet(path)
    local = shards.select("shard", F.posexplode("words").alias("place", "word"))
    numbered = local.hint("merge").join(_dictionary(local.select("word")).hint("merge"), "word")
    # A list has the words of one shard, so its size is bounded by the shard's.  Place and term are one
    # number, the place in its upper bits.
    both = F.shiftleft(F.col("place").cast("long"), _TERM_BITS).bitwiseOR(F.col("term"))
    placed = F.sort_array(F.collect_list(both))
    low = F.lit((1 << _TERM_BITS) - 1)
    terms = numbered.groupBy("shard").agg(F.transform(placed, lambda x: x.bitwiseAND(low)).alias("terms"))
    kept = shards.select("shard", "docs", "matrix", "n_entries").hint("merge")
    none = F.array().cast("array<long>")
    return kept.join(terms.hint("merge"), "shard", "left").select(
        "shard", "docs", F.coalesce("terms", none).alias("terms"), "matrix", "n_entries"
    )


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the filters it fails, but for E, from the rows of the matrix."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch.column(1)[i].values
            entries = batch.column(4)[i].as_py()
            pointers, _, counts = unpack(batch.column(3)[i].as_py(), len(docs), entries)
            sums = np.append(0, np.cumsum(counts))[pointers]
            words, distinct = np.diff(sums), np.diff(pointers)
            flags = docs.field("flags").to_numpy()
            flags = flags | (words < FEWEST_WORDS) | (100 * distinct < FEWEST_DISTINCT * words) * 2
            yield pa.RecordBatch.from_arrays(
                [
                    docs.field("doc"), docs.field("part"), docs.field("print"),
                    pa.array(flags.astype(np.int32)), pa.array(words), pa.array(distinct),
                ],
                names=["doc", "part", "print", "flags", "n_words", "n_distinct"],
            )


def failed_filters(matrix: DataFrame) -> DataFrame:
    """(doc, part, print, flags, n_words, n_distinct) per document of the matrix; ``flags`` has the
    bits of the filters A to D that it fails."""
    return matrix.mapInArrow(
        _decided, "doc long, part string, print binary, flags int, n_words long, n_distinct long"
    )


def failure_counts(
    decided: DataFrame, labels: DataFrame, id_col: str = "doc_id",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """(part, flags, docs, good, toxic): documents per set of failed filters, E among them.

    Rows with one text differ in nothing but id, part and labels, so they are folded before they
    meet: a group of copies is a few rows, of whatever size.  Of its rows those with the smallest id
    pass E.  Rows of ``labels`` with one id count together, those without an id not at all.
    """
    alike = decided.groupBy("doc", "print", "part", "flags").agg(F.count("*").alias("docs"))
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(
        F.max((F.col(quality_col) == 1).cast("int")).alias("good"),
        F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"),
    )
    named = alike.hint("merge").join(own.hint("merge"), "doc", "left").fillna(0, ["good", "toxic"])
    # An id stands once in each of these groups.
    copies = named.groupBy("print", "part", "flags", "good", "toxic").agg(
        F.sum("docs").alias("docs"), F.min("doc").alias("least"),
        F.min_by("docs", "doc").alias("at_least"),
    )
    least = copies.groupBy("print").agg(F.min("least").alias("first"))
    both = copies.hint("merge").join(least.hint("merge"), "print")
    passing = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0))
    split = both.select(
        "part", "good", "toxic",
        F.inline(
            F.array(
                F.struct(F.col("flags").alias("flags"), passing.alias("docs")),
                F.struct(F.col("flags").bitwiseOR(F.lit(16)).alias("flags"), (F.col("docs") - passing).alias("docs")),
            )
        ),
    )
    return split.groupBy("part", "flags").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.col("docs") * F.col("good")).alias("good"),
        F.sum(F.col("docs") * F.col("toxic")).alias("toxic"),
    )


def _steps(parts: DataFrame) -> DataFrame:
    """Every step of every order beside each row: filter_order, step, its bit, and those before it."""
    orders = ",".join(map("".join, permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    ahead = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    name = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))

    def bits(letters: Column) -> Column:
        one = [F.when(letters.contains(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)]
        return reduce(Column.__add__, one)

    return steps.withColumn("before", bits(ahead)).withColumn("bit", bits(name))


def interactions(counts: DataFrame) -> DataFrame:
    """Every order of the filters applied to the documents of every part, from ``failure_counts``:
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A document that fails ``k`` filters is removed by each of them in an equal share of all orders, which
    gives ``shapley`` without going through them.
    """
    one = F.struct("flags", "docs", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(one).alias("sets"))  # at most 32 of them
    steps = _steps(parts)
    turns = math.factorial(len(FILTERS))

    def total(amount) -> Column:
        """Sum of an amount over the sets of failed filters."""
        return F.aggregate("sets", F.lit(0).cast("long"), lambda a, x: a + amount(x).cast("long"))

    def where(chosen, amount: str = "docs") -> Column:
        return total(lambda x: F.when(chosen(x["flags"]), x[amount]).otherwise(F.lit(0)))

    def has(flags: Column, some: Column) -> Column:
        return flags.bitwiseAND(some) != 0

    before, own = F.col("before"), F.col("bit")

    def here(flags: Column) -> Column:
        return ~has(flags, before) & has(flags, own)

    def share(x: Column) -> Column:
        orders = (F.lit(turns) / F.bit_count(x["flags"])).cast("long")
        return F.when(has(x["flags"], own), x["docs"] * orders).otherwise(F.lit(0))

    return steps.select(
        "part", "filter_order", "step",
        where(lambda flags: ~has(flags, before.bitwiseOR(own))).alias("kept"),
        where(here).alias("removed"),
        where(lambda flags: has(flags, before) & has(flags, own)).alias("redundant"),
        where(lambda flags: flags == own).alias("unique_fails"),
        where(here, "good").alias("good_lost"),
        where(here, "toxic").alias("toxic_lost"),
        total(share).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """How five filters interact, per part and order of the filters (see ``interactions``).

    Failing means: A under 50 words; B fewer than 65 distinct words in 100; C over 5 capitals A-Z in
    100 code points; D any of ``#$%&*|``; E the text of a row with a smaller id.  A null text is empty, so
    are equal to each other; a null id is the largest, so that one of several rows without an id never
    makes another fail E; a null part is the empty one.  Repeated rows count each, and share
    their id, so none makes the other fail.  An empty table gives an empty table.
    """
    path = scratch(docs.sparkSession, "decided")
    failed_filters(document_term_matrix(docs, id_col, text_col, part_col)).write.parquet(path)
    decided = docs.sparkSession.read.parquet(path)
    return interactions(failure_counts(decided, labels, id_col))
