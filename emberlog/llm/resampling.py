"""Operator 12: importance resampling towards a target, with bit-sliced sums.

Features of a text are hashed to a fixed number of buckets.  A bucket's gain compares how often the
target and the corpus use it, and a document's weight is the mean gain of its features.  Counts and
gains are whole numbers in binary: plane ``j`` of a document holds bit ``j`` of the counts of all
buckets, plane ``k`` of the gains bit ``k`` of all gains, the last one with a negative sign.  The sum of
count times gain is the sum over all pairs of planes of ``2**(j + k)`` for every bit that both have, so
AND and popcount give it without rounding.  The draw is by weight and Gumbel noise from a hash
of the id, without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.text import (
    Chunk,
    bounded_batches,
    chunks,
    id_of,
    null_id,
    separated,
    word_codes,
)
from emberlog.session import scratch

BUCKETS = 10_000
#: Words in the longest feature.
LONGEST = 1
SEED = 2024
#: Percent of the documents with at least so many words that are drawn.
PERCENT, FEWEST_WORDS = 10, 20
#: Documents whose counts are held together.
BLOCK = 64
#: Documents are ranked in ranges of so many ids.
ID_BITS = 20

#: A word is a run of 0-9, a-z (after lower-casing) and everything beyond ASCII.
_WORD = separated(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))


def features(chunk: Chunk, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a chunk, and the number of words per text."""
    codes, words, edges = word_codes(chunk, _WORD, lower=True)
    texts = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    names = words.to_pylist()
    owners, found = [], []
    for size in range(1, min(longest, len(codes)) + 1):
        count = len(codes) - size + 1
        inside = np.flatnonzero(texts[:count] == texts[size - 1 :])
        if size == 1:
            own, kinds = codes, [(i,) for i in range(len(names))]
        else:
            runs = np.stack([codes[inside + k] for k in range(size)], axis=1)
            kinds, own = np.unique(runs, axis=0, return_inverse=True)
            kinds, own = kinds.tolist(), own.ravel()
        hashed = (zlib.crc32(b" ".join([names[i] for i in kind])) % buckets for kind in kinds)
        found.append(np.fromiter(hashed, np.int64, len(kinds))[own])
        owners.append(texts[inside])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *owners]), np.concatenate([none, *found]), np.diff(edges)


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bits 0 … ``bits`` - 1 of every row of whole numbers, as words of 64 (plane, row, word)."""
    wide = np.zeros((len(values), -(-values.shape[1] // 64) * 64), np.int64)
    wide[:, : values.shape[1]] = values
    planes = [np.packbits(((wide >> k) & 1).astype(np.uint8), axis=1) for k in range(bits)]
    return np.stack(planes).view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, what a bit of each plane is worth); the last plane of a two's complement is negative."""
    bits = max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1
    worth = 1 << np.arange(bits, dtype=np.int64)
    worth[-1] = -worth[-1]
    return bit_planes(gains[None, :], bits)[:, 0], worth


def sliced_sums(counts: np.ndarray, planes: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Exact sum over all buckets of count times gain, for every row of ``counts``."""
    total = np.zeros(len(counts), np.int64)
    most = counts.max(axis=1, initial=0)
    for j in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> j)
        own = bit_planes((counts[rows] >> j) & 1, 1)[0]
        for plane, value in zip(planes, worth, strict=True):
            both = np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64)
            total[rows] += (value << j) * both
    return total


def bucket_totals(docs: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: every task sends one row per bucket at
    most, and the driver gets one number per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held += np.bincount(features(chunk, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much more the target uses each bucket, rounded down."""
    of_corpus, of_target = int(corpus.sum()), int(target.sum())
    more = len(corpus)
    return np.array(
        [
            math.floor(
                1000 * math.log(float((t + 1) * (of_corpus + more)) / float((s + 1) * (of_target + more)))
            )
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(
    docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int
) -> DataFrame:
    """(doc, fp, n_words, n_features, weight) for every row, from whole texts."""
    buckets = len(gains)
    planes, worth = gain_planes(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                owner, bucket, words = features(chunk, longest, buckets)
                order = np.argsort(owner, kind="stable")
                owner, bucket = owner[order], bucket[order]
                sums = np.zeros(len(words), np.int64)
                for first in range(0, len(words), BLOCK):
                    rows = min(BLOCK, len(words) - first)
                    a, b = np.searchsorted(owner, [first, first + rows])
                    at = (owner[a:b] - first) * buckets + bucket[a:b]
                    counts = np.bincount(at, minlength=rows * buckets).reshape(rows, buckets)
                    sums[first : first + rows] = sliced_sums(counts, planes, worth)
                many = np.bincount(owner, minlength=len(words))
                part = batch.slice(chunk.first, len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(words.astype(np.int64)),
                        pa.array(many.astype(np.int64)), pa.array(sums // np.maximum(many, 1)),
                    ],
                    names=["doc", "fp", "n_words", "n_features", "weight"],
                )

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_of(id_col).alias("doc"), F.xxhash64(text).alias("fp"), text.alias("text"))
    return rows.mapInArrow(score, "doc long, fp long, n_words long, n_features long, weight long")


def noise(doc: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, fewest: int) -> DataFrame:
    """``scored`` and ``rank``: 1, 2, 3 … for the drawn share of the rows with at least ``fewest``
    words, highest score first, then smallest id; null for all others.

    Scores are whole numbers in a range the gains bound, so the table of how many rows lie above a
    score is small whatever the number of rows.  Rows of one score are numbered in ranges of ids.
    """
    open_ = scored.where(F.col("n_words") >= fewest)
    levels = open_.groupBy("score").agg(F.count("*").alias("rows"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(
        "score",
        F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("above"),
        F.floor(F.sum("rows").over(Window.partitionBy()) * percent / 100).alias("drawn"),
    )
    met = scored.join(F.broadcast(levels), "score", "left").withColumn(
        "inside", (F.col("n_words") >= fewest) & (F.col("above") < F.col("drawn"))
    )
    some = met.where("inside").withColumn("cut", F.shiftright("doc", ID_BITS))
    sizes = some.groupBy("score", "cut").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("score").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("score", "cut", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"))
    order = Window.partitionBy("score", "cut").orderBy("doc", "fp")
    placed = (
        some.withColumn("place", F.row_number().over(order)).hint("merge")
        .join(starts.hint("merge"), ["score", "cut"])
        .withColumn("rank", F.col("above") + F.col("start") + F.col("place"))
    )
    rank = F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank")
    return placed.select(*scored.columns, rank).union(
        met.where("not coalesce(inside, false)").select(*scored.columns, F.lit(None).cast("long"))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    percent: int = PERCENT,
    fewest: int = FEWEST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` as (id_col, n_features, weight, score, rank).

    Features are all runs of 1 to ``longest`` words of the lower-cased (A-Z) text, repeats counted;
    ``weight`` is the floored mean of their gains, 0 without any.  ``score`` adds noise, and ``percent`` of
    the rows with at least ``fewest`` words are ranked by it.  A null text has no words; a null id
    counts as the largest and as an empty one in the hash; rows with equal id and score are ordered by their
    texts.  Repeated rows are rows of their own, other columns are not read.  An empty target or
    table is one without features: gains then follow the other alone.
    """
    spark = docs.sparkSession
    gains = bucket_gains(
        bucket_totals(docs, text_col, longest, buckets),
        bucket_totals(target, target_col, longest, buckets),
    )
    path = scratch(spark, "weights")
    weights = weigh(docs, gains, id_col, text_col, longest)
    weights.withColumn("score", F.col("weight") + noise(null_id("doc"), seed)).write.parquet(path)
    found = ranked(spark.read.parquet(path), percent, fewest)
    return found.select(null_id("doc").alias(id_col), "n_features", "weight", "score", "rank")
