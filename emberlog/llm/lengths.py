"""Operator 6: exact token counts from a histogram of encoded lengths.

Every whole document is encoded by a public tokenizer; documents are aggregated by length.
Sums over all larger lengths then answer, for every context limit at once, how many documents
fit, how many tokens there are in total and how many are left after truncation.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.text import bounded_batches
from emberlog.session import scratch

#: Where the vocabulary files of public tokenizers lie; read, never copied.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How a byte-level vocabulary of this kind cuts a text before merging (a fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths are summed in groups of so many, then the groups: no task holds all lengths.
LENGTH_GROUP = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank from a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoded_lengths(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = ""
) -> DataFrame:
    """(id_col, tokens): the number of tokens of every whole text; a null text has none."""
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding(
            "ranks", pat_str=PIECES, mergeable_ranks=ranks.value, special_tokens={}
        )
        for batch in batches:
            sizes = np.fromiter(
                (len(coder.encode_ordinary(t)) for t in batch.column(1).to_pylist()),
                np.int64,
                batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes)], names=["row", "tokens"]
            )

    texts = docs.select(
        F.struct(id_col).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kind = texts.schema["row"].dataType.simpleString()
    done = texts.mapInArrow(count, f"row {kind}, tokens long")
    return done.select(F.col(f"row.`{id_col}`"), "tokens")


def length_report(lengths: DataFrame) -> DataFrame:
    """From (…, tokens): one row per length that occurs, with

    ``n_docs, n_tokens``          documents of exactly this length and their tokens
    ``docs_above, tokens_above``  those longer than it
    ``docs_within, quantile``     documents up to this length, and their share of all
    ``truncated_tokens``          tokens left if every document is cut at this length

    A limit between two lengths is answered from the row below it (``truncated_total``).
    Only the histogram is summed over, in groups of lengths.  Empty in, empty out; a null
    length is left out.
    """
    spark = lengths.sparkSession
    path = scratch(spark, "histogram")  # summed over twice, made once
    found = lengths.where("tokens is not null").groupBy("tokens").agg(F.count("*").alias("n_docs"))
    found.write.parquet(path)
    table = spark.read.schema(found.schema).parquet(path)
    table = table.withColumn("n_tokens", F.col("tokens") * F.col("n_docs")).withColumn(
        "part", F.floor(F.col("tokens") / LENGTH_GROUP)
    )
    behind = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(
        F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("toks")
    )
    whole = Window.partitionBy()
    parts = parts.select(
        "part",
        F.coalesce(F.sum("docs").over(behind), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("toks").over(behind), F.lit(0)).alias("toks_after"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("toks").over(whole).alias("all_tokens"),
    )
    above = Window.partitionBy("part").orderBy(F.desc("tokens")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = table.join(parts, "part").select(
        "tokens", "n_docs", "n_tokens", "all_docs", "all_tokens",
        (F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("docs_after")).alias("docs_above"),
        (F.coalesce(F.sum("n_tokens").over(above), F.lit(0)) + F.col("toks_after")).alias("tokens_above"),
    )
    within = F.col("all_docs") - F.col("docs_above")
    return summed.select(
        "tokens", "n_docs", "n_tokens", "docs_above", "tokens_above",
        within.alias("docs_within"), (within / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - F.col("tokens_above") + F.col("docs_above") * F.col("tokens")).alias(
            "truncated_tokens"
        ),
    )


def truncated_total(report: DataFrame, limit: int) -> DataFrame:
    """One row (n_docs, n_tokens, truncated_tokens): all tokens, and those left at a context
    limit, from the histogram alone."""
    kept = F.least(F.col("tokens"), F.lit(limit)) * F.col("n_docs")
    return report.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("truncated_tokens"),
    )
