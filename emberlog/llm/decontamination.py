"""Operator 3: benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so documents are
first reduced to the shingles that some benchmark item may hold (a Bloom filter of fixed
size); that changes no containment.  The reduced sets are partitioned by size.  In a partition the
largest size turns the wanted containment into a Jaccard similarity, and that into the number of
MinHash values that must be looked up so that a miss is as rare as asked for.  Where too many
would be needed, the partition is looked up by its shingles themselves, which misses nothing.
Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.sketches import SeenTwice, merged, sketch_rows
from emberlog.llm.text import keyed, mix, null_id, shingle_sets
from emberlog.session import scratch

#: Chance that one item is missed in one document, at most.
MISS = 1e-6
#: MinHash values per set; a partition that needs more is looked up by shingles.
MOST_HASHES = 64


def hashes_needed(items: int, largest: int, percent: int, miss: float = MISS) -> int | None:
    """MinHash values to look up for items of up to ``items`` shingles in sets of up to
    ``largest``; None if more than there are."""
    common = -(-percent * items // 100)
    jaccard = common / (items + largest - common)
    if jaccard >= 1:
        return 1
    count = math.ceil(math.log(miss) / math.log(1 - jaccard))
    return count if count <= MOST_HASHES else None


def size_class(size: int) -> int:
    """Sets of 2**(k-1)+1 to 2**k shingles are partition ``k``."""
    return (size - 1).bit_length()


def least_hashes(tokens: np.ndarray, count: int) -> np.ndarray:
    """The smallest of each of ``count`` hash functions over a set, marked with its number."""
    return np.array([mix(tokens, 101 + k).min() for k in range(count)], np.uint64) ^ mix(
        np.arange(count, dtype=np.uint64), 99
    )


def _document_keys(tokens: np.ndarray) -> list[tuple[int, int]]:
    """(partition, key) that a document is found by: MinHash values, and its shingles."""
    part = size_class(len(tokens))
    values = np.concatenate([least_hashes(tokens, MOST_HASHES), mix(tokens, 98)])
    return [(part, v) for v in values.view(np.int64).tolist()]


def _item_keys(tokens: np.ndarray, percent: int, parts: int) -> list[tuple[int, int]]:
    """(partition, key) that an item looks up, in every partition that can hold it."""
    common = -(-percent * len(tokens) // 100)
    least = least_hashes(tokens, MOST_HASHES).view(np.int64).tolist()
    # Any ``size - common + 1`` shingles of the item include one that the document holds.
    some = mix(tokens[: len(tokens) - common + 1], 98).view(np.int64).tolist()
    out = []
    for part in range(size_class(common), parts):
        need = hashes_needed(len(tokens), 1 << part, percent)
        out += [(part, v) for v in (some if need is None else least[:need])]
    return out


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    filter_bits: int = 1 << 24,
) -> DataFrame:
    """Every document and benchmark item with at least ``percent`` of the item's shingles in
    the document: ``id_col, item_col, n_common, n_item``.

    Shingles are ``width`` consecutive words, A-Z lower-cased; a text with fewer words has its whole
    sequence as its only one, so such an item is found only in a text of the same words.  Null
    texts and texts without words hold nothing and are found nowhere.  Texts under one id, or
    without one, are documents (or items) of their own; rows repeating an id and its text are one.
    Other columns are not read, whatever their names; with an empty table on either side the result
    is empty.  A larger filter lets fewer other shingles through and changes no result.
    """
    found = row_items(
        docs, items, id_col, text_col, item_col, item_text_col, width, percent, filter_bits
    )
    return found.select(
        null_id("doc").alias(id_col), null_id("item").alias(item_col), "n_common", "n_item"
    )


def row_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    filter_bits: int = 1 << 24,
) -> DataFrame:
    """``contained_items`` by the names that ``keyed`` gives rows: ``doc, fp, item, item_fp,
    n_common, n_item``."""
    spark = docs.sparkSession
    schema = "id long, fp long, tokens array<long>"

    def sets(table: DataFrame, id_name: str, text: str, wanted=None) -> DataFrame:
        """(id, fp, tokens): distinct shingles per text, only the ``wanted`` ones."""
        test = SeenTwice(filter_bits)

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for row, tokens in shingle_sets(batch.column(2), width):
                    if wanted is not None and len(tokens):
                        tokens = tokens[test.test(wanted.value, tokens)]
                    if len(tokens):
                        rows.append(row)
                        found.append(tokens.view(np.int64))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(found, pa.list_(pa.int64()))],
                    names=["id", "fp", "tokens"],
                )

        texts = keyed(table, id_name, text)
        return texts.mapInArrow(shingle, schema).dropDuplicates(["id", "fp"])

    path = scratch(spark, "items")
    sets(items, item_col, item_text_col).write.parquet(path)
    asked = spark.read.schema(schema).parquet(path)

    def twice(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        tokens = batch.column(0).flatten().to_numpy().astype(np.int64).view(np.uint64)
        yield np.concatenate([tokens, tokens])  # seen at all is what counts here

    def sketch() -> SeenTwice:
        return SeenTwice(filter_bits)

    wanted = merged(sketch_rows(asked.select("tokens"), sketch, twice), sketch(), filter_bits)
    path = scratch(spark, "reduced")
    sets(docs, id_col, text_col, wanted).write.parquet(path)
    held = spark.read.schema(schema).parquet(path)
    largest = held.agg(F.max(F.size("tokens"))).first()[0] or 1
    parts = size_class(largest) + 1

    def keys(table: DataFrame, make) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, prints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(batch.num_rows):
                    tokens = batch.column(2)[at].values.to_numpy().astype(np.int64).view(np.uint64)
                    rows = make(tokens)
                    part, key = np.array(rows, np.int64).reshape(-1, 2).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), v, np.int64)) for v in (ids[at], prints[at])]
                        + [pa.array(part), pa.array(key)],
                        names=["id", "fp", "part", "key"],
                    )

        return table.mapInArrow(emit, "id long, fp long, part long, key long")

    lookups = keys(asked, lambda t: _item_keys(t, percent, parts)).toDF("item", "item_fp", "part", "key")
    stored = keys(held, _document_keys).toDF("doc", "fp", "part", "key")
    pair = ["doc", "fp", "item", "item_fp"]
    candidates = stored.join(lookups, ["part", "key"]).select(*pair).distinct()
    both = candidates.join(held.toDF("doc", "fp", "has"), ["doc", "fp"]).join(
        asked.toDF("item", "item_fp", "wants"), ["item", "item_fp"]
    )
    common = F.size(F.array_intersect("wants", "has"))
    return both.select(
        *pair, common.cast("long").alias("n_common"), F.size("wants").cast("long").alias("n_item")
    ).where(F.col("n_common") * 100 >= F.col("n_item") * percent)
