"""Operator 10: remove lines that an earlier document holds, found through two Bloom filters.

Every partition puts the lines it meets into a filter of lines seen once and, on meeting
one again, into a filter of lines seen twice; merging two partitions also moves what is in
both first filters to the second.  Only lines in the merged second filter leave their
partition; they are confirmed exactly by a 128-bit hash and the smallest document kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from emberlog.llm.sketches import SeenTwice, merged, sketch_rows
from emberlog.llm.text import BLANKS, CHUNK_BYTES, keyed, null_id
from emberlog.session import scratch

#: A shorter key never counts as repeated.
KEY_CHARS = 10


def line_keys(text: bytes, shortest: int = KEY_CHARS) -> list[bytes | None]:
    """One key per line: stripped and lower-cased (A-Z); None if it is too short to count."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip(BLANKS)
        short = len(key) < shortest or (
            len(key) < 4 * shortest and len(key.decode("utf-8", "replace")) < shortest
        )
        out.append(None if short else key)
    return out


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for value in batch[column]:
        yield value.as_buffer().to_pybytes()


def suspected_lines(texts: DataFrame, shortest: int, filter_bits: int) -> DataFrame:
    """(doc, fp, at, key): the lines that two documents may share, ``key`` a 128-bit hash."""

    def sketch() -> SeenTwice:
        return SeenTwice(filter_bits)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, size = [], 0
        for text in _texts(batch, "text"):
            held += {xxh3_64_intdigest(k) for k in line_keys(text, shortest) if k is not None}
            size += len(text)
            if size > 4 * CHUNK_BYTES:
                yield np.array(held, np.uint64)
                held, size = [], 0
        yield np.array(held, np.uint64)

    twice = merged(sketch_rows(texts.select("text"), sketch, hashes), sketch(), filter_bits)
    out = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("at", pa.int64()), ("key", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sketch()
        for batch in batches:
            rows, at, keys, chosen = [], [], [], []
            for row, text in enumerate(_texts(batch, "text")):
                for i, key in enumerate(line_keys(text, shortest)):
                    if key is not None:
                        rows.append(row)
                        at.append(i)
                        keys.append(key)
                        chosen.append(xxh3_64_intdigest(key))
            if not keys:
                continue
            hit = np.flatnonzero(test.test(twice.value, np.array(chosen, np.uint64)))
            row = pa.array(np.array(rows, np.int64)[hit])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"].take(row),
                    batch["fp"].take(row),
                    pa.array(np.array(at, np.int64)[hit]),
                    pa.array([blake2b(keys[i], digest_size=16).digest() for i in hit], pa.binary()),
                ],
                schema=out,
            )

    return texts.mapInArrow(emit, "doc long, fp long, at long, key binary")


def remove_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = KEY_CHARS,
    filter_bits: int = 1 << 27,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Drop every line whose key occurs in a document with a smaller id.

    The key is the line without white space at its ends and with A-Z lower-cased; keys
    below ``shortest`` code points never count.  In the smallest document all lines with the key
    stay, repeats included.  Returns per row ``id_col, text, n_lines, n_dropped`` and
    the columns of ``docs`` named in ``carry``.  Other columns are not read, whatever their names.  A null or empty text is one empty line; a null id counts as the largest id, and rows with
    one id are one document.  Identical rows get identical results; an empty table gives
    an empty table.  A larger filter (``filter_bits``) lets fewer unrepeated lines into the
    shuffle and changes no result.
    """
    spark = docs.sparkSession
    texts = keyed(docs, id_col, text_col)
    path = scratch(spark, "lines")
    suspected_lines(texts, shortest, filter_bits).write.parquet(path)
    lines = spark.read.parquet(path)
    path = scratch(spark, "firsts")
    lines.groupBy("key").agg(F.min("doc").alias("least")).write.parquet(path)
    firsts = spark.read.parquet(path)
    # Both sides come from tables, so adaptive execution can split a very common line.
    later = lines.join(firsts, "key").where(F.col("doc") > F.col("least"))
    drops = later.groupBy("doc", "fp").agg(F.collect_set("at").alias("drops"))
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("boolean")
    whole = keyed(docs, id_col, text_col, carried.alias("carried"))
    kind = whole.schema["carried"].dataType.simpleString()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, dropped = [], [], []
            for text, drops in zip(_texts(batch, "text"), batch["drops"].to_pylist(), strict=True):
                counts.append(text.count(b"\n") + 1)
                dropped.append(len(drops or ()))
                if drops:
                    gone = set(drops)
                    lines = text.split(b"\n")
                    text = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"],
                    batch["carried"],
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(dropped, pa.int64()),
                ],
                names=["doc", "carried", "text", "n_lines", "n_dropped"],
            )

    done = whole.join(drops, ["doc", "fp"], "left").mapInArrow(
        rewrite, f"doc long, carried {kind}, text string, n_lines long, n_dropped long"
    )
    return done.select(
        null_id("doc").alias(id_col),
        *(F.col(f"carried.`{c}`").alias(c) for c in carry),
        "text",
        "n_lines",
        "n_dropped",
    )
