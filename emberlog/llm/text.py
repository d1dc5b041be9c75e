"""Words, lines and hashes over whole Arrow batches of texts.

A batch is cut into chunks of about a megabyte of whole texts; the work of a chunk
is a few numpy passes over its bytes, so memory follows the chunk (or one very long
text) and never the batch, the partition or the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at a time.
CHUNK_BYTES = 1 << 20
#: Rows without an id count as one document that is larger than any other.
NO_ID = (1 << 63) - 1
#: The white space that separates words: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"
#: The same as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that very long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def id_of(column: str) -> Column:
    """The document id as a long, rows without one sharing the largest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def null_id(column: Column | str) -> Column:
    """The reverse of ``id_of``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NO_ID, column)


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc, fp, text): the id and a fingerprint of the text name a row, so that two
    texts under one id are kept apart and identical rows share one result."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        id_of(id_col).alias("doc"), F.xxhash64(text).alias("fp"), text.alias("text"), *more
    )


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of ``h``."""
    h = h + _U((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of the hash base and of its inverse; each process keeps the usual size."""

    def __init__(self):
        self.held = None

    def __reduce__(self):
        return _Powers, ()

    def __call__(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if self.held is None or len(self.held[0]) < size:
            step = max(size, 2 * CHUNK_BYTES)
            base = np.full(step, _BASE, np.uint64)
            back = np.full(step, pow(_BASE, -1, 1 << 64), np.uint64)
            base[0] = back[0] = 1
            made = np.cumprod(base), np.cumprod(back)
            if size > 2 * CHUNK_BYTES:
                return made[0][:size], made[1][:size]
            self.held = made
        return self.held[0][:size], self.held[1][:size]


powers = _Powers()


@dataclass
class Chunk:
    """Rows ``first`` to ``last`` of a batch: their bytes, and where each text begins."""

    first: int
    last: int
    data: np.ndarray
    edges: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[Chunk]:
    """Whole texts, about ``limit`` bytes and at most ``rows`` at a time; a longer text comes alone."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, edge_buffer, data_buffer = texts.buffers()
    edges = np.frombuffer(edge_buffer, np.int64 if wide else np.int32)
    edges = edges[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(edges, edges[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, len(texts))
        own = edges[first : last + 1]
        yield Chunk(first, last, data[own[0] : own[-1]], own - own[0])
        first = last


def word_hashes(chunk: Chunk, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and per text the place of its first word (one more at the end)."""
    data = chunk.data
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(chunk.edges), np.int64)
    solid = ~_IS_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[chunk.edges] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    begins = np.flatnonzero(solid & (cut[:-1] | ~before))
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (cut[1:] | ~after)) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:-1], out=total[1:])
    hashes = (total[ends] - total[begins]) * down[begins]
    return mix(hashes), np.searchsorted(begins, chunk.edges)


def separated(apart: bytes) -> np.ndarray:
    """Which byte values belong to words when those of ``apart`` separate them."""
    solid = np.ones(256, bool)
    solid[list(apart)] = False
    return solid


#: Bytes of a word that white space ends, as ``WORD`` says.
NOT_BLANK = separated(BLANKS)


def word_codes(
    chunk: Chunk,
    solid: np.ndarray = NOT_BLANK,
    lower: bool = False,
    kinds: np.ndarray | None = None,
) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of every word, the distinct words as bytes, place of each text's first word and one
    more): words are runs of bytes that ``solid`` allows, encoded by a dictionary of the chunk.  With
    ``kinds`` a word also ends between a byte of kind 1 and one of kind 2."""
    data = _LOWER[chunk.data] if lower else chunk.data
    if not len(data):
        return np.empty(0, np.int32), pa.array([], pa.binary()), np.zeros(len(chunk.edges), np.int64)
    own = solid[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[chunk.edges] = True
    if kinds is not None:
        kind = kinds[data]
        cut[1:-1] |= kind[1:] + kind[:-1] * 4 == 6
        cut[1:-1] |= kind[1:] * 4 + kind[:-1] == 6
    begins = np.flatnonzero(own & (cut[:-1] | ~np.append(False, own[:-1])))
    ends = np.flatnonzero(own & (cut[1:] | ~np.append(own[1:], False))) + 1
    edges = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins, out=edges[1:])
    # Without what separates them the words lie one after another, as Arrow holds them.
    buffers = [None, pa.py_buffer(edges), pa.py_buffer(data[own])]
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
    codes = words.indices.to_numpy()
    return codes, words.dictionary, np.searchsorted(begins, chunk.edges)


def spans_of(values: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of ``values[i : i + size]`` for every i that has so many after it."""
    if len(values) < size:
        return np.empty(0, np.uint64)
    factor = pow(_BASE, 2 * seed + 1, 1 << 64)
    block, length = values * _U(factor), 1
    out, done = None, 0
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out, done = block, length
            else:
                count = len(values) - done - length + 1
                out = out[:count] * _U(pow(factor, length, 1 << 64)) + block[done : done + count]
                done += length
        rest >>= 1
        if rest:
            count = len(block) - length
            block = block[:count] * _U(pow(factor, length, 1 << 64)) + block[length : length + count]
            length *= 2
    return mix(out[: len(values) - size + 1], seed)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of ``values[i : i + size]`` for every i that has so many after it."""
    if len(values) < size:
        return np.empty(0, values.dtype)
    best, length = values, 1
    while 2 * length <= size:
        best = np.minimum(best[:-length], best[length:])
        length *= 2
    count = len(values) - size + 1
    return np.minimum(best[:count], best[size - length : size - length + count])


def window_starts(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of ``size`` items of one text begins, and the text of each."""
    counts = np.maximum(np.diff(edges) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return edges[owner] + within, owner


def runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of consecutive starts with equal ``same`` values."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    for values in same:
        new[1:] |= values[1:] != values[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(starts)))


def shingle_sets(
    texts: pa.Array, width: int, lower: bool = True
) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``width``-word shingles) for every text.  A text
    with fewer words has its whole sequence as its only shingle; one without words, none."""
    for chunk in chunks(texts):
        hashes, edges = word_hashes(chunk, lower)
        wide = spans_of(hashes, width)
        for row in range(len(edges) - 1):
            a, b = int(edges[row]), int(edges[row + 1])
            if b - a >= width:
                yield chunk.first + row, np.unique(wide[a : b - width + 1])
            else:
                short = spans_of(hashes[a:b], b - a, width + b - a) if b > a else wide[:0]
                yield chunk.first + row, short
