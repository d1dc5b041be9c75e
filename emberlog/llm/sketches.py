"""Sketches of fixed size that every partition builds for itself and Spark merges.

A partition sends only the blocks it touched, compressed; blocks are dealt to tasks by
number and folded one after another, so a merging task holds its share of the sketch and
nothing that grows with the data.  What is broadcast afterwards is one bit per cell,
a size set by a parameter.  A sketch that is too small for its input lets more through;
it never loses a repeated value, and all its users confirm exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from emberlog.llm.text import mix

_U = np.uint64
BLOCK = 1 << 15


def _pack(array: np.ndarray) -> bytes:
    return zlib.compress(array.tobytes(), 1)


def _unpack(data: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype).copy()


class SeenTwice:
    """Two Bloom filters: hashes seen at least once, and hashes seen at least twice."""

    schema = "block int, once binary, twice binary"

    def __init__(self, bits: int, hashes: int = 2):
        self.bits, self.hashes = bits, hashes
        self.once = self.twice = None

    def places(self, values: np.ndarray) -> np.ndarray:
        """One row of bit numbers per hash function."""
        return np.stack([mix(values, 11 + k) % _U(self.bits) for k in range(self.hashes)])

    def add(self, values: np.ndarray) -> None:
        if self.once is None:
            self.once = np.zeros(self.bits // 8, np.uint8)
            self.twice = np.zeros(self.bits // 8, np.uint8)
        for place in self.places(values):
            place, count = np.unique(place, return_counts=True)
            byte, bit = place >> _U(3), (np.uint8(1) << (place & _U(7)).astype(np.uint8))
            again = (count > 1) | ((self.once[byte] & bit) > 0)
            for plane, chosen in ((self.twice, again), (self.once, slice(None))):
                at, bits = byte[chosen], bit[chosen]
                if len(at):
                    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    plane[at[first]] |= np.bitwise_or.reduceat(bits, first)

    def blocks(self) -> Iterator[dict]:
        size = BLOCK // 8
        if self.once is None:
            return
        for block in np.flatnonzero(self.once.reshape(-1, size).any(axis=1)):
            part = slice(block * size, (block + 1) * size)
            yield {
                "block": int(block),
                "once": _pack(self.once[part]),
                "twice": _pack(self.twice[part]),
            }

    @staticmethod
    def fold(state: list[np.ndarray] | None, row: dict) -> list[np.ndarray]:
        once, twice = _unpack(row["once"]), _unpack(row["twice"])
        if state is None:
            return [once, twice]
        state[1] |= twice | (state[0] & once)
        state[0] |= once
        return state

    @staticmethod
    def bitmap(state: list[np.ndarray]) -> np.ndarray:
        return state[1]

    def test(self, bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
        """True for every value that may have been seen twice; never False for one that was."""
        found = np.ones(len(values), bool)
        for place in self.places(values):
            found &= (bitmap[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        return found


class CountMin:
    """Counters in ``depth`` rows, up to 255; the smallest of a value's counters is never
    below its count.  ``test`` says whether that estimate reaches ``threshold``."""

    schema = "block int, counts binary"

    def __init__(self, width: int, depth: int, threshold: int):
        self.width, self.depth, self.threshold = width, depth, threshold
        self.counts = None

    def places(self, values: np.ndarray) -> np.ndarray:
        """One row of cell numbers per row of the sketch."""
        return np.stack(
            [mix(values, 31 + k) % _U(self.width) + _U(k * self.width) for k in range(self.depth)]
        )

    def add(self, values: np.ndarray) -> None:
        if self.counts is None:
            self.counts = np.zeros(self.width * self.depth, np.uint8)
        for place in self.places(values):
            place, count = np.unique(place, return_counts=True)
            self.counts[place] = np.minimum(self.counts[place] + count, 255)

    def blocks(self) -> Iterator[dict]:
        if self.counts is None:
            return
        table = self.counts.reshape(-1, BLOCK)
        for block in np.flatnonzero(table.any(axis=1)):
            yield {"block": int(block), "counts": _pack(table[block])}

    @staticmethod
    def fold(state: np.ndarray | None, row: dict) -> np.ndarray:
        counts = _unpack(row["counts"])
        if state is None:
            return counts
        return np.minimum(state.astype(np.uint16) + counts, 255).astype(np.uint8)

    def bitmap(self, state: np.ndarray) -> np.ndarray:
        return np.packbits(state >= self.threshold, bitorder="little")

    def test(self, bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for place in self.places(values):
            found &= (bitmap[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        return found


class Classes:
    """Which values occur once, and which more than ``often`` times: both sketches in one."""

    schema = SeenTwice.schema

    def __init__(self, bits: int, width: int, often: int):
        self.bits = bits
        self.seen, self.counts = SeenTwice(bits), CountMin(width, 2, min(often + 1, 255))
        self.cells = bits + 2 * width

    def add(self, values: np.ndarray) -> None:
        self.seen.add(values)
        self.counts.add(values)

    def blocks(self) -> Iterator[dict]:
        yield from self.seen.blocks()
        for row in self.counts.blocks():
            yield {"block": row["block"] + self.bits // BLOCK, "once": row["counts"], "twice": None}

    @staticmethod
    def fold(state, row: dict):
        if row["twice"] is None:
            return CountMin.fold(state, {"counts": row["once"]})
        return SeenTwice.fold(state, row)

    def bitmap(self, state) -> np.ndarray:
        return state[1] if isinstance(state, list) else self.counts.bitmap(state)

    def of(self, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurs once, is frequent)."""
        once = ~self.seen.test(table[: self.bits // 8], values)
        frequent = np.zeros(len(values), bool)
        left = np.flatnonzero(~once)
        frequent[left] = self.counts.test(table[self.bits // 8 :], values[left])
        return once, frequent


def to_batches(
    rows: Iterable[dict], schema: pa.Schema, size: int = 256
) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class _Inflated:
    """Pickled compressed; bytes once it is read."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return zlib.decompress, (self.data,)


class _Bitmap:
    """Held and sent compressed, an array where it is read: the driver never has it whole.  Reading needs
    nothing of this package."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return np.frombuffer, (_Inflated(self.data), "uint8")


def _joined(blocks: dict[int, bytes], count: int) -> bytes:
    """One compressed stream of ``count`` blocks, those that are missing without a bit; takes the blocks."""
    out, none, parts = zlib.compressobj(1), bytes(BLOCK // 8), []
    for k in range(count):
        own = blocks.pop(k, None)
        parts.append(out.compress(none if own is None else zlib.decompress(own)))
    parts.append(out.flush())
    return b"".join(parts)


def merged(
    rows: DataFrame, sketch: SeenTwice | CountMin | Classes, cells: int, deal: str = "block"
) -> Broadcast:
    """Merge the partitions' blocks and broadcast one bit per cell (``cells`` / 8 bytes)."""
    spark = rows.sparkSession
    fold, bitmap = sketch.fold, sketch.bitmap
    out = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for batch in batches:
            for row in batch.to_pylist():
                states[row["block"]] = fold(states.get(row["block"]), row)
        yield from to_batches(
            ({"block": k, "bits": _pack(bitmap(v))} for k, v in states.items()), out
        )

    folded = rows.repartition(deal).mapInArrow(merge, "block int, bits binary")
    blocks = {row.block: bytes(row.bits) for row in folded.collect()}  # at most the sketch, compressed
    return spark.sparkContext.broadcast(_Bitmap(_joined(blocks, cells // BLOCK)))


def sketch_rows(
    docs: DataFrame,
    make: Callable[[], SeenTwice | CountMin | Classes],
    values: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
) -> DataFrame:
    """One sketch per partition of ``docs``, as its touched blocks; ``values`` gives the
    hashes of a batch, a chunk at a time."""
    sketch = make()
    schema = {
        "once": pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
        "counts": pa.schema([("block", pa.int32()), ("counts", pa.binary())]),
    }["once" if "once" in sketch.schema else "counts"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            for some in values(batch):
                if len(some):
                    own.add(some)
        yield from to_batches(own.blocks(), schema)

    return docs.mapInArrow(build, sketch.schema)


def members(rows: DataFrame, bits: int) -> Callable[[DataFrame, str], DataFrame]:
    """A filter that keeps, of any table, the rows whose long column may be among the values of
    the only column of ``rows``: a Bloom filter of ``bits`` bits, broadcast."""

    def sketch() -> SeenTwice:
        return SeenTwice(bits)

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        own = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        yield np.concatenate([own, own])  # to be seen at all is enough here

    found = merged(sketch_rows(rows, sketch, values), sketch(), bits)

    def keep(table: DataFrame, column: str) -> DataFrame:
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = sketch()
            for batch in batches:
                own = batch[column].to_numpy().astype(np.int64).view(np.uint64)
                yield batch.filter(pa.array(test.test(found.value, own)))

        return table.mapInArrow(chosen, table.schema)

    return keep
