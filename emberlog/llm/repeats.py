"""What the operators on repeated passages share: anchored runs of windows, the
shuffle that brings equal windows together, and cutting the found ranges out.

A window's key is the smallest hash of the short grams inside it, so equal windows have
equal keys, and consecutive windows mostly share one.  A run of windows with one key is
one row of the shuffle; about one row per half window instead of one per window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One run: its key, its row (id and fingerprint), place of the first window, number of
#: windows, and what the windows are compared by.  Without payload it is a range already
#: known to be removed: from ``start``, ``windows`` items long.
RUN = "key long, doc long, fp long, start long, windows long, payload binary"
RANGE = "doc long, fp long, start long, stop long"
_RUN_TYPE = pa.schema(
    [(n, pa.int64()) for n in ("key", "doc", "fp", "start", "windows")]
    + [("payload", pa.binary())]
)
_RANGE_TYPE = pa.schema([(n, pa.int64()) for n in ("doc", "fp", "start", "stop")])


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins."""
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[edges[0] : edges[-1]], (edges - edges[0]).astype(np.int64)


def run_batch(key, doc, fp, start, windows, data: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Rows of RUN; ``sizes`` are the payloads' bytes in ``data``."""
    edges = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=edges[1:])
    payload = pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
    )
    columns = [pa.array(np.asarray(c).astype(np.int64)) for c in (key, doc, fp, start, windows)]
    return pa.RecordBatch.from_arrays([*columns, payload], schema=_RUN_TYPE)


def settled_batch(doc, fp, start, length) -> pa.RecordBatch:
    """Rows of RUN for ranges a map task could already decide; dealt by document."""
    none = np.zeros(len(doc), np.int64)
    return run_batch(doc ^ fp, doc, fp, start, length, np.empty(0, np.uint8), none)


def range_batch(doc, fp, start, stop) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c).astype(np.int64)) for c in (doc, fp, start, stop)]
    return pa.RecordBatch.from_arrays(columns, schema=_RANGE_TYPE)


def resolved(
    rows: DataFrame, decide: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """Bring equal keys together in order of position and let ``decide`` name the removed ranges.

    A key goes to one task, which streams through its sorted rows; what ``decide`` holds of a
    key is its distinct content, so a key with much of that takes one task long and grows it.
    """
    dealt = rows.repartition("key").sortWithinPartitions("key", "doc", "start")
    return dealt.mapInArrow(decide, RANGE)


def passed_on(batch: pa.RecordBatch) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
    """(ranges that were settled before the shuffle, the other rows)."""
    _, edges = payloads(batch.column("payload"))
    known = np.diff(edges) == 0
    if not known.any():
        return None, batch
    doc, fp, start, length = (
        longs(batch.column(n))[known] for n in ("doc", "fp", "start", "windows")
    )
    return range_batch(doc, fp, start, start + length), batch.filter(pa.array(~known))


def with_ranges(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """``texts`` (doc, fp, text) with ``cuts``: the ranges of that very row, null without any.

    The list of a row is bounded by its text's length.
    """
    cuts = ranges.groupBy("doc", "fp").agg(
        F.collect_set(F.struct("start", "stop")).alias("cuts")
    )
    return texts.join(cuts, ["doc", "fp"], "left")


def merged_cuts(cuts: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((c["start"], c["stop"]) for c in cuts or ()):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out
