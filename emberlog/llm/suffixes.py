"""Operator 5: remove repeated byte strings by longest-previous-factor arrays.

Byte windows are brought together by key (see ``repeats``), as segments of consecutive ones.  A task
puts all suffixes of its segments in order; previous and next smaller positions give the
longest previous factors (see ``factors``).  Bytes of a factor that reaches the length asked for
go, the first copy stays.  All windows with the same bytes meet, so it is decided within one
task which factors reach that length; a factor is followed to the end of its segment, and the
next segment goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import repeats as R
from emberlog.llm.factors import SuffixOrder, longest_previous_factors
from emberlog.llm.sketches import SeenTwice, merged, sketch_rows
from emberlog.llm.text import (
    _BYTE,
    Chunk,
    chunks,
    keyed,
    mix,
    null_id,
    powers,
    runs,
    sliding_min,
    window_starts,
)

#: Bytes of the gram whose smallest hash is a window's key.
GRAM_BYTES = 32
#: Bytes of distinct segments put in order together.
RANK_BYTES = 1 << 20
#: A segment with more windows is cut, so few rounds of doubling reach its end.
SEGMENT_WINDOWS = 512


def _windows(chunk: Chunk, size: int):
    """Window starts, their texts and keys, and the hashes of all grams."""
    starts, owner = window_starts(chunk.edges, size)
    if not len(starts):
        return starts, owner, np.empty(0, np.uint64), np.empty(0, np.uint64)
    gram = min(GRAM_BYTES, size)
    up, down = powers(len(chunk.data) + 1)
    total = np.zeros(len(chunk.data) + 1, np.uint64)
    np.cumsum(_BYTE[chunk.data] * up[:-1], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: len(total) - gram])
    return starts, owner, sliding_min(grams, size - gram + 1)[starts], grams


def _met_keys(chunk: Chunk, size: int) -> np.ndarray:
    """The key of every run, and again if its gram occurs twice in the run: in text that
    repeats itself closely one run may hold equal windows."""
    starts, owner, key, grams = _windows(chunk, size)
    begin, length = runs(starts, owner, key)
    if not len(begin):
        return key
    inside = np.arange(size - min(GRAM_BYTES, size) + 1)
    leftmost = grams[starts[begin][:, None] + inside].argmin(axis=1) + starts[begin]
    last = starts[begin + length - 1] + inside[-1]
    rightmost = last - grams[last[:, None] - inside].argmin(axis=1)
    return np.append(key[begin], key[begin[leftmost != rightmost]])


def _pieces(begin: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs, those with more than ``most`` windows cut."""
    count = -(-length // most)
    skip = most * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return np.repeat(begin, count) + skip, np.minimum(np.repeat(length, count) - skip, most)


def _repeating(data: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """The segments that hold a window whose hash occurs again; only these can share ``size`` bytes."""
    at, row = window_starts(edges, size)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    windows = (total[at + size] - total[at]) * down[at]
    order = np.argsort(windows)
    windows = windows[order]
    same = windows[1:] == windows[:-1]
    found = np.zeros(len(edges) - 1, bool)
    found[row[order[1:][same]]] = found[row[order[:-1][same]]] = True
    return np.flatnonzero(found)


class _Segments:
    """Distinct segments held until they are put in order together; those that hold the first
    occurrence of a window of the last key stay for its later rows."""

    def __init__(self, size: int):
        self.size = size
        self.rows: list[tuple] = []  # (key, doc, fp, start, bytes, already decided)
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.bytes = self.carried = 0
        self.key: int | None = None

    def full(self) -> bool:
        """Enough new bytes to be worth ordering what is carried again."""
        return self.bytes >= max(RANK_BYTES, self.carried)

    def add(self, key, doc, fp, start, segment: bytes) -> tuple | None:
        """A removed range if the whole segment occurred before."""
        if key != self.key:
            self.key, self.seen = key, {}
        earlier = self.seen.setdefault(segment, (doc, start))
        if earlier != (doc, start):
            return doc, fp, start, start + len(segment)
        self.rows.append((key, doc, fp, start, segment, False))
        self.bytes += len(segment)
        return None

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        size, rows = self.size, self.rows
        edges = np.append(0, np.cumsum([len(r[4]) for r in rows]))
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        again = _repeating(data, edges, size).tolist()
        # Every window of the other segments is the only one of its kind, so they lead and lose nothing.
        leading = set(range(len(rows))).difference(again)
        known, rows = rows, [rows[i] for i in again]
        edges = np.append(0, np.cumsum([len(r[4]) for r in rows], dtype=np.int64))
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        doc, fp, start = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        at, row = window_starts(edges, size)
        place = start[row] + at - edges[row]
        begin = at[:0]
        if rows:
            factor, leads = longest_previous_factors(SuffixOrder(data, edges, size), at, doc[row], place)
            leading.update(again[i] for i in np.unique(row[leads]).tolist())
            done = np.array([r[5] for r in rows])
            found = (factor >= size) & ~done[row]
            begin, count = runs(at[found], row[found])
        stay = [(*r[:5], True) for i, r in enumerate(known) if r[0] == self.key and i in leading]
        self.rows, self.bytes = stay, 0
        self.carried = sum(len(r[4]) for r in stay)
        self.seen = {r[4]: (r[1], r[3]) for r in stay}
        if not len(begin):
            return None
        rows_of, stop = row[found][begin], (place + factor)[found][begin + count - 1]
        return R.range_batch(doc[rows_of], fp[rows_of], place[found][begin], stop)


def _decide(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Removed byte ranges from segments sorted by key and position."""
    held = _Segments(size)
    for whole in batches:
        known, batch = R.passed_on(whole)
        if known is not None:
            yield known
        gone = []
        columns = [batch.column(n).to_pylist() for n in ("key", "doc", "fp", "start", "payload")]
        for row in zip(*columns, strict=True):
            if (cut := held.add(*row)) is not None:
                gone.append(cut)
            if held.full():
                if (cuts := held.flush()) is not None:
                    yield cuts
        if gone:
            yield R.range_batch(*np.array(gone, np.int64).T)
    if (cuts := held.flush()) is not None:
        yield cuts


def _emit_chunk(chunk: Chunk, ids, prints, test: SeenTwice, twice, size: int):
    """Segments of a chunk whose key was seen twice.  Equal segments of one chunk leave it
    once: the others are settled here."""
    starts, owner, key, _ = _windows(chunk, size)
    begin, length = runs(starts, owner, key)
    if not len(begin):
        return
    chosen = test.test(twice, key[begin])
    begin, length = _pieces(begin[chosen], length[chosen], max(size, SEGMENT_WINDOWS))
    if not len(begin):
        return
    at, row = starts[begin], owner[begin]
    doc, fp = ids[chunk.first + row], prints[chunk.first + row]
    place, stop = at - chunk.edges[row], at + length + size - 1
    order = np.lexsort((place, doc))
    seen: dict[bytes, int] = {}
    sent, settled = [], []
    whole = chunk.data.tobytes()
    for i in order.tolist():
        j = seen.setdefault(whole[at[i] : stop[i]], i)
        if j == i or (doc[j] == doc[i] and place[j] == place[i]):
            sent.append(i)
        else:
            settled.append(i)
    if settled:
        i = np.array(settled)
        yield R.settled_batch(doc[i], fp[i], place[i], (stop - at)[i])
    i = np.array(sent)
    data = np.frombuffer(b"".join(whole[at[k] : stop[k]] for k in sent), np.uint8)
    yield R.run_batch(
        key[begin][i].view(np.int64), doc[i], fp[i], place[i], length[i], data, (stop - at)[i]
    )


def remove_repeated_strings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    filter_bits: int = 1 << 28,
) -> DataFrame:
    """Drop every byte covered by a string of ``length`` bytes that also starts earlier, in a
    smaller document or before in the same one; matches are judged on the input and may
    overlap.

    Returns per row ``id_col, kept, n_bytes, n_removed, n_spans``; ``kept`` is binary, since a
    cut may fall inside a character, and a span is a maximal run of removed bytes.  Other
    columns of ``docs`` are not read, whatever their names.  A null text is empty; a null id
    counts as the largest id.  Rows with one id are one document, where an equal start is
    not earlier, so identical rows get identical results.  An empty table gives an empty
    table.  ``filter_bits`` is the size of the filter for windows seen once; a larger one
    lets fewer of them into the shuffle and changes no result.
    """
    texts = keyed(docs, id_col, text_col)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for chunk in chunks(batch.column(0)):
            yield _met_keys(chunk, length)

    def sketch() -> SeenTwice:
        return SeenTwice(filter_bits)

    twice = merged(sketch_rows(texts.select("text"), sketch, keys), sketch(), filter_bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sketch()
        for batch in batches:
            ids, prints = R.longs(batch.column(0)), R.longs(batch.column(1))
            for chunk in chunks(batch.column(2)):
                yield from _emit_chunk(chunk, ids, prints, test, twice.value, length)

    found = R.resolved(
        texts.mapInArrow(emit, R.RUN), lambda batches: _decide(batches, length)
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch["text"], batch["cuts"].to_pylist(), strict=True):
                data, spans, kept, last = text.as_buffer().to_pybytes(), R.merged_cuts(cuts), [], 0
                for start, stop in spans:
                    kept.append(data[last:start])
                    last = stop
                kept.append(data[last:])
                left = b"".join(kept)
                out.append((left, len(data), len(data) - len(left), len(spans)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"],
                    pa.array([r[0] for r in out], pa.binary()),
                    *(pa.array([r[i] for r in out], pa.int64()) for i in (1, 2, 3)),
                ],
                names=["doc", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    done = R.with_ranges(texts, found).mapInArrow(
        rewrite, "doc long, kept binary, n_bytes long, n_removed long, n_spans long"
    )
    return done.select(
        null_id("doc").alias(id_col), "kept", "n_bytes", "n_removed", "n_spans"
    )


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The kept bytes as a SHA-256 in lower-case hex."""
    return df.select(
        id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
