"""Operator 8: remove repeated word windows, found through a count-min prefilter.

Pass one: every partition counts the keys of its windows in a count-min sketch; the
sketches are merged, so an estimate is never below the number of windows with that key.
Pass two: only windows whose key is estimated as repeated leave their partition, where
they are grouped exactly by a 128-bit hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm import repeats as R
from emberlog.llm.sketches import CountMin, merged, sketch_rows
from emberlog.llm.text import (
    Chunk,
    chunks,
    keyed,
    null_id,
    runs,
    sliding_min,
    spans_of,
    window_starts,
    word_hashes,
)

#: Words of the gram whose smallest hash is a window's key.
GRAM_WORDS = 10


def _windows(chunk: Chunk, size: int):
    """Word hashes, text edges, window starts, their texts, their keys."""
    hashes, edges = word_hashes(chunk, lower=False)
    starts, owner = window_starts(edges, size)
    gram = min(GRAM_WORDS, size)
    least = sliding_min(spans_of(hashes, gram), size - gram + 1)
    return hashes, edges, starts, owner, least[starts] if len(starts) else np.empty(0, np.uint64)


def _first_of_class(doc: np.ndarray, one: np.ndarray, two: np.ndarray):
    """(order by class and document, is a row the first of its class, smallest document of
    the class), the latter two in that order."""
    order = np.lexsort((doc, two, one))
    first = np.ones(len(order), bool)
    first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    least = doc[order][first][np.cumsum(first) - 1]
    return order, first, least


def _repeated_in_smaller(doc: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Does the same window also occur in a smaller document of these?"""
    order, _, least = _first_of_class(doc, one, two)
    found = np.zeros(len(doc), bool)
    found[order] = doc[order] > least
    return found


def _decide(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Removed word ranges from runs sorted by key and document."""
    held = None  # of the last key: its windows' hashes and smallest documents
    for whole in batches:
        known, batch = R.passed_on(whole)
        if known is not None:
            yield known
        if not batch.num_rows:
            continue
        key, doc, fp, start, count = (R.longs(batch.column(i)) for i in range(5))
        data, _ = R.payloads(batch.column(5))
        pairs = data.view(np.uint64).reshape(-1, 2)
        row = np.repeat(np.arange(len(key)), count)
        place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        one, two, owner, of_key = pairs[:, 0], pairs[:, 1], doc[row], key[row]
        before = 0
        if held is not None and held[0] == key[0]:
            before = len(held[1])
            one, two = np.append(held[1], one), np.append(held[2], two)
            owner = np.append(held[3], owner)
            of_key = np.append(np.full(before, key[0]), of_key)
        order, first, least = _first_of_class(owner, one, two)
        gone = np.zeros(len(owner), bool)
        gone[order] = owner[order] > least
        keep = order[first]
        keep = keep[of_key[keep] == key[-1]]
        held = (key[-1], one[keep], two[keep], owner[keep])
        gone = gone[before:]
        begin, length = runs(place[gone], row[gone])
        if len(begin):
            rows, at = row[gone][begin], place[gone][begin]
            yield R.range_batch(doc[rows], fp[rows], at, at + length + size - 1)




def remove_repeated_windows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    width: int = 1 << 25,
    depth: int = 2,
) -> DataFrame:
    """Drop every word covered by a window of ``window`` words that also starts in a document
    with a smaller id; all windows are judged on the input.

    Returns per row ``id_col, text, n_words, n_removed``; ``text`` is the kept words joined by
    one space.  Other columns of ``docs`` are not read, whatever their names.  A null text
    has no words; a null id counts as the largest id, and rows with one id as one document,
    whose texts never remove each other.  Identical rows get identical results.  An empty
    table gives an empty table.  The sketch has ``depth`` rows of ``width`` counters; a
    larger one lets fewer unrepeated windows into the shuffle and changes no result.
    """
    texts = keyed(docs, id_col, text_col)

    def sketch() -> CountMin:
        return CountMin(width, depth, 2)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for chunk in chunks(batch.column(0)):
            _, _, starts, owner, key = _windows(chunk, window)
            yield key[runs(starts, owner, key)[0]]

    counted = sketch_rows(texts.select("text"), sketch, keys)
    often = merged(counted, sketch(), width * depth)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sketch()
        for batch in batches:
            ids, prints = R.longs(batch.column(0)), R.longs(batch.column(1))
            for chunk in chunks(batch.column(2)):
                yield from _emit_chunk(chunk, ids, prints, test, often.value, window)

    found = R.resolved(
        texts.mapInArrow(emit, R.RUN), lambda batches: _decide(batches, window)
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed = [], [], []
            for text, cuts in zip(batch["text"], batch["cuts"].to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                whole = len(words)
                for start, stop in reversed(R.merged_cuts(cuts)):
                    del words[start:stop]
                kept.append(b" ".join(words))
                sizes.append(whole)
                removed.append(whole - len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"],
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                ],
                names=["doc", "text", "n_words", "n_removed"],
            )

    done = R.with_ranges(texts, found).mapInArrow(
        rewrite, "doc long, text string, n_words long, n_removed long"
    )
    return done.select(null_id("doc").alias(id_col), "text", "n_words", "n_removed")


def _emit_chunk(chunk: Chunk, ids, prints, test: CountMin, often, size: int):
    """Runs of a chunk whose key is estimated as repeated.  A window found in a smaller
    document of the same chunk is settled here, so that a very common passage leaves the
    chunk once."""
    hashes, edges, starts, owner, key = _windows(chunk, size)
    if not len(starts):
        return
    begin, length = runs(starts, owner, key)
    chosen = np.repeat(test.test(often, key[begin]), length)
    starts, owner, key = starts[chosen], owner[chosen], key[chosen]
    if not len(starts):
        return
    one, two = (spans_of(hashes, size, seed)[starts] for seed in (2, 3))
    doc, fp = ids[chunk.first + owner], prints[chunk.first + owner]
    place = starts - edges[owner]
    gone = _repeated_in_smaller(doc, one, two)
    begin, length = runs(starts[gone], owner[gone])
    if len(begin):
        yield R.settled_batch(
            doc[gone][begin], fp[gone][begin], place[gone][begin], length + size - 1
        )
    left = ~gone
    begin, length = runs(starts[left], owner[left], key[left])
    if len(begin):
        pairs = np.stack([one[left], two[left]], axis=1)
        yield R.run_batch(
            key[left][begin].view(np.int64),
            doc[left][begin],
            fp[left][begin],
            place[left][begin],
            length,
            pairs.view(np.uint8),
            length * 16,
        )
