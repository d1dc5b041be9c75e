"""Chunks, word hashes, windows and sketches against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import text as T
from emberlog.llm.components import _forest
from emberlog.llm.sketches import CountMin, SeenTwice

TEXTS = st.lists(st.text(alphabet="aB é\n\t\x0b.", max_size=30) | st.none(), max_size=12)


@given(TEXTS, st.integers(1, 40), st.booleans())
@settings(max_examples=200, deadline=None)
def test_words_are_hashed_alike(texts, limit, lower):
    seen: dict[bytes, int] = {}
    row = 0
    for chunk in T.chunks(pa.array(texts, pa.string()), limit):
        assert chunk.first == row
        hashes, edges = T.word_hashes(chunk, lower)
        for at in range(chunk.last - chunk.first):
            data = (texts[row] or "").encode()
            words = (data.lower() if lower else data).split()
            own = hashes[edges[at] : edges[at + 1]].tolist()
            assert len(own) == len(words)
            for word, value in zip(words, own, strict=True):
                assert seen.setdefault(word, value) == value
            row += 1
    assert row == len(texts)
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_spans_and_minima(values, size):
    array = np.array(values, np.uint64)
    spans = T.spans_of(array, size).tolist()
    wanted = [tuple(values[k : k + size]) for k in range(len(values) - size + 1)]
    assert len(spans) == len(wanted)
    assert len(set(zip(spans, wanted, strict=True))) == len(set(wanted)) == len(set(spans))
    assert T.sliding_min(array, size).tolist() == [min(w) for w in wanted]


@given(st.lists(st.lists(st.integers(0, 200), max_size=40), max_size=4))
@settings(max_examples=100, deadline=None)
def test_merged_sketches_never_lose_a_repeat(parts):
    for make in (lambda: SeenTwice(1 << 15), lambda: CountMin(1 << 15, 2, 2)):
        states, total = {}, make()
        for part in parts:
            own = make()
            if part:
                own.add(np.array(part, np.uint64))
            for row in own.blocks():
                states[row["block"]] = own.fold(states.get(row["block"]), row)
        cells = 1 << 15 if isinstance(total, SeenTwice) else 1 << 16
        bits = np.zeros(cells // 8, np.uint8)
        for block, state in states.items():
            bits[block << 12 : (block + 1) << 12] = total.bitmap(state)
        flat = [v for part in parts for v in part]
        again = np.array(sorted({v for v in flat if flat.count(v) > 1}), np.uint64)
        once = np.array(sorted({v for v in flat if flat.count(v) == 1}), np.uint64)
        assert total.test(bits, again).all()
        assert total.test(bits, once).sum() <= 2  # few cells are shared at this size


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_forest(links):
    up = {x: x for link in links for x in link}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    low, high = _forest(*np.array(links, np.int64).T)
    wanted = {x: find(x) for x in up if find(x) != x}
    assert dict(zip(high.tolist(), low.tolist(), strict=True)) == wanted
