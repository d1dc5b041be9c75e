"""Which segments are put in order."""

from __future__ import annotations

import random

from emberlog.llm import suffixes


def test_segments_without_a_repeated_window_are_not_ordered(monkeypatch):
    ordered, own = [], suffixes.SuffixOrder
    monkeypatch.setattr(
        suffixes, "SuffixOrder", lambda data, edges, size: ordered.append(len(data)) or own(data, edges, size)
    )
    draw = random.Random(3)
    gram = draw.randbytes(32)  # what their key stands for
    single = [draw.randbytes(90) + gram + draw.randbytes(90) for _ in range(20)]
    held = suffixes._Segments(100)
    for k, segment in enumerate(single):
        assert held.add(7, k, 0, 10, segment) is None
    assert held.flush() is None and not ordered
    assert len(held.rows) == 20  # first occurrences stay for later rows of the key
    copy = single[4][20:150]
    assert held.add(7, 30, 0, 5, copy + b"end") is None
    cuts = held.flush().to_pylist()
    assert cuts == [{"doc": 30, "fp": 0, "start": 5, "stop": 5 + len(copy)}]
    assert ordered == [len(single[4]) + len(copy) + 3]
