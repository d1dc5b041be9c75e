"""What the similarity join ships of sets, and how often."""

from __future__ import annotations

import numpy as np

from emberlog.llm import ngrams
from emberlog.llm.text import mix


def test_bitmaps_are_small_and_still_tell_sets_apart():
    for n in (100, 300, 1000):
        one, two = (mix(np.arange(n, dtype=np.uint64), seed) for seed in (1, 2))
        bits = [ngrams.parity(x) for x in (one, two)]
        assert max(8 * len(x) for x in bits) <= 4 * n + 128
        far = ngrams.apart(*(y for x in bits for y in (int.from_bytes(x, "little"), 8 * len(x))))
        assert far > 3 * ngrams.most_different(n, n, 85)


def test_bitmaps_of_pairs_are_compared_once(spark, monkeypatch):
    """Pairs that were compared in their lists are not joined with bitmaps again."""
    calls, own = [], ngrams._close_bitmaps
    monkeypatch.setattr(ngrams, "_close_bitmaps", lambda *a: calls.append(1) or own(*a))
    base = [f"w{k}" for k in range(200)]
    # Centres of the lists are unlike, later rows near each other: they are found after the stars.
    rows = [(0, " ".join(base[:20] + [f"x{k}" for k in range(180)]))]
    rows += [(1, " ".join(base)), (2, " ".join(base[:-2] + ["y", "z"])), (3, " ".join(base))]
    found = ngrams.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), often=1)
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 1, 2: 1, 3: 1}
    assert len(calls) == 1
