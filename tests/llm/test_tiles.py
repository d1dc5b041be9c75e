"""No long list of the n-gram join is held whole."""

from __future__ import annotations

import random
from itertools import combinations

from emberlog.llm import ngrams
from tests.llm import brute


def test_cells_of_a_long_list(spark, monkeypatch):
    """A family of one component, a few strays and many single documents share a list."""
    monkeypatch.setattr(ngrams, "TILE", 16)
    draw = random.Random(1)
    rows = [(1, k, k % 3, 100, k, 7) for k in range(300)]  # in one list, one component of 300
    rows += [(1, 1000 + k, 0, draw.randrange(40, 200), 1000 + k, 1000 + k // 2) for k in range(90)]
    rows += [(2, k, 0, 50, k, k % 2) for k in range(10)] + [(3, k, 0, 50, k, 5) for k in range(100)]
    placed = spark.createDataFrame(rows, "sig long, doc long, fp long, n long, node long, component long")
    cells: dict = {}
    for r in ngrams._cells(placed, 80).collect():
        cells.setdefault((r.sig, r.cell), []).append(r)
    assert {sig for sig, _ in cells} == {1, 2} and [len(v) for (s, _), v in cells.items() if s == 2] == [10]
    assert max(len(v) for v in cells.values()) <= 64
    met = []
    for own in cells.values():
        for x, y in combinations(own, 2):
            if x.component != y.component and (x.half is None or x.half != y.half):
                met.append((x.sig, *sorted([x.doc, y.doc])))
    assert len(met) == len(set(met))
    wanted = {
        (x[0], *sorted([x[1], y[1]]))
        for x, y in combinations(rows, 2)
        if x[0] == y[0] and x[5] != y[5] and 100 * min(x[3], y[3]) >= 80 * max(x[3], y[3])
    }
    assert wanted <= set(met)


def test_tiled_lists_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "TILE", 4)
    draw = random.Random(3)
    parts = [" ".join(f"w{draw.randrange(400)}" for _ in range(12)) for _ in range(6)]
    rows = [(k, " ".join(draw.choice(parts) for _ in range(draw.randrange(7, 10)))) for k in range(120)]
    base = " ".join(draw.choice(parts) for _ in range(12))
    rows += [(200 + k, f"{base} v{k}") for k in range(40)]
    found = ngrams.similarity_classes(
        spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85, often=3
    )
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute.similarity_classes(rows, 4, 85)
