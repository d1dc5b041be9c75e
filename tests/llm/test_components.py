"""Components by rounds, and by one task where few links are left."""

from __future__ import annotations

import random

import pytest

from emberlog.llm import components as module
from tests.llm.brute import Union


@pytest.mark.parametrize("limit", [5, 40, 1 << 19])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "FOREST_LINKS", limit)
    draw = random.Random(limit)
    links = [(draw.randrange(300) * 7, draw.randrange(300) * 7) for _ in range(220)]
    links += [(10_000 + k, 10_001 + k) for k in range(60)]  # a chain
    links += [(20_000, 20_000 + k) for k in range(1, 50)]  # a star
    links += [(5, 5), (None, 3), (4, None), (1 << 40, -3), (1 << 40, -3)]
    union = Union({x for pair in links for x in pair if x is not None})
    for a, b in links:
        if a is not None and b is not None:
            union.join(a, b)
    table = spark.createDataFrame(links, "a long, b long").repartition(6)
    found = [tuple(r) for r in module.components(table).collect()]
    met = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert sorted(found) == sorted((x, union.find(x)) for x in met)
    assert module.components(table.limit(0)).collect() == []
