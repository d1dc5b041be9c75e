"""Suffix order and longest previous factors against brute force."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm.factors import SuffixOrder, _smaller_before, longest_previous_factors
from emberlog.llm.suffixes import _pieces
from emberlog.llm.text import window_starts

BYTES = st.one_of(st.text("ab\0", max_size=60).map(str.encode), st.binary(max_size=40))
PART = st.tuples(st.integers(1, 4), st.integers(0, 30), BYTES)


def shared(one: bytes, two: bytes) -> int:
    count = 0
    while count < min(len(one), len(two)) and one[count] == two[count]:
        count += 1
    return count


def joined(parts):
    edges = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), edges


@given(st.lists(BYTES, max_size=6), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_suffixes_are_in_order(parts, size):
    data, edges = joined(parts)
    order = SuffixOrder(data, edges, size)
    ends = np.repeat(edges[1:], np.diff(edges))
    suffixes = [data[k : ends[k]].tobytes() for k in range(len(data))]
    places = {suffix: 1 + at for at, suffix in reversed(list(enumerate(sorted(suffixes))))}
    assert order.rank.tolist() == [places[suffix] for suffix in suffixes]


@given(st.lists(PART, max_size=7), st.integers(1, 20))
@settings(max_examples=400, deadline=None)
def test_longest_previous_factors(parts, size):
    parts += parts[:1]  # a repeated row is not earlier than itself
    data, edges = joined([p[2] for p in parts])
    at, row = window_starts(edges, size)
    doc, begin = (np.array([p[i] for p in parts], np.int64) for i in (0, 1))
    doc, place = doc[row], begin[row] + at - edges[row]
    factor, leads = longest_previous_factors(SuffixOrder(data, edges, size), at, doc, place)
    suffixes = [data[a : edges[r + 1]].tobytes() for a, r in zip(at, row, strict=True)]
    where = list(zip(doc.tolist(), place.tolist(), strict=True))
    kept = {}
    for i, suffix in enumerate(suffixes):
        longest = max([shared(suffix, suffixes[j]) for j in range(len(at)) if where[j] < where[i]], default=0)
        assert factor[i] == (longest if longest >= size else 0)
        kept.setdefault(suffix[:size], []).append((where[i], bool(leads[i])))
    for same in kept.values():  # one window of each kind stays, at its first place
        assert [w for w, lead in same if lead] == [min(w for w, _ in same)]


@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 12))
def test_nearest_smaller_values(values, width):
    floor = [at // width * width for at in range(len(values))]
    found = _smaller_before(np.array(values, np.int64), np.array(floor, np.int64)).tolist()
    for at, value in enumerate(values):
        smaller = [k for k in range(floor[at], at) if values[k] < value]
        assert found[at] == (smaller[-1] if smaller else -1)


def test_long_runs_are_cut_without_gaps():
    begin, length = _pieces(np.array([3, 50]), np.array([10, 4]), 4)
    assert list(zip(begin.tolist(), length.tolist())) == [(3, 4), (7, 4), (11, 2), (50, 4)]
    assert [len(x) for x in _pieces(np.empty(0, np.int64), np.empty(0, np.int64), 4)] == [0, 0]


def test_long_shared_beginnings_are_passed_by_ranks():
    """A shared beginning of thousands of bytes takes steps of the depth, not of single heads."""
    one = bytes(random.Random(4).choices(b"abcd", k=6000))
    data = np.frombuffer(one + b"x" + one + b"y" + one[:5000], np.uint8)
    edges = np.array([0, 6001, 12002, 17002])
    order = SuffixOrder(data, edges, 100)
    read, heads = [], order.heads
    order.heads = type("Noted", (), {"__getitem__": lambda _, at: read.append(len(at)) or heads[at]})()
    places = np.array([0, 700, 5900]), np.array([6001, 6701, 11901])
    assert order.shared(*places).tolist() == [6000, 5300, 100]
    assert order.shared(np.array([0, 20]), np.array([12002, 12022])).tolist() == [5000, 4980]
    assert sum(read) < 200
