"""Importance resampling against plain sums."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import resampling

SCHEMA = "doc_id long, text string, score string, rank string, fp int, cut int"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, longest, count):
    words = WORD.findall((text or "").encode().lower())
    runs = [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % count for r in runs]


def brute(docs, target, longest=1, count=10_000, percent=10, fewest=20):
    s = Counter(b for _, t in docs for b in buckets(t, longest, count)[1])
    t = Counter(b for x in target for b in buckets(x, longest, count)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        more = (t[b] + 1) * (all_s + count) / ((s[b] + 1) * (all_t + count))
        return math.floor(1000 * math.log(more))

    out = []
    for i, text in docs:
        words, own = buckets(text, longest, count)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, words])
    order = sorted((r for r in out if r[5] >= fewest), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("bits", [1, 3, 11])
def test_sliced_sums(bits):
    draw = np.random.default_rng(bits)
    gains = draw.integers(-(1 << bits), (1 << bits) + 1, 777)
    counts = draw.integers(0, 2, (70, 777)) * draw.integers(0, 5000, (70, 777))
    counts[5] = 0
    planes, worth = resampling.gain_planes(gains)
    assert (resampling.sliced_sums(counts, planes, worth) == counts @ gains).all()


def test_no_gains():
    planes, worth = resampling.gain_planes(np.zeros(70, np.int64))
    assert resampling.sliced_sums(np.ones((2, 70), np.int64), planes, worth).tolist() == [0, 0]


@pytest.mark.parametrize("longest", [1, 2])
def test_documents(spark, longest):
    read = lambda name, key: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(key, "text")
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    found = resampling.resample(docs, items, longest=longest, percent=35)
    wanted = brute([tuple(r) for r in docs.collect()], [r.text for r in items.collect()], longest, percent=35)
    assert rows(found) == wanted


def test_ties_nulls_and_odd_texts(spark):
    draw = random.Random(4)
    prose = lambda n: " ".join(draw.choice(["Apfel", "bär", "c3", "D-e", "你好"]) for _ in range(n))
    docs = [(k, prose(draw.randrange(60))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, "--- !!"), (903, "a" * 5000 + " " + "b " * 40_000), (None, prose(30)), (None, None)]
    docs += [docs[7], docs[7], (1 << 40, prose(25)), (-3, prose(25))]
    table = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in draw.sample(docs, len(docs))], SCHEMA)
    target = spark.createDataFrame([("c3 c3 bÄr",), (None,)], "text string")
    found = resampling.resample(table, target, percent=90)
    assert rows(found) == brute(docs, ["c3 c3 bÄr", None], percent=90)


def test_ranks_of_equal_scores(spark):
    table = spark.createDataFrame(
        [(i, 0, 30, k, 5 - i % 2) for k, i in enumerate([*range(50), 3 << 20, 5 << 20, -1])],
        "doc long, fp long, n_words long, n_features long, score long",
    )
    found = resampling.ranked(table.repartition(5), 60, 20).where("rank is not null").orderBy("rank").collect()
    order = sorted((r for r in table.collect()), key=lambda r: (-r.score, r.doc))
    assert [r.doc for r in found] == [r.doc for r in order][: 60 * len(order) // 100]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, none).collect() == []
    some = spark.createDataFrame([(1, "one two", "", "", 0, 0)], SCHEMA)
    assert rows(resampling.resample(some, none)) == brute([(1, "one two")], [])
