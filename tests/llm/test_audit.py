"""Filter interactions against applying every order to every document."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from emberlog.llm import audit

SCHEMA = "doc_id long, text string, source string, doc string, part int, print int, flags string"
LABELS = "doc_id long, quality int, toxic int, docs int"


def failing(rows):
    first = {}
    for i, text, _ in rows:
        key = text or ""
        value = float("inf") if i is None else i
        first[key] = min(first.get(key, value), value)
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield i, part or "", {
            letter
            for letter, bad in zip(
                "ABCDE",
                (
                    len(words) < 50, 100 * len(set(words)) < 65 * len(words),
                    100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                    bool(re.search(r"[#$%&*|]", text)), (float("inf") if i is None else i) > first[text],
                ),
                strict=True,
            )
            if bad
        }


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = list(failing(rows))
    out, shapley = {}, defaultdict(int)
    for part in {p for _, p, _ in docs}:
        own = [(i, bad) for i, p, bad in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                fails = sum(f in bad for _, bad in own)
                only = sum(bad == {f} for _, bad in own)
                lost = [sum(i in some for i, _ in gone) for some in (good, toxic)]
                out[part, order, step] = (len(kept), len(gone), fails - len(gone), only, *lost)
                shapley[part, f] += len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(found):
    rows = found.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    wanted = brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert as_dict(audit.audit(docs, labels)) == wanted


def odd_rows():
    draw = random.Random(6)
    pool = ["alpha", "Beta", "ÄPFEL", "x#y", "你好", "GAMMA", "w|", "tail"]
    prose = lambda n, kinds: " ".join(draw.choice(pool[:kinds] + [f"w{draw.randrange(90)}"] * kinds) for _ in range(n))
    rows = [(k, prose(draw.randrange(120), draw.randrange(1, 8)), draw.choice("ab")) for k in range(60)]
    same = prose(70, 3)
    rows += [(100 + k, same, "ab"[k % 2]) for k in range(40)]
    rows += [(99, same, None), (99, same, None), (99, same, "b"), (None, same, "a"), (None, "lonely", "a"), (None, "lonely", "b")]
    rows += [(200, None, None), (201, "", ""), (202, " \n", "only"), (198, None, "a"), (-7, "A" * 30_000 + " b" * 40_000, "long")]
    return draw.sample(rows, len(rows))


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", 700)
    monkeypatch.setattr(audit, "SHARD_ROWS", 5)


def test_odd_rows(spark, small_shards):
    rows = odd_rows()
    labels = [(99, 1, 0, 5), (99, 0, 1, 5), (3, 1, 1, 5), (None, 1, 1, 5), (100, None, 1, 5), (7777, 1, 1, 5)]
    docs = spark.createDataFrame([(*r, "d", 1, 2, "f") for r in rows], SCHEMA).repartition(3)
    found = audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert as_dict(found) == brute(rows, [l[:3] for l in labels])


def test_matrix_is_that_of_the_words(spark, small_shards):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "d", 1, 2, "f") for r in rows], SCHEMA).repartition(4)
    counts = []
    for r in audit.document_term_matrix(docs).collect():
        pointers, places, amounts = audit.unpack(bytes(r.matrix), len(r.docs), r.n_entries)
        terms = np.array(r.terms, np.int64)[places]
        for k, d in enumerate(r.docs):
            own = slice(pointers[k], pointers[k + 1])
            counts.append((d.part, dict(zip(terms[own].tolist(), amounts[own].tolist(), strict=True))))
    assert len(counts) == len(rows)
    names = sorted({t for _, c in counts for t in c})
    assert names == list(range(len(names)))  # numbered without gaps
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    assert len(names) == len({w for ws in words for w in ws})
    for part in {p or "" for _, _, p in rows}:
        got = sorted(sorted(c.values()) for p, c in counts if p == part)
        wanted = sorted(
            sorted(ws.count(w) for w in set(ws))
            for ws, (_, _, p) in zip(words, rows, strict=True) if (p or "") == part
        )
        assert got == wanted
    total = defaultdict(int)
    for _, c in counts:
        for term, n in c.items():
            total[term] += n
    flat = [w for ws in words for w in ws]
    assert sorted(total.values()) == sorted(flat.count(w) for w in set(flat))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert audit.audit(none, spark.createDataFrame([], LABELS)).collect() == []
    one = spark.createDataFrame([(1, "x", None, "", 0, 0, "")], SCHEMA)
    assert len(as_dict(audit.audit(one, spark.createDataFrame([], LABELS)))) == 600
