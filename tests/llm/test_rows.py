"""Rows without an id, and unlike rows under one id, are rows of their own."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from emberlog.llm import decontamination, ngrams, pivots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)

    return make


def prose(seed: int, count: int = 120) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(count))


def left(df) -> list:
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_benchmark_takes_only_the_row_that_holds_an_item(spark, corpus, tmp_path):
    item = prose(1, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    half = item.split()
    rows = [
        (None, prose(2) + " " + item), (None, prose(3)), (None, " ".join(half[:17]) + " " + prose(4)),
        (None, prose(5) + " " + " ".join(half[13:])), (7, prose(6)), (7, item), (8, prose(7)),
    ]
    kept = corpus_pipeline.no_benchmark(spark, corpus(rows), str(tmp_path))
    assert left(kept) == sorted((rows[k] for k in (1, 2, 3, 4, 6)), key=str)


def test_items_without_an_id_are_not_added_up(spark, corpus):
    one, two = prose(11, 40), prose(12, 40)
    items = spark.createDataFrame([(None, one), (None, two), (3, two), (3, "other " + one)], "item_id long, text string")
    docs = corpus([(5, prose(13) + " " + one), (6, prose(14))])
    found = sorted(map(tuple, decontamination.contained_items(docs, items).collect()), key=str)
    assert found == [(5, 3, 36, 37), (5, None, 36, 36)]


def test_similar_takes_only_rows_that_are_close(spark, corpus):
    a, b, same, alone = prose(21), prose(22), prose(23), prose(24)
    rows = [
        (5, a), (None, a + " more"), (None, b + " more"), (9, b), (None, alone), (None, same), (None, same),
        (None, "\n"), (None, "\n"), (2, prose(25)), (2, prose(26)), (3, prose(25) + " more"), (4, prose(27)), (4, prose(27)),
    ]
    kept = corpus_pipeline.one_of_similar(spark, corpus(rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left(kept) == sorted((rows[k] for k in (0, 3, 4, 5, 7, 8, 9, 10, 12)), key=str)
    found = ngrams.similarity_classes(corpus(rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(5, 5), (None, 5), (None, 9), (9, 9), (2, 2), (2, 2), (3, 2), (4, 4), (4, 4)] + [(None, None)] * 5, key=str
    )


def test_vectors_without_an_id(spark):
    draw = np.random.default_rng(31)
    x, y, z = draw.standard_normal((3, 24))
    near = [(v + 0.01 * draw.standard_normal(24)).tolist() for v in (x, y)]
    rows = [
        (5, x.tolist(), 1), (None, near[0], 1), (None, near[1], 1), (9, y.tolist(), 1), (None, z.tolist(), 1),
        (None, (z + 0.01 * draw.standard_normal(24)).tolist(), 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(map(tuple, pivots.near_duplicates(table).collect()), key=str)
    assert found == sorted(
        [(5, 1, 5, True), (None, 1, 5, False), (None, 1, 9, False), (9, 1, 9, True)]
        + [(None, 1, None, True), (None, 1, None, False)], key=str
    )
