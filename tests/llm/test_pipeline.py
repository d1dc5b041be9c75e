"""The pipeline stage by stage against brute force."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from emberlog.session import scratch
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


def test_names():
    names = contract.queries()
    assert "pipeline" in names
    for number in range(1, 14):
        assert len([n for n in names if n.startswith(f"op{number}_")]) == 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame(
        [(90001, None, None, None, None), (90002, "12 - 34", "en", "src1", 7), (90003, "", "fr", "a", 0)],
        docs.schema,
    )
    before = docs.union(extra)
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "stage")
        stage(spark, before, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        texts = [(r.doc_id, r.text) for r in before.collect()]
        kept = {r.doc_id for r in after.collect()}
        if name != "mix":
            assert after.columns == docs.columns
        if name == "language":
            assert kept == {i for i, t in texts if i < 90001}
        elif name == "lines":
            wanted = {i: t[0] for i, t in brute.repeated_lines(texts).items()}
            assert {r.doc_id: r.text for r in after.collect()} == wanted
            assert all(r.n_chars == len(r.text) for r in after.collect())
            others = ["doc_id", "lang", "source"]
            assert sorted(after.select(others).collect()) == sorted(before.select(others).collect())
        elif name == "similar":
            wanted = brute.similarity_classes(texts, 5, 80)
            assert kept == {i for i, v in wanted.items() if v[1] == i}
        elif name == "benchmark":
            assert kept == {i for i, _ in texts} - {d for d, _ in brute.contained_items(texts, items)}
        else:
            sizes, taken = defaultdict(int), defaultdict(int)
            source = {r.doc_id: r.source for r in before.collect()}
            for r in after.collect():
                sizes[source[r.doc_id]] += r["size"]
                taken[source[r.doc_id]] += r.taken
            for s, goal in brute.targets(sizes).items():
                assert abs(taken[s] - goal) <= 128
        before = after


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert rows.where(F.col("taken") > 2 * F.col("size")).count() == 0
    total = rows.agg(F.sum("taken"), F.sum("size")).first()
    assert total[0] == pytest.approx(1.5 * total[1], rel=0.02)
