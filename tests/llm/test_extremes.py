"""Extreme numbers, long digit runs, repeated and missing ids, clashing columns, spread slots."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import language, mixing, pii, pivots
from tests.llm.test_rows import prose

SF_DIR = "/root/testdata/sf0.001"


def test_vectors_of_any_size(spark):
    rows = [
        (1, [1e-200, 2e-200], 0), (2, [2e-200, 1e-200], 0), (3, [1e200, 2e200], 0), (4, [1e200, 2.0000001e200], 0),
        (5, [1.0, 2.0], 0), (6, [5e-324, 0.0], 1), (7, [1e308, 1e308], 1), (8, [1e-308, 1e-308], 1), (9, [1e308, 0.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table).collect()}
    assert found == {
        1: (3, 1), 3: (3, 1), 4: (3, 1), 5: (3, 1), 2: (0, 2), 6: (1, 6), 9: (1, 6), 7: (1, 7), 8: (1, 7),
    }


def test_long_numbers_in_addresses():
    for part, valid in (("0" * 5000, True), ("0" * 5000 + "255", True), ("0" * 5000 + "256", False), ("9" * 5000, False)):
        text = f"x {part}.1.1.1 y"
        assert pii.base_spans(text) == ([("ip", 2, len(text) - 2)] if valid else [])


@pytest.mark.parametrize("rows", [20, 2000])
def test_training_rows_without_ids_or_with_one(spark, rows):
    texts = [(("the house and " if k % 2 else "das Haus und ") + prose(k, 5), "en" if k % 2 else "de") for k in range(rows)]
    for name in (None, 1):  # 1 is not held out
        docs = spark.createDataFrame([(name, t, g) for t, g in texts], "doc_id long, text string, lang string")
        for most in (1, 25):
            model = language.train(docs, rows_per_language=most)
            assert model.languages == ["de", "en"]
        found = language.identify(docs, model).groupBy("lang_pred").count().collect()
        assert {r.lang_pred for r in found} <= {"de", "en"}
    same = spark.createDataFrame([(1, "the house", "en")] * rows, "doc_id long, text string, lang string")
    assert language.train(same, rows_per_language=1).languages == ["en"]


def test_training_rows_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "Model", lambda rows, names: seen.append(names))
    docs = spark.range(3000).selectExpr(
        "id as doc_id", "concat('word ', id) as text", "if(id % 5 = 0, 'a', 'b') as lang"
    )
    language.train(docs, rows_per_language=40)
    names = seen[0]
    assert len(names) == 80 and names.count("a") == 40
    language.train(docs, rows_per_language=40)
    assert seen[1] == names


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _fp int, _row int, row string, doc int, fp int, key int, bag map<string,int>"


def test_stages_with_clashing_columns(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    texts = [(1, "the house " + prose(1)), (2, "the house " + prose(1)), (2, "the house " + prose(1)), (3, prose(3) + " " + item), (4, "und " + prose(4))]
    texts += [(k, "the house und " + prose(k)) for k in range(10, 14)] + [(None, prose(50)), (None, prose(50)), (None, None)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "d", 1, 2, "r", 3, 4, 5, {"x": 1}) for i, t in texts], CLASHING
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        ids = sorted((r.doc_id for r in kept.collect()), key=str)
        if name == "similar":
            assert ids == sorted([1, 3, 4, 10, 11, 12, 13, None, None], key=str)
        elif name == "benchmark":
            assert 3 not in ids and len(ids) == len(texts) - 1
        else:
            assert len(ids) == len(texts) - (name == "language")
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    assert corpus_pipeline.mixed(spark, docs, SF_DIR).count() == len(texts)
    assert corpus_pipeline.mixed(spark, docs.limit(0), SF_DIR).count() == 0


def test_slots_are_dealt_to_all_tasks(spark):
    wanted = spark.createDataFrame([("a", 640_000_000, 640_000_000.0)], "source string, source_size long, target double")
    made = mixing.slots(wanted, 64, 1 << 20, 7)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000_000
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 1.5 * np.median(sizes)


def test_taken_is_what_the_mix_takes(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    mixed = mixing.mix(docs, shard_words=4096).groupBy("doc_id").agg(
        F.sum("words").alias("taken"), F.min("shard").alias("first")
    )
    wanted = {r.doc_id: (r.taken, r.first) for r in mixed.collect()}
    found = mixing.taken_words(docs, shard_words=4096).collect()
    assert {r.doc_id: (r.taken, r.first_shard) for r in found if r.taken} == wanted
    assert len({r.first_shard for r in found}) > 2
