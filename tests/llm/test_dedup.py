"""The deduplicating operators against brute force, and on awkward rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberlog.llm import lines, ngrams, substring, suffixes
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, doc int, fp string, n_words long, cuts string, key string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def build(spark):
    """A table of documents with other columns whose names clash with ours."""

    def make(rows):
        return spark.createDataFrame([(i, t, 1, "x", 7, None, "k") for i, t in rows], SCHEMA)

    return make


def prose(seed: int, count: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(count))


@pytest.fixture(scope="session")
def awkward():
    """Null, empty and blank texts, exact and near copies, passages inside others, text that repeats
    itself, a very long one, and one without any word."""
    passage, base = prose(1, 80), prose(2, 300)
    near = base.split()
    near[17], near[200] = "changed", "too"
    rows = [
        (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "ONE  two"), (10, "é" * 9), (11, "é" * 10),
        (12, "é" * 10), (20, base), (21, base), (22, " ".join(near)), (23, base.upper()),
        (30, prose(3, 60) + " " + passage + " " + prose(4, 60)), (31, passage),
        (32, prose(5, 10) + "\n" + passage + "\n" + passage + "\n" + prose(6, 5)),
        (40, "ab" * 400), (41, "ab" * 300), (42, "same words again " * 90),
        (50, prose(7, 60000, 100000)), (51, "Line that is shared\n  line THAT is shared \nother line here"),
        (52, "line that is shared\nshort\nshort"), (53, "short\nshort\n"), (54, "\n\n"),
    ]
    rows += [(100 + k, base.replace("w17 ", f"v{k} ")) for k in range(40)]
    return rows


def rows_of(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_lines(documents, plain, build, awkward):
    for table, rows in ((documents, plain), (build(awkward), awkward)):
        found = rows_of(lines.remove_repeated_lines(table), "text", "n_lines", "n_dropped")
        assert found == brute.repeated_lines(rows)


def test_lines_carry_columns(build):
    table = build([(1, "a shared line\nx"), (2, "a shared line\ny")])
    found = lines.remove_repeated_lines(table, carry=("fp", "doc", "cuts"))
    assert found.columns == ["doc_id", "fp", "doc", "cuts", "text", "n_lines", "n_dropped"]
    assert rows_of(found, "fp", "doc", "text") == {1: ("x", 1, "a shared line\nx"), 2: ("x", 1, "y")}


def test_windows(documents, plain, build, awkward):
    for table, rows in ((documents, plain), (build(awkward), awkward)):
        found = rows_of(substring.remove_repeated_windows(table), "text", "n_words", "n_removed")
        assert found == brute.repeated_windows(rows, 50)


@pytest.mark.parametrize("window", [1, 7])
def test_short_windows(build, awkward, window):
    rows = [r for r in awkward if r[0] != 50]
    kept = substring.remove_repeated_windows(build(rows), window=window, width=1 << 15)
    assert rows_of(kept, "text", "n_words", "n_removed") == brute.repeated_windows(rows, window)


def test_strings(documents, plain, build, awkward):
    for table, rows in ((documents, plain), (build(awkward), awkward)):
        found = suffixes.remove_repeated_strings(table)
        got = rows_of(found, "kept", "n_bytes", "n_removed", "n_spans")
        assert {i: (bytes(r[0]), *r[1:]) for i, r in got.items()} == brute.repeated_strings(rows, 100)


def test_a_crowded_filter_loses_nothing(build, awkward):
    """Sketches far too small let everything through, and the answer stays."""
    table = build(awkward)
    found = suffixes.remove_repeated_strings(table, filter_bits=1 << 15)
    got = rows_of(found, "kept", "n_bytes", "n_removed", "n_spans")
    assert {i: (bytes(r[0]), *r[1:]) for i, r in got.items()} == brute.repeated_strings(awkward, 100)
    found = lines.remove_repeated_lines(table, filter_bits=1 << 15)
    assert rows_of(found, "text", "n_lines", "n_dropped") == brute.repeated_lines(awkward)
    found = ngrams.similarity_classes(table, filter_bits=1 << 15, counters=1 << 15)
    got = rows_of(found, "n_shingles", "component_id")
    assert got == brute.similarity_classes(awkward, 5, 80)


@pytest.mark.parametrize(("width", "percent", "often"), [(4, 85, 32), (5, 80, 2), (2, 60, 2), (1, 90, 1)])
def test_similarity_classes(documents, plain, build, awkward, width, percent, often):
    for table, rows in ((documents, plain), (build(awkward), awkward)):
        found = ngrams.similarity_classes(table, width=width, percent=percent, often=often)
        got = rows_of(found, "n_shingles", "component_id")
        assert got == brute.similarity_classes(rows, width, percent)


def test_frequent_tokens_are_combined(build):
    """Texts made of a few common sentences: every token is frequent."""
    draw = random.Random(3)
    parts = [prose(k, 12) for k in range(6)]
    rows = [(k, " ".join(draw.choice(parts) for _ in range(8))) for k in range(150)]
    found = ngrams.similarity_classes(build(rows), width=4, percent=85, often=3)
    got = rows_of(found, "n_shingles", "component_id")
    assert got == brute.similarity_classes(rows, 4, 85)


def test_repeated_rows_and_null_ids(build):
    text = prose(9, 120)
    table = build([(3, text), (3, text), (None, text), (1, "unlike " + prose(10, 70))])
    for found in (
        lines.remove_repeated_lines(table).select("doc_id", F.col("n_dropped").alias("n")),
        substring.remove_repeated_windows(table).select("doc_id", F.col("n_removed").alias("n")),
        suffixes.remove_repeated_strings(table).select("doc_id", F.col("n_removed").alias("n")),
    ):
        got = sorted(((r.doc_id, r.n > 0) for r in found.collect()), key=str)
        assert got == [(1, False), (3, False), (3, False), (None, True)]
    got = sorted(map(tuple, ngrams.similarity_classes(table).select("doc_id", "component_id").collect()), key=str)
    assert got == [(1, 1), (3, 3), (3, 3), (None, 3)]


def test_empty_tables(build):
    empty = build([])
    for operator in (
        lines.remove_repeated_lines,
        substring.remove_repeated_windows,
        suffixes.remove_repeated_strings,
        ngrams.similarity_classes,
    ):
        assert operator(empty).count() == 0
