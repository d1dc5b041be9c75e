"""From raw documents to a mix of sources: five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``, the last one the
mix.  Stages are written to the shared folder as Parquet and read again, so a lost executor or
a driver that starts over costs one stage.  Null texts and empty ones: a document without a letter
is rejected by the first stage; one that the second stage empties stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontamination, language, lines, mixing, ngrams
from emberlog.llm.sketches import members
from emberlog.llm.text import id_of
from emberlog.session import scratch


def _whole(docs: DataFrame) -> DataFrame:
    """(row, doc, fp): every row as one column, beside which no name can clash."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    return docs.select(row.alias("row"), id_of("doc_id").alias("doc"), _print().alias("fp"))


def _rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``rows`` (doc, fp), or are not."""
    named = rows.select("doc", "fp").distinct()
    return _whole(docs).join(named, ["doc", "fp"], how).select("row.*")


def _print() -> Column:
    """The fingerprint that ``text.keyed`` gives a text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` becomes the language told.  Rejected are
    those without a text or a letter."""
    found = language.identify(docs, language.train(docs), keep=True)
    told = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; ``n_chars`` follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = lines.remove_repeated_lines(docs, carry=others)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar shingle sets, one row with the smallest id stays."""
    path = scratch(spark, "classes")
    ngrams.row_classes(docs, width=5, percent=80).groupBy("doc", "fp", "n", "first", "first_fp").agg(
        F.count("*").alias("rows")
    ).where("n > 0 and (rows > 1 or doc != first or fp != first_fp)").write.parquet(path)
    linked = spark.read.parquet(path)
    kept = _rows(docs, linked, "left_anti")
    repeated = linked.where("rows > 1 and doc = first and fp = first_fp")
    if not repeated.take(1):
        return kept
    whole = _whole(docs).withColumn("key", F.xxhash64("doc", "fp"))
    some = members(repeated.select(F.xxhash64("doc", "fp")), 1 << 24)(whole, "key")
    some = some.join(repeated.select("doc", "fp"), ["doc", "fp"], "left_semi")
    one = some.groupBy("doc", "fp").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.union(one.select("row.*"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _rows(docs, decontamination.row_items(docs, items), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, source, size, source_size, target, taken."""
    taken = mixing.taken_words(docs)
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", known_language),
    ("lines", first_lines),
    ("similar", one_of_similar),
    ("benchmark", no_benchmark),
    ("mix", mixed),
]

#: The first stage is a trained model, which SQL cannot express; see the brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
