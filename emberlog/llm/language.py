"""Operator 9: hierarchical language identification.

Languages are grouped into families by how close their profiles of character grams are.  A
linear support vector machine per family (one against the rest) names the family first; inside it
one machine per pair of languages votes.  Only the training rows are a bounded sample; every
text is predicted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.text import bounded_batches, chunks, id_of, mix

#: Slots that character grams are hashed to.
SLOTS = 4096
#: Bytes per gram.
GRAMS = (1, 2, 3)
#: Training rows per language, at most.
ROWS_PER_LANGUAGE = 600
UNDETERMINED = "und"
_U = np.uint64

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[: ord("A")] = 32
_SPACE[ord("Z") + 1 : ord("a")] = 32
_SPACE[ord("z") + 1 : 128] = 32
_SPACE[ord("A") : ord("Z") + 1] += 32


def gram_profiles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) per chunk: one row per text, hashed counts of its byte grams as
    square roots, of length one.  Case (A-Z), digits and punctuation do not count."""
    for chunk in chunks(texts, rows=256):
        count = len(chunk.edges) - 1
        data = _SPACE[chunk.data].astype(np.uint64)
        out = np.zeros((count, SLOTS), np.float32)
        owner = np.repeat(np.arange(count), np.diff(chunk.edges))
        code = np.zeros(len(data), np.uint64)
        for k in range(max(GRAMS)):
            if len(data) <= k:
                break
            code = (code[: len(data) - k] << _U(8)) | data[k:]
            if k + 1 not in GRAMS:
                continue
            inside = owner[: len(code)] == owner[k:]
            if k:
                inside &= ~((data[: len(code)] == 32) & (data[k:] == 32))
            else:
                inside &= data != 32
            slot = (mix(code[inside], k) % _U(SLOTS)).astype(np.int64)
            flat = np.bincount(owner[: len(code)][inside] * SLOTS + slot, minlength=count * SLOTS)
            part = np.sqrt(flat.reshape(count, SLOTS).astype(np.float32))
            out += part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        yield chunk.first, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train_machine(
    rows: np.ndarray, side: np.ndarray, cost: float = 10.0, steps: int = 300
) -> np.ndarray:
    """A linear support vector machine (squared hinge loss, classes weighted alike) by
    accelerated gradient descent; ``side`` is +1 or -1.  The last weight is the offset."""
    x = np.ones((len(rows), rows.shape[1] + 1))
    x[:, :-1] = rows
    share = np.where(side > 0, 0.5 / max((side > 0).sum(), 1), 0.5 / max((side < 0).sum(), 1))
    # Rows have length one, so the loss bends at most so much.
    bend = 1 / cost + 2 * 2.0
    w = momentum = np.zeros(x.shape[1])
    for step in range(steps):
        slack = np.maximum(1 - side * (x @ momentum), 0)
        slope = momentum / cost - 2 * (x.T @ (share * side * slack))
        after = momentum - slope / bend
        momentum = after + step / (step + 3) * (after - w)
        w = after
    return w


def families(profiles: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages grouped by their mean profiles: the closest groups are joined, by average
    cosine, until about as many groups as the square root of the languages are left."""
    groups = [[name] for name in sorted(profiles)]
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in profiles.items()}

    def near(a: list[str], b: list[str]) -> float:
        return float(np.mean([unit[x] @ unit[y] for x in a for y in b]))

    while len(groups) > max(1, round(len(profiles) ** 0.5)):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: near(groups[p[0]], groups[p[1]]))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


class Model:
    """Family machines and, inside each family, pair machines."""

    def __init__(self, rows: np.ndarray, names: list[str]):
        names = np.array(names)
        self.languages = sorted(set(names.tolist()))
        self.families = families({k: rows[names == k].mean(axis=0) for k in self.languages})
        self.of_family = [
            train_machine(rows, np.where(np.isin(names, group), 1.0, -1.0))
            for group in (self.families if len(self.families) > 1 else [])
        ]
        self.of_pair = {}
        for group in self.families:
            for a, b in combinations(group, 2):
                own = (names == a) | (names == b)
                self.of_pair[a, b] = train_machine(rows[own], np.where(names[own] == a, 1.0, -1.0))

    @staticmethod
    def _margin(rows: np.ndarray, machine: np.ndarray) -> np.ndarray:
        return rows @ machine[:-1].astype(rows.dtype) + machine[-1]

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of every profile: the share of the family times that of the
        language inside it, both from margins."""
        sure = np.ones(len(rows))
        family = np.zeros(len(rows), int)
        if self.of_family:
            margins = np.stack([self._margin(rows, m) for m in self.of_family], axis=1)
            odds = 1 / (1 + np.exp(-4 * margins))
            family = margins.argmax(axis=1)
            sure = odds.max(axis=1) / np.maximum(odds.sum(axis=1), 1e-9)
        names = np.empty(len(rows), object)
        for at, group in enumerate(self.families):
            own = np.flatnonzero(family == at)
            if not len(own):
                continue
            votes = np.zeros((len(own), len(group)))
            for i, j in combinations(range(len(group)), 2):
                odds = 1 / (1 + np.exp(-4 * self._margin(rows[own], self.of_pair[group[i], group[j]])))
                votes[:, i] += odds
                votes[:, j] += 1 - odds
            best = votes.argmax(axis=1)
            names[own] = np.array(group, object)[best]
            if len(group) > 1:
                sure[own] *= votes.max(axis=1) / (len(group) - 1)
        return names.tolist(), np.clip(sure, 0, 1)


def held_out(doc: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> Model | None:
    """Learn from at most ``rows_per_language`` rows of each language, chosen by a hash of id and text
    among the rows that have a text and a language and are not held out; None without any.  Equal
    rows count once."""
    bounded_batches(docs.sparkSession)
    known = docs.select(
        id_of(id_col).alias("doc"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        held_out(F.col(id_col)).alias("held"),
    ).where("not held and text rlike '\\\\p{L}' and lang is not null")
    draw = F.xxhash64(F.lit("train"), "doc", "text")
    known = known.select("doc", "lang", "text", draw.alias("draw"))
    counts = dict(known.groupBy("lang").count().orderBy("lang").collect())
    if not counts:
        return None
    # Twice as many as wanted, equal rows once, and of these the first ones: never more.  The
    # first row of a language is always there, however its rows repeat.
    share = F.lit(0.0)
    for name, count in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, 2 * rows_per_language / count)).otherwise(share)
    some = known.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < share)
    first = known.groupBy("lang").agg(F.min(F.struct("draw", "doc", "text")).alias("row"))
    some = some.unionByName(first.select("lang", "row.*")).dropDuplicates(["lang", "draw"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw"))
    some = some.withColumn("turn", turn).where(F.col("turn") <= rows_per_language)
    some = some.select("doc", "lang", "text")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in gram_profiles(batch.column(2)):
                part = batch.slice(first, len(rows))
                flat = pa.array([r.tobytes() for r in rows.astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), flat], names=["doc", "lang", "profile"]
                )

    # At most rows_per_language rows of two bytes per slot for each language.
    rows = some.mapInArrow(profile, "doc long, lang string, profile binary").toArrow()
    rows = rows.sort_by([("doc", "ascending"), ("lang", "ascending"), ("profile", "ascending")])
    matrix = np.empty((len(rows), SLOTS), np.float32)
    for k, profile in enumerate(rows["profile"]):
        matrix[k] = np.frombuffer(profile.as_buffer(), np.float16)
    names = rows["lang"].to_pylist()
    del rows, profile  # the driver holds the profiles once
    return Model(matrix, names)


def identify(
    docs: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
) -> DataFrame:
    """Language of every whole text: ``id_col, held_out, lang_pred, score``; with ``keep`` all
    columns of ``docs`` and ``lang_pred, score`` in place of columns of that name.

    A null text, or one without a letter, is ``und`` with score 0, and so is everything if nothing
    could be learned.  Neither the id nor any other column has a part in it.  Repeated rows get
    equal answers; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    whole = docs.select(
        F.struct(*own).alias("row") if keep else F.struct(id_col).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    kind = whole.schema["row"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [UNDETERMINED] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            if model is not None:
                for first, rows in gram_profiles(batch.column(1)):
                    found, sure = model.predict(rows)
                    for i, (name, score) in enumerate(zip(found, sure, strict=True), first):
                        if letters[i]:
                            names[i], scores[i] = name, score
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(scores)],
                names=["row", "lang_pred", "score"],
            )

    done = whole.mapInArrow(predict, f"row {kind}, lang_pred string, score double")
    if keep:
        return done.select(*[F.col(f"row.`{c}`") for c in own], "lang_pred", "score")
    return done.select(
        F.col(f"row.`{id_col}`"), held_out(F.col(f"row.`{id_col}`")).alias("held_out"), "lang_pred", "score"
    )
