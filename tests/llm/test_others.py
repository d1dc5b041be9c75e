"""The other operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import decontamination, language, lengths, mixing, pii, pivots
from tests.conftest import plan_text
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


# -- 1 ---------------------------------------------------------------------------------


def test_vectors(spark):
    draw = np.random.default_rng(5)
    rows = []
    for label in (0, 1, 2):
        for centre in draw.standard_normal((60, 24)):
            for _ in range(draw.integers(1, 5)):
                noise = 0.03 * draw.standard_normal(24)
                rows.append((len(rows), (centre + noise).tolist(), label))
    crowd = draw.standard_normal(24)
    rows += [
        (len(rows) + k, (crowd + 0.02 * draw.standard_normal(24)).tolist(), 3) for k in range(300)
    ]
    same = draw.standard_normal(24).tolist()
    rows += [(len(rows) + k, same, 4) for k in range(30)]
    n = len(rows)
    rows += [
        (n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [None] + [1.0] * 23, 0), (n + 3, same, None),
        (n + 4, [float("nan")] * 24, 0), (n + 5, [float("inf")] * 24, 0), (n + 6, [1.0] * 5, 4),
        (n + 7, [2.0] * 5, 4), (n + 8, [], 4),
    ]
    rows = [(i, v, g) for i, v, g in random.Random(1).sample(rows, len(rows))]
    table = spark.createDataFrame(
        [(i, v, g, 9, 9, "x") for i, v, g in rows],
        "vec_id long, embedding array<double>, label int, node int, weight int, dim string",
    )
    found = pivots.near_duplicates(table).collect()
    wanted = brute.vector_links(rows, 0.98)
    assert len(found) == len(rows)
    got = sum(r.n_links for r in found)
    assert 0.98 * sum(v[0] for v in wanted.values()) <= got
    assert all(r.n_links <= wanted[r.vec_id][0] for r in found)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert sum(r.component_id == wanted[r.vec_id][1] for r in found) >= 0.98 * len(rows)
    special = {r.vec_id: (r.n_links, r.component_id) for r in found}
    assert all(special[n + k] == (0, n + k) for k in (0, 1, 2, 3, 4, 5, 8))
    assert special[n + 7] == (1, n + 6)


def test_large_lists_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", 20)
    draw = np.random.default_rng(6)
    crowd = draw.standard_normal(16)
    rows = [(k, (crowd + 0.01 * draw.standard_normal(16)).tolist(), 1) for k in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table).collect()}
    wanted = brute.vector_links(rows, 0.98)
    assert sum(v[0] for v in found.values()) >= 0.95 * sum(v[0] for v in wanted.values())
    assert all(v[0] <= wanted[i][0] for i, v in found.items())


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivots.near_duplicates(empty).count() == 0
    only = spark.createDataFrame([(1, None, 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    rows = sorted(map(tuple, pivots.near_duplicates(only).collect()), key=str)
    assert rows == [(1, 0, 1, True), (None, 0, None, True)]


# -- 3 ---------------------------------------------------------------------------------


def test_decontamination(spark, documents, plain):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    pairs = [tuple(r) for r in items.select("item_id", "text").collect()]
    draw = random.Random(2)
    long = " ".join(f"x{draw.randrange(9)}" for _ in range(3000))
    words = pairs[0][1].split()
    extra = [
        (9001, long + " " + pairs[1][1].upper() + " " + long), (9002, " ".join(words[: len(words) // 2])),
        (9003, " ".join(t for _, t in pairs)), (9004, None), (9005, ""), (9006, "a b"), (None, pairs[2][1]),
    ]
    pairs += [(9101, None), (9102, ""), (9103, "a b"), (9104, long)]
    table = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    table = table.withColumn("item_id", F.lit("clash")).withColumn("tokens", F.lit(1))
    asked = spark.createDataFrame(pairs, "item_id long, text string").withColumn("doc_id", F.lit(3))
    found = {
        (r.doc_id, r.item_id): (r.n_common, r.n_item)
        for r in decontamination.contained_items(table, asked).collect()
    }
    assert found == brute.contained_items(plain + extra, pairs)
    assert (None, pairs[2][0]) in found and (9001, pairs[1][0]) in found


def test_decontamination_without_rows(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(documents, none).count() == 0
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert decontamination.contained_items(documents.limit(0), items).count() == 0


# -- 4 ---------------------------------------------------------------------------------


def test_base_spans_match_the_patterns():
    draw = random.Random(1)
    alphabets = ["ab@.", "0123456789", "0123 -.+()", "a@b.c-@", "1.2.33.4", "é@x.y "]
    for _ in range(20000):
        text = "".join(draw.choice(draw.choice(alphabets)) for _ in range(draw.randint(1, 40)))
        assert pii.base_spans(text) == brute.personal_spans(text), text


def test_long_runs_take_no_square_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "a1" * 150_000):
        pii.candidate_spans(run, pii.base_spans(run))


def test_personal_data(spark, documents, plain):
    more = [
        (9001, "call me at (212) 555-0147, phone"), (9002, None), (9003, ""), (9004, "x" * 100_000 + " a@b.com"),
        (None, "mail joe (at) example (dot) com please"), (9005, "é +1 (968) 555-9369, 10.0.0.1, 300.1.1.1"),
    ]
    table = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    table = table.withColumn("row", F.lit(1)).withColumn("spans", F.lit(1))
    found = pii.find(table, pii.train(table))
    rows = {r.doc_id: r.spans for r in found.collect()}
    for i, text in plain + more:
        base = [(s.kind, s.start, s.end) for s in rows[i] if s.base]
        assert base == brute.personal_spans(text or "")
    digest = {r.doc_id: r for r in pii.digest(found).collect()}
    assert digest[9005].n_ip == 1 and digest[9005].n_phone == 1
    assert digest[9005].spans == "ip:21:29,phone:2:19"
    assert digest[9002].base_sha256 == brute.sha(b"") and digest[9002].spans == ""
    assert pii.find(table.limit(0), pii.train(table.limit(0))).count() == 0


def test_secrets_are_added(spark):
    """Planted tokens come from the classifier alone; names, numbers and identifiers stay."""
    draw = random.Random(7)
    rows, planted = [], {}
    for i in range(300):
        filler = " ".join(draw.choices("the house on a hill was sold to them".split(), k=30))
        if i % 3 == 0:
            token = "".join(draw.choices("0123456789abcdef", k=40))
            start = len(filler) + len(' token = "')
            rows.append((i, f'{filler} token = "{token}" {filler}'))
            planted[i] = f"secret:{start}:{start + 40}"
        elif i % 3 == 1:
            rows.append((i, f"{filler} see a-chapter-of-the-long-book-2024 and 98079157628044908123 {filler}"))
        else:
            rows.append((i, f"{filler} mail joe{i}@example.com {filler}"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.digest(pii.find(table, pii.train(table))).collect():
        if r.doc_id % 3 == 2:
            assert (r.n_email, r.n_spans, r.n_added) == (1, 1, 0)
        else:
            assert r.spans == planted.get(r.doc_id, "")
            assert r.n_added == r.n_spans == (r.doc_id in planted)
            assert r.base_sha256 == brute.sha(b"")


def test_secrets_of_documents(spark):
    """Every quoted token of the tables is found, and nothing else is called a secret."""
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    planted = {
        (r.doc_id, m.start(1), m.end(1))
        for r in docs.collect()
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")
    }
    found = {
        (r.doc_id, s.start, s.end)
        for r in pii.find(docs, pii.train(docs)).collect()
        for s in r.spans
        if not s.base
    }
    assert planted and found == planted


def test_reliabilities_are_recovered():
    """Votes made from known reliabilities: the posterior tells the classes apart."""
    draw = np.random.default_rng(4)
    truth = draw.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.6, 0.85, 0.7])
    good = draw.random((4000, 6)) < right
    patterns = np.where(good == truth[:, None], 1, -1)
    share, chance, posterior = pii.reliabilities(patterns, np.ones(4000))
    assert abs(share - 0.3) < 0.05
    assert np.abs(chance[1, :, 2] - right).max() < 0.08
    assert ((posterior > 0.5) == truth).mean() > 0.97


# -- 6 ---------------------------------------------------------------------------------


def test_token_counts(spark, documents, plain):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{lengths.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    more = [(9001, None), (9002, ""), (9003, "<|endoftext|>"), (9004, "ab" * 20_000), (9004, "x")]
    table = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    table = table.withColumn("tokens", F.lit("clash"))
    sizes = [len(other.encode(t or "", add_special_tokens=False).ids) for _, t in plain + more]
    counted = lengths.encoded_lengths(table)
    assert sorted(r.tokens for r in counted.collect()) == sorted(sizes)
    report = lengths.length_report(counted)
    for r in report.collect():
        assert r.n_docs == sizes.count(r.tokens)
        assert r.n_tokens == r.n_docs * r.tokens
        assert r.docs_above == sum(s > r.tokens for s in sizes)
        assert r.tokens_above == sum(s for s in sizes if s > r.tokens)
        assert r.docs_within == len(sizes) - r.docs_above
        assert r.quantile == pytest.approx(r.docs_within / len(sizes))
        assert r.truncated_tokens == sum(min(s, r.tokens) for s in sizes)
    for limit in (0, 100, 333, 10**9):
        total = lengths.truncated_total(report, limit).first()
        assert tuple(total) == (len(sizes), sum(sizes), sum(min(s, limit) for s in sizes))
    assert lengths.length_report(counted.limit(0)).count() == 0


# -- 7 ---------------------------------------------------------------------------------


def _mixed(rows, **more):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    return dict(sizes), dict(taken), target


def test_mix(spark, documents):
    table = documents.withColumn("size", F.lit("clash")).withColumn("block", F.lit(0)).repartition(7)
    more = spark.createDataFrame(
        [(None, "a b c", None), (9001, None, None), (9002, "x " * 5000, "Z"), (9002, "x " * 5000, "Z"),
         (9003, " \n ", "empty"), (9004, " one\vtwo ", "tiny")],
        "doc_id long, text string, source string",
    )
    table = table.unionByName(more, allowMissingColumns=True)
    result = mixing.taken_words(table)
    for name in ("Python", "Pandas", "Arrow", "CartesianProduct"):
        assert name not in plan_text(mixing.taken_words(documents))
    rows = result.collect()
    assert len(rows) == table.count()
    sizes, taken, target = _mixed(rows)
    wanted = brute.targets(sizes)
    counted = defaultdict(int)
    for r in table.select("source", "text").collect():
        counted[r.source] += len(brute.words(r.text))
    assert sizes == dict(counted)
    for source, goal in wanted.items():
        assert target[source] == pytest.approx(goal)
        assert abs(taken[source] - goal) <= 2 * mixing.BLOCK_WORDS
    again = mixing.taken_words(table.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.taken_words(table.limit(0)).count() == 0


def test_mix_gives_whole_texts(documents):
    """The words of the slots, put together, are the taken words of the documents."""
    mixed = mixing.mix(documents, shard_words=4096)
    slots = mixing.mixed_texts(mixed, documents).collect()
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += r.words
    taken = {r.doc_id: r.taken for r in mixing.taken_words(documents).collect()}
    assert dict(words) == {i: n for i, n in taken.items() if n}
    assert sum(len(brute.words(r.text)) for r in slots) == sum(taken.values())
    assert max(len(brute.words(r.text)) for r in slots) == mixing.BLOCK_WORDS
    assert len({r["shard"] for r in slots}) > 10
    source = {r.doc_id: brute.words(r.text) for r in documents.collect()}
    known = {w for ws in source.values() for w in ws}
    assert all(w in known for r in slots for w in brute.words(r.text))


@pytest.mark.parametrize("count", [1, 2, 7, 64, 1000])
def test_permutations(spark, count):
    n = F.lit(count).cast("long")
    rows = spark.range(count).select(
        *[mixing.permuted(F.col("id"), n, F.lit(k)).alias(f"p{k}") for k in range(3)]
    ).collect()
    for k in range(3):
        assert sorted(r[k] for r in rows) == list(range(count))
    if count >= 64:
        assert [r[0] for r in rows] != [r[1] for r in rows]
        assert sum(r[0] == at for at, r in enumerate(rows)) < count / 4


# -- 9 ---------------------------------------------------------------------------------


def test_language(spark, documents):
    more = spark.createDataFrame(
        [(9001, None, "en"), (9002, "", "en"), (9003, "12 34 !?", "fr"), (None, "the thing of the", None)],
        "doc_id long, text string, lang string",
    )
    table = spark.read.parquet(f"{SF_DIR}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    table = table.union(more).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    model = language.train(table)
    assert sorted(sum(model.families, [])) == model.languages == ["de", "en", "es", "fr"]
    assert len(model.families) == 2
    rows = language.identify(table, model).collect()
    truth = {r.doc_id: r.lang for r in table.collect()}
    assert len(rows) == table.count()
    held = [r for r in rows if r.held_out and r.doc_id < 9000]
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in rows if r.doc_id in (9001, 9002, 9003)} == {"und"}
    kept = language.identify(table, model, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "row", "lang_pred", "score"]


def test_language_without_examples(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(1, "some text", None)], schema)
    assert language.train(none) is None
    assert [r.lang_pred for r in language.identify(none, None).collect()] == ["und"]
    one = spark.createDataFrame([(1, "some text", "xx"), (4, "other", "xx")], schema)
    assert {r.lang_pred for r in language.identify(one, language.train(one)).collect()} == {"xx"}
    assert language.identify(none.limit(0), None).count() == 0


def test_prediction_reads_the_text_only(spark, documents):
    model = language.train(documents)
    one = {r.doc_id: r.lang_pred for r in language.identify(documents, model).collect()}
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    assert one == {r.doc_id: r.lang_pred for r in language.identify(other, model).collect()}
