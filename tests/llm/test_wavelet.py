"""Token files: round trips, rank and select, and the ids against encoding whole texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from emberlog.llm import wavelet
from emberlog.llm.wavelet import WaveletMatrix
from emberlog.session import scratch

SCHEMA = "doc_id long, text string, start long, file string, part long"
ODD = [
    None, "", " \n\t", "Hello  World's don't", "a ̈b", "x<|endoftext|> y<|startoftext|>", "it 's  'S 12",
    "z\u0085q w p", "İSTANBUL ß ﬁ \U0001f600\U0001f600", "a\x00b\x0bq", "café CAFÉ", "你好 " * 30,
    "can't CAN'T ab.cd x'y 'tis rock'n'roll o'' ''s", "a1b22-c_d(e)|f|g<|h|>i <endoftext> |endoftext|", "<|ENDOFTEXT|>x<|endoftext|>",
    "éa aé áb é.f KK ½a a½", "%%%ab$$cd&&&", "\\a\\b `x` ~y~ z^^2 ♥a♥b", "a​b a️b", "A" * 3000 + ".b" * 500,
]


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(wavelet.vocabulary_path())


def brute(coder, rows):
    """(doc_id, start, n_tokens, crc) of rows in order."""
    out, start = [], 0
    for i, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def written(spark, docs, **options):
    path = scratch(spark, "test-tokens")
    wavelet.write_files(docs, path, **options)
    return wavelet.read_files(spark, path)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 1023, 1024, 1025, 5000])
def test_matrix(size):
    draw = np.random.default_rng(size)
    ids = draw.integers(0, 250, size) ** 2
    matrix = WaveletMatrix.build(ids, 16)
    assert (matrix.decode() == ids).all()
    places = draw.permutation(size)
    assert (matrix.access(places) == ids[places]).all()
    low, high = sorted(draw.integers(0, size + 1, 2).tolist())
    for token in {*ids[:30].tolist(), 0, 7, 65535, 1 << 20}:
        assert matrix.count(token) == (ids == token).sum()
        assert matrix.count(token, low, high) == (ids[low:high] == token).sum()
        assert (matrix.occurrences(token) == np.flatnonzero(ids == token)).all()


def test_places_outside():
    with pytest.raises(IndexError):
        WaveletMatrix.build(np.arange(10), 4).access([10])


def test_file_round_trip():
    ids = np.random.default_rng(3).integers(0, 49408, 3000)
    docs, sizes = np.array([-5, 7, 1 << 40]), np.array([1000, 1, 1999])
    file = wavelet.to_file(docs, sizes, ids, 16)
    found_docs, found_sizes, matrix = wavelet.from_file(file)
    assert (found_docs == docs).all() and (found_sizes == sizes).all() and (matrix.decode() == ids).all()
    with pytest.raises(ValueError, match="not a wavelet file"):
        wavelet.from_file(b"other" + file)


def test_documents(spark, coder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    files = written(spark, docs.repartition(7), shard_tokens=20_000)
    assert files.count() > 3
    found = wavelet.documents_of(files).orderBy("start").collect()
    assert [tuple(r) for r in found] == brute(coder, rows)
    ids = np.array([t for i, x in rows for t in [*coder.encode(x or "", add_special_tokens=False).ids, 2]])
    token = int(np.bincount(ids).argmax())
    counts = {r.token: r.n for r in wavelet.token_counts(files, [token, 2, 49999]).collect()}
    assert counts == {token: (ids == token).sum(), 2: (ids == 2).sum(), 49999: 0}
    places = wavelet.token_places(files, token).orderBy("place").collect()
    assert [r.place for r in places] == np.flatnonzero(ids == token).tolist()
    begins = {r.doc_id: r.start for r in found}
    assert all(begins[r.doc_id] + r["at"] == r.place for r in places)
    some = random.Random(1).sample(range(len(ids)), 200)
    asked = wavelet.tokens_at(files, [*some, len(ids)]).collect()
    assert {r.place: r.token for r in asked} == {p: int(ids[p]) for p in some}


def test_odd_texts_nulls_and_repeated_rows(spark, coder):
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(None, "no id"), (None, "no id"), (None, "other"), (3, "same id"), (5, ODD[5]), (5, ODD[5])]
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows.append((-4, long))
    draw = random.Random(2)
    docs = spark.createDataFrame([(i, t, 9, "f", 1) for i, t in draw.sample(rows, len(rows))], SCHEMA)
    found = wavelet.documents_of(written(spark, docs, shard_tokens=50)).orderBy("start").collect()
    order = [r.doc_id for r in found]
    assert order == sorted((i for i, _ in rows if i is not None)) + [None] * 3
    wanted = sorted(((i, n, c) for i, _, n, c in brute(coder, rows)), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == wanted
    assert [r.start for r in found] == np.append(0, np.cumsum([r.n_tokens for r in found])[:-1]).tolist()


def test_words_beyond_the_memory(coder, monkeypatch):
    import pyarrow as pa

    from emberlog.llm.text import chunks

    monkeypatch.setattr(wavelet, "KNOWN_WORDS", 10)
    own = wavelet.Encoder(open(wavelet.vocabulary_path(), encoding="utf-8").read())
    for text in ("one two three four five six seven", "eight nine ten eleven one two", "one nine"):
        chunk = next(chunks(pa.array([text, ""])))
        ids, sizes = own.encode(chunk, 2)
        wanted = coder.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == [*wanted, 2, 2] and sizes.tolist() == [len(wanted) + 1, 1]


def test_empty(spark):
    files = written(spark, spark.createDataFrame([], SCHEMA))
    assert files.count() == 0 and wavelet.documents_of(files).collect() == []
    assert wavelet.token_counts(files, [2]).collect() == []


def test_random_characters(coder):
    import pyarrow as pa

    from emberlog.llm.text import chunks

    draw = random.Random(9)
    letters = "abcXYZ09 .,'|<>-_\n\té\u0301ß½你İ%$\u2003\u00a0\x1c\x85"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(3000)]
    own = wavelet.Encoder(open(wavelet.vocabulary_path(), encoding="utf-8").read())
    ids, sizes = own.encode(next(chunks(pa.array(texts))), 2)
    cut = np.split(ids, np.cumsum(sizes)[:-1])
    for text, found in zip(texts, cut, strict=True):
        assert found.tolist() == [*coder.encode(text, add_special_tokens=False).ids, 2], text


def test_texts_are_encoded_before_they_are_sorted(spark, tmp_path, monkeypatch):
    """What is dealt by range holds ids, and nothing of the drafts stays."""
    docs = spark.createDataFrame([(2, "b c"), (1, "a"), (None, None)], "doc_id LONG, text STRING")
    frame, dealt = type(docs), []
    real = frame.repartitionByRange

    def noted(self, *columns):
        dealt.append(self.columns)
        return real(self, *columns)

    monkeypatch.setattr(frame, "repartitionByRange", noted)
    removed, real_remove = [], wavelet.folders.remove
    monkeypatch.setattr(
        wavelet.folders, "remove", lambda spark, path: removed.append(path) or real_remove(spark, path)
    )
    path = str(tmp_path / "files")
    wavelet.write_files(docs, path)
    assert dealt == [["doc", "fp", "row", "ids"]]
    assert [wavelet.folders.exists(spark, p) for p in removed] == [False]
    found = wavelet.documents_of(wavelet.read_files(spark, path)).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in found] == [(1, 0), (2, 2), (None, 5)]
