"""Operator 11: token ids as wavelet matrices, one compressed file per shard.

Documents are encoded and brought into ascending order of their ids; runs of whole documents become
shards.  A shard's ids are stored as one bit-plane per bit of an id, highest first: every plane
holds its bit of all ids in the order that the planes above left them in, zeros before ones.
With counts of ones per block (rank) a position is followed down the planes, which gives the id there, how
often an id occurs before a place, and, upwards, where it occurs.  A file is one Parquet file with
one row whose column ``file`` is the layout below, so Spark's writer commits it on any storage:

    magic, levels (u32), docs (u64), tokens (u64)         little-endian header
    sections, each as raw size (u64), packed size (u64), bytes packed by zstd:
      ids of the documents (i64 each), their numbers of tokens (i64 each),
      then per plane its bits (u64 words, lowest bit first) and the ones of each block (u16 each)
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.repeats import payloads
from emberlog.llm.text import bounded_batches, chunks, id_of, null_id, word_codes
from emberlog.session import scratch
from emberlog.sources import folders

# The vocabulary, the id that ends a document, and a special token of the vocabulary.
VOCABULARY = "word_bpe_49k.json"
END = 2
BETWEEN = "<|endoftext|>"
#: Ids in a shard, about; it ends with the document that reaches so many.
SHARD_TOKENS = 1 << 20
#: Words whose ids a worker remembers.
KNOWN_WORDS = 1 << 19
#: Words that are encoded together.
TOGETHER = 1 << 12
#: Bytes of text encoded at a time.
TEXT_BYTES = 4 << 20
#: Words of 64 bits in a block of the rank directory.
BLOCK_WORDS = 16

#: Letters are kind 1 and what surely stands apart from them kind 2; not so beyond ASCII, where a mark
#: may join a letter, and for the characters of contractions and special tokens.
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = 2
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[[ord("'"), ord("|"), ord("<"), ord(">")]] = 0

_MAGIC = b"WAVELET1"
_HEADER = "<8sIQQ"
_SIZES = "<QQ"


class WaveletMatrix:
    """A sequence of ids below ``2**levels`` with access, rank and select."""

    def __init__(self, size: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.size, self.planes, self.block_ones = size, planes, ones
        self.levels = len(planes)
        # Ones before every block, from the counts that are stored.
        self.before = [np.append(0, np.cumsum(n, dtype=np.int64)) for n in ones]
        self.zeros = [size - int(b[-1]) for b in self.before]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        kind = np.uint16 if levels <= 16 else np.uint32
        left = np.asarray(ids).astype(kind)
        planes, ones = [], []
        words = -(-len(left) // (64 * BLOCK_WORDS)) * BLOCK_WORDS
        for level in range(levels - 1, -1, -1):
            bit = (left & kind(1 << level)) != 0
            flat = np.zeros(words * 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            flat[: len(packed)] = packed
            plane = flat.view("<u8")
            planes.append(plane)
            counts = np.bitwise_count(plane).reshape(-1, BLOCK_WORDS)
            ones.append(counts.sum(axis=1, dtype=np.uint16))
            left = np.concatenate([np.compress(~bit, left), np.compress(bit, left)])
        return cls(len(ids), planes, ones)

    def _ones_before(self, level: int, places: np.ndarray) -> np.ndarray:
        """Rank: ones in front of each place of a plane."""
        plane = self.planes[level]
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        block = word // BLOCK_WORDS
        out = self.before[level][block].copy()
        for k in range(BLOCK_WORDS):  # whole words in front of the place, within its block
            at = block * BLOCK_WORDS + k
            some = np.flatnonzero(at < word)
            out[some] += np.bitwise_count(plane[at[some]])
        rest = np.flatnonzero(bit)
        below = (np.uint64(1) << bit[rest]) - np.uint64(1)
        out[rest] += np.bitwise_count(plane[word[rest]] & below)
        return out

    def _bits(self, level: int, places: np.ndarray) -> np.ndarray:
        words = self.planes[level][places >> 6]
        return (words >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places, in the order of the sequence."""
        at = np.asarray(places, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.size):
            raise IndexError("a place lies outside the sequence")
        out = np.zeros(len(at), np.uint32)
        for level in range(self.levels):
            bit, ones = self._bits(level, at), self._ones_before(level, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def decode(self) -> np.ndarray:
        """All ids: what ``access`` gives for every place.  From the last plane upwards the bits of a
        plane say from which half of the order below each place takes its next id."""
        out = np.zeros(self.size, np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(
                self.planes[level].view(np.uint8), count=self.size, bitorder="little"
            )
            one = bits.view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[: self.zeros[level]]
            above[np.flatnonzero(one)] = out[self.zeros[level] :]
            out = above | bits.astype(np.uint32) << np.uint32(self.levels - 1 - level)
        return out

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        """Where the occurrences of an id between two places end up below the last plane."""
        if not 0 <= token < 1 << self.levels:
            return 0, 0
        ends = np.array([first, last], np.int64)
        for level in range(self.levels):
            ones = self._ones_before(level, ends)
            one = token >> (self.levels - 1 - level) & 1
            ends = self.zeros[level] + ones if one else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of an id from place ``first`` up to ``last``."""
        a, b = self._range(token, first, self.size if last is None else last)
        return b - a

    def _select(self, level: int, one: bool, number: np.ndarray) -> np.ndarray:
        """Places of the ones (or zeros) with these numbers, counted from 0."""
        if not len(number):
            return number
        before = self.before[level]
        if not one:
            before = np.minimum(np.arange(len(before)) * 64 * BLOCK_WORDS, self.size) - before
        block = np.searchsorted(before, number, "right") - 1
        out = np.empty(len(number), np.int64)
        # Blocks are opened one after another; the numbers rise, so each is opened once.
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
            first = int(block[a]) * BLOCK_WORDS
            words = self.planes[level][first : first + BLOCK_WORDS]
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")
            found = np.flatnonzero(bits == one)
            out[a:b] = first * 64 + found[number[a:b] - before[block[a]]]
        return out

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, ascending, without decoding anything else."""
        a, b = self._range(token, 0, self.size)
        at = np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bool(one), at - self.zeros[level] if one else at)
        return at


def _section(data: np.ndarray) -> bytes:
    raw = data.tobytes()
    packed = pa.compress(raw, "zstd", asbytes=True)
    return struct.pack(_SIZES, len(raw), len(packed)) + packed


def to_file(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    """A shard as the bytes of its file."""
    matrix = WaveletMatrix.build(ids, levels)
    parts = [struct.pack(_HEADER, _MAGIC, levels, len(docs), len(ids))]
    parts += [_section(docs.astype("<i8")), _section(sizes.astype("<i8"))]
    for plane, ones in zip(matrix.planes, matrix.block_ones, strict=True):
        parts += [_section(plane), _section(ones.astype("<u2"))]
    return b"".join(parts)


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(ids of the documents, their numbers of tokens, the matrix) of a file."""
    magic, levels, docs, tokens = struct.unpack_from(_HEADER, data)
    if magic != _MAGIC:
        raise ValueError("not a wavelet file")
    at = struct.calcsize(_HEADER)

    def section(kind: str) -> np.ndarray:
        nonlocal at
        raw, packed = struct.unpack_from(_SIZES, data, at)
        begin = at + struct.calcsize(_SIZES)
        at = begin + packed
        return np.frombuffer(pa.decompress(data[begin:at], raw, "zstd", asbytes=True), kind)

    ids, sizes = section("<i8"), section("<i8")
    if len(ids) != docs or int(sizes.sum()) != tokens:
        raise ValueError("a wavelet file whose parts do not agree")
    planes = [(section("<u8"), section("<u2")) for _ in range(levels)]
    return ids, sizes, WaveletMatrix(tokens, [p for p, _ in planes], [n for _, n in planes])


class Encoder:
    """Ids of whole texts by a public tokenizer.

    White space separates words of this vocabulary and is dropped, so a text's ids are those of
    its words, and it cuts words where ASCII letters meet other ASCII characters, so they are those of
    such pieces; a piece of letters alone is what its merges are applied to.  ``open`` asks the vocabulary
    whether that holds and otherwise takes whole words.  The encoder is broadcast: a Python worker keeps it, and the words it has met, from task
    to task.  When it remembers ``KNOWN_WORDS`` words, later ones are encoded each time.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self.coder = None

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "coder": None}

    def open(self) -> None:
        if self.coder is not None:
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(self.vocabulary)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.between = self.coder.token_to_id(BETWEEN)
        asked = "ab.CD7x-y"
        cut = self.coder.pre_tokenizer.pre_tokenize_str(self.coder.normalizer.normalize_str(asked))
        plain = [piece for piece, _ in cut] == ["ab", ".", "cd", "7", "x", "-", "y"]
        self.kinds = _KINDS if plain else None
        self.known: dict[bytes, int] = {}
        self.ids = pa.array([], pa.list_(pa.uint32()))

    def levels(self, end: int) -> int:
        self.open()
        return max(self.coder.get_vocab_size(), end + 1).bit_length()

    def _learned(self, words: list[bytes]) -> pa.Array:
        """Ids per word or piece."""
        letters = [self.kinds is not None and w.isalpha() and w.isascii() for w in words]
        merged = self.coder.model.tokenize
        easy = pa.array(
            [[t.id for t in merged(w.decode().lower())] for w, e in zip(words, letters, strict=True) if e],
            pa.list_(pa.uint32()),
        )
        rest = self._whole([w for w, e in zip(words, letters, strict=True) if not e])
        own = np.array(letters, bool)
        order = np.where(own, np.cumsum(own) - 1, len(easy) + np.cumsum(~own) - 1)
        return pa.concat_arrays([easy, rest]).take(pa.array(order))

    def _whole(self, words: list[bytes]) -> pa.Array:
        """Ids per word.  Words go to the tokenizer together, with a special token between
        them, which it treats as the end of one text and the start of another."""
        texts = [w.decode("utf-8", "replace") for w in words]
        if any(BETWEEN in text for text in texts):
            found = [self.coder.encode(t, add_special_tokens=False).ids for t in texts]
            return pa.array(found, pa.list_(pa.uint32()))
        runs, sizes = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        for at in range(0, len(texts), TOGETHER):
            joined = BETWEEN.join(texts[at : at + TOGETHER])
            ids = np.array(self.coder.encode(joined, add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.between)
            runs.append(np.delete(ids, cut))
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
        edges = np.cumsum(np.concatenate(sizes))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(runs)))

    def encode(self, chunk, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each followed by ``end``; ids per text)."""
        self.open()
        codes, words, edges = word_codes(chunk, kinds=self.kinds)
        words = words.to_pylist()
        number = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(number < 0)
        number[fresh] = len(self.ids) + np.arange(len(fresh))
        new = [words[i] for i in fresh]
        lists = pa.concat_arrays([self.ids, self._learned(new)])
        if len(lists) <= KNOWN_WORDS:
            self.known.update(zip(new, range(len(self.ids), len(lists)), strict=True))
            self.ids = lists
        # The end of a document is one more word behind its own.
        lists = pa.concat_arrays([lists, pa.array([[end]], pa.list_(pa.uint32()))])
        row = np.insert(number[codes], edges[1:], len(lists) - 1)
        taken = lists.take(pa.array(row))
        places = edges[1:] + np.arange(1, len(edges))
        ends = taken.offsets.to_numpy()[places] - taken.offsets[0].as_py()
        return taken.flatten().to_numpy(), np.diff(np.append(0, ends)).astype(np.int64)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def write_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "",
    end: int = END,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode all texts and write them to ``path`` in ascending order of their ids, a file per shard.

    Every document is its ids and ``end``; a null text is empty.  A null id counts as the largest; rows with
    one id are ordered by a hash of their texts.  A shard holds whole documents, so a very long text
    is a shard of its own size.  Equal rows are all written; other columns are not read.  An empty
    table gives a folder without files.  Ids of any number of rows alike are dealt to
    several tasks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as file:
        coder = Encoder(file.read())
    levels = coder.levels(end)
    kind = np.uint16 if levels <= 16 else np.uint32
    held = spark.sparkContext.broadcast(coder)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        id_of(id_col).alias("doc"), F.xxhash64(text).alias("fp"),
        F.monotonically_increasing_id().alias("row"), text.alias("text"),
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held.value
        for batch in batches:
            for chunk in chunks(batch.column(3), TEXT_BYTES):
                made, each = coder.encode(chunk, end)
                edges = np.append(0, np.cumsum(each)) * kind().nbytes
                data = pa.py_buffer(made.astype(kind))
                buffers = [None, pa.py_buffer(edges.astype(np.int32)), data]
                ids = pa.Array.from_buffers(pa.binary(), len(each), buffers)
                own = batch.slice(chunk.first, len(each))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:3], ids], names=["doc", "fp", "row", "ids"]
                )

    # Written once: the ranges are chosen from a sample, which would encode everything again.
    # Ids of two bytes are what is sorted, and workers that sort remember no words.
    schema = "doc long, fp long, row long, ids binary"
    drafts = scratch(spark, "encoded")
    rows.mapInArrow(encoded, schema).write.option("compression", "zstd").parquet(drafts)
    held.destroy()
    order = ["doc", "fp", "row"]
    rows = spark.read.schema(schema).parquet(drafts)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        names: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            own, each = np.concatenate(names), np.concatenate(sizes)
            file = to_file(own, each, np.concatenate(ids), levels)
            values = [[part], [number], [len(own)], [total], [file]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(
                columns, names=["part", "number", "n_docs", "n_tokens", "file"]
            )

        for batch in batches:
            data, edges = payloads(batch.column(1))
            made, ends = data.view(kind), edges[1:] // kind().nbytes
            own, each, begin = batch.column(0).to_numpy(), np.diff(edges) // kind().nbytes, 0
            while begin < len(each):
                done = int(ends[begin - 1]) if begin else 0
                full = np.searchsorted(ends, done + shard_tokens - total)
                last = min(int(full) + 1, len(each))
                names.append(own[begin:last])
                sizes.append(each[begin:last])
                ids.append(made[done : ends[last - 1]])
                total += int(ends[last - 1]) - done
                begin = last
                if total >= shard_tokens:
                    yield shard()
                    number, total = number + 1, 0
                    names, sizes, ids = [], [], []
        if names:
            yield shard()

    files = rows.mapInArrow(shards, "part int, number int, n_docs long, n_tokens long, file binary")
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)
    folders.remove(spark, drafts)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, n_docs, n_tokens, start, file) of every shard; ``start`` counts the ids of all
    shards before it.  Sums go over the shards of a task, then over the tasks."""
    files = spark.read.schema(
        "part int, number int, n_docs long, n_tokens long, file binary"
    ).parquet(path)
    sizes = files.select("part", "number", "n_tokens")
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("offset"))
    starts = inside.join(F.broadcast(offsets), "part").select(  # one row per writing task
        "part", "number", (F.col("inside") + F.col("offset")).alias("start")
    )
    # Only numbers are joined to a row that holds a file.
    return files.hint("merge").join(starts.hint("merge"), ["part", "number"])


def documents_of(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) per document, decoded from the files of ``read_files``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, sizes, matrix = from_file(row["file"])
                data = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                sums = [
                    zlib.crc32(data[4 * a : 4 * b])
                    for a, b in zip(begins.tolist(), ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs), pa.array(begins + row["start"]), pa.array(sizes),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc", "start", "n_tokens", "ids_crc32"],
                )

    found = files.select("start", "file").mapInArrow(
        read, "doc long, start long, n_tokens long, ids_crc32 long"
    )
    return found.select(null_id("doc").alias(id_col), "start", "n_tokens", "ids_crc32")


def _per_file(files: DataFrame, ask, schema: str) -> DataFrame:
    """Rows that ``ask(docs, ends, matrix, start)`` gives for every file, as Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, sizes, matrix = from_file(row["file"])
                yield ask(docs, np.cumsum(sizes), matrix, row["start"])

    return files.select("start", "file").mapInArrow(run, schema)


def token_counts(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often some ids occur in all files, by rank alone."""

    def ask(docs, ends, matrix, start):
        counts = [matrix.count(t) for t in tokens]
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], names=["token", "n"]
        )

    return _per_file(files, ask, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(files: DataFrame, token: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, place, at): every occurrence of an id, as a place in the whole sequence and in its
    document, by select alone."""

    def ask(docs, ends, matrix, start):
        places = matrix.occurrences(token)
        doc = np.searchsorted(ends, places, "right")
        begins = np.append(0, ends[:-1])
        columns = [docs[doc], places + start, places - begins[doc]] if len(docs) else [places] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in columns], names=["doc", "place", "at"]
        )

    found = _per_file(files, ask, "doc long, place long, at long")
    return found.select(null_id("doc").alias(id_col), "place", "at")


def tokens_at(files: DataFrame, places: list[int]) -> DataFrame:
    """(place, token) for some places in the whole sequence, by access alone."""
    asked = np.unique(np.array(places, np.int64))

    def ask(docs, ends, matrix, start):
        own = asked[(asked >= start) & (asked < start + matrix.size)]
        ids = matrix.access(own - start).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids)], names=["place", "token"])

    return _per_file(files, ask, "place long, token long")
