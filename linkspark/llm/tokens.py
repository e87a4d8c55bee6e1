"""Token-id shards with a shared zstandard dictionary (op9).

Documents are encoded, their ids (and the end id) serialized as little-endian unsigned 32-bit integers and each
document compressed alone with one dictionary, trained on the serialized ids of a bounded sample (too few ids to train
on are the dictionary themselves). The compressed documents are written once, then dealt by ranges of doc_id (and of
what else sorts them, so that one doc_id, or none, may have any number of documents), sorted, and packed into shard
images of about ``IMAGE`` bytes:

    magic b"LSTK0001" | sha256 of the dictionary, 32 bytes | documents n, uint32
    n x (null flag uint8) | n x (doc_id int64) | n x (ids uint32) | (n + 1) x (frame offset uint64) | frames

All numbers are little-endian. An image is one row (shard, block, n_tokens, image) of a Parquet table, which any store
of Spark's holds; the dictionary is its own small table beside it. One document is read by its image's index.

A text is cut at spaces that follow a character other than white space, where a match of the tokenizer's pattern
always begins, and each distinct word of the pieces is encoded once for a while (a bounded table of words).

Defined results: a null text is an empty one (the end id alone). Null doc_ids come last. Documents of one doc_id
stand beside each other, ordered by the number of their ids and its checksum. What the tokenizer takes for a special
token in a text is one, as the library has it. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import offsets, per_text, pieces, read, scratch, trimmed

TOKENIZER = "byte_bpe_50k.json"
#: The character that stands for a space in the tokenizer's vocabulary.
SPACE = "\u0120"
END_ID = 0
MAGIC = b"LSTK0001"
IMAGE = 4 << 20
#: The dictionary's size, the documents that it is trained on, about, and the bytes of a long one's that are.
DICTIONARY, SAMPLE, SAMPLED = 64 << 10, 1000, 64 << 10
#: Documents of a shard, about; shards whose sizes are added up at once.
SHARD, GROUP = 20_000, 1024
#: Bytes of words and their ids that are kept, about; bytes of texts encoded at once.
MAX_KEPT, PART = 24 << 20, 8 << 20
#: Characters that a word is encoded without, if a letter below LETTERS (all of which any Unicode version has) is before.
STOPS, LETTERS = ".,", 0x250
_LETTER, _SOLID = (np.array([test(chr(i)) for i in range(LETTERS)]) for test in (str.isalpha, lambda c: not c.isspace()))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _kind(table: np.ndarray, texts: pa.Array, other: Callable[[str], bool]) -> np.ndarray:
    """Whether the last character of each text is of a kind: by the table below LETTERS, by ``other`` from there on; an
    empty text's isn't."""
    at, data = offsets(texts), texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(1, np.uint8)
    some, two = np.diff(at) > 0, np.diff(at) > 1
    last = data[np.where(some, at[1:] - 1, 0)].astype(np.int64)
    before = data[np.where(two, at[1:] - 2, 0)]
    wide = (before >= 0xC2) & (before < 0xE0)  # begins a character of two bytes
    code = np.where(last < 128, last, np.where(wide, (before.astype(np.int64) & 31) << 6 | last & 63, len(table)))
    out = some & table[np.minimum(code, len(table) - 1)] & (code < len(table))
    for k in np.flatnonzero(some & (code >= len(table))):
        out[k] = other(texts[int(k)].as_py()[-1])
    return out


class Encoder:
    """Texts to serialized ids. Words stay in Arrow; only those that must be encoded come to Python."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.known, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())  # words; their ids after a space

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> pa.Array:
        """The ids of each word after a space. Many words are one text to the tokenizer, as a call costs more than a
        word; none ends in white space, so each begins where a match does, and with the one token that has a space."""
        ids, begins, many = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        texts = [" " + " ".join(words[at : at + 2000]) for at in range(0, len(words), 2000)]
        for at in range(0, len(texts), 16):
            for found in self.tokenizer.encode_batch_fast(texts[at : at + 16], add_special_tokens=False):
                ids.append(np.array(found.ids, "<u4"))
                begins.append(many + np.flatnonzero(self.spaced[ids[-1]]))
                many += len(ids[-1])
        edges = 4 * np.append(np.concatenate(begins), many)
        if len(edges) != len(words) + 1:
            raise ValueError("a word's ids don't begin with its space")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(edges), pa.py_buffer(np.concatenate(ids))])

    def parted(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
        """The words of the pieces, each once, the place of each piece's among them, the pieces that are a word and
        stops, and the stops of these. A letter is never matched with a stop or comma after it, so that a word with
        stops has the ids of the bare word and those of the stops."""
        bare = pc.utf8_rtrim(distinct, STOPS)
        stops = np.diff(offsets(distinct)) - np.diff(offsets(bare))
        rows = np.flatnonzero((stops > 0) & _kind(_LETTER, bare, lambda c: False))
        ended = np.zeros(len(distinct), bool)
        ended[rows] = True
        coded = pc.if_else(pa.array(ended), bare, distinct).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), rows, [x[-n:] for x, n in zip(distinct.take(pa.array(rows)).to_pylist(), stops[rows].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Arrow splits the texts and numbers their pieces and these pieces' words."""
        texts = texts.fill_null("").cast(pa.large_string())
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        distinct, places = coded.dictionary, coded.indices.to_numpy()
        words, word, rows, stops = self.parted(distinct)
        sound = _kind(_SOLID, words, lambda c: bool(c.strip()))  # after white space another piece must follow
        place = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        wanted = np.flatnonzero((place < 0) & sound)
        new = words.take(pa.array(wanted))
        found = self.together(new.to_pylist())
        place[wanted] = len(self.known) + np.arange(len(new))
        ends = pa.array(stops, pa.large_string()).dictionary_encode()
        values = pa.concat_arrays([self.values, found])
        bare = values.take(pa.array(place[word[rows]]))
        stopped = pc.binary_join_element_wise(bare, pa.array(self.raw(ends.dictionary.to_pylist()), pa.large_binary()).take(ends.indices), pa.scalar(b"", pa.large_binary()))
        if self.known.nbytes + self.values.nbytes < MAX_KEPT:  # the frequent words come early; later ones are kept for these texts alone
            self.known, self.values = pa.concat_arrays([self.known, new]), values
        none = len(values) + len(rows)
        piece = np.where(sound[word], place[word], none)
        piece[rows] = len(values) + np.arange(len(rows))
        odd = ~sound[word]
        taken = piece[places]
        taken[at[:-1]] = none  # the heads are encoded apart
        heads = self.raw(distinct.take(pa.array(places[at[:-1]])).to_pylist())
        tail = pa.concat_arrays([values, stopped, pa.array([b""], pa.large_binary())]).take(pa.array(taken))
        ends, data = offsets(tail)[np.minimum(at, len(places))], tail.buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        slow = (per_text(odd[places], at) > 0) & (np.diff(at) > 1)
        return [b"".join(self.raw(list(self.joined(texts[i].as_py().split(" "))))) if slow[i] else heads[i] + data[ends[i] : ends[i + 1]] for i in range(len(texts))]

    @staticmethod
    def joined(x: list[str]) -> Iterator[str]:
        """The pieces with their spaces, none of which ends in white space but the last."""
        held, first = "", True
        for y in x:
            held = y if first else f"{held} {y}"
            first = False
            if y and not y[-1].isspace():
                yield held
                held = ""
        if held or first:
            yield held


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, whose words one task leaves to the next."""
    return Encoder(path)


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or none if the samples are too few for one."""
    samples = [x for x in samples if len(x) >= 8]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICTIONARY:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)


def _unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def pack(doc_ids: list[int | None], counts: list[int], frames: list[bytes], sha: bytes) -> bytes:
    n = len(frames)
    ends = np.zeros(n + 1, "<u8")
    ends[1:] = np.cumsum([len(f) for f in frames])
    flags = np.array([x is None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([MAGIC, sha, struct.pack("<I", n), flags.tobytes(), ids.tobytes(), np.array(counts, "<u4").tobytes(), ends.tobytes(), *frames])


class Image:
    """A shard image; the frames are decompressed when asked for."""

    def __init__(self, image: bytes, dictionary: bytes):
        if image[:8] != MAGIC or image[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("no shard image, or one of another dictionary")
        (n,) = struct.unpack_from("<I", image, 40)
        at, self.image, self.unpacker, self.n = 44, image, _unpacker(dictionary), n
        self.null = np.frombuffer(image, np.uint8, n, at)
        self.doc_ids = np.frombuffer(image, "<i8", n, at := at + n)
        self.counts = np.frombuffer(image, "<u4", n, at := at + 8 * n)
        self.ends = np.frombuffer(image, "<u8", n + 1, at := at + 4 * n)
        self.frames = at + 8 * (n + 1)

    def serialized(self, i: int) -> bytes:
        a, b = int(self.ends[i]), int(self.ends[i + 1])
        return self.unpacker.decompress(self.image[self.frames + a : self.frames + b], max_output_size=4 * int(self.counts[i]))

    def ids(self, doc_id: int) -> np.ndarray:
        """The ids of one document, of which only its frame is decompressed."""
        return np.frombuffer(self.serialized(int(np.flatnonzero((self.doc_ids == doc_id) & (self.null == 0))[0])), "<u4")


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """The documents' ids as shard images at ``path``/images, the dictionary at ``path``/dictionary."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    lot = F.xxhash64(F.lit("dictionary"), "doc_id", "text")
    chosen = docs.filter(F.pmod(lot, F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))).withColumn("_lot", lot).dropDuplicates(["_lot"]).select("doc_id", "text")
    end = struct.pack("<I", END_ID)

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", PART):
                yield part, [x + end for x in encoder.encode(part.column("text"))]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in serialize(batches):
            # of long ones a window from anywhere, for training alone
            begins = [4 * (zlib.crc32(x) % ((len(x) - SAMPLED) // 4)) if len(x) > SAMPLED + 4 else 0 for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array([x[a : a + SAMPLED] for a, x in zip(begins, ids, strict=True)], pa.binary())], ["ids"])

    samples = sorted(bytes(r["ids"]) for r in chosen.mapInArrow(trimmed(sampled), "ids binary").limit(4 * SAMPLE).collect())
    dictionary = train(samples) or b"".join(samples)[-DICTIONARY:]
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared, sha = spark.sparkContext.broadcast(dictionary), hashlib.sha256(dictionary).digest()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _packer(shared.value)
        for part, ids in serialize(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([packer.compress(x) for x in ids], pa.binary())],
                ["doc_id", "n", "crc", "frame"],
            )

    # written, so that bounds are sampled from what is sorted; the place parts equal documents
    docs.mapInArrow(trimmed(compress), "doc_id long, n long, crc long, frame binary").withColumn("place", F.monotonically_increasing_id()).write.option("compression", "none").parquet(f"{path}/frames")
    frames = spark.read.parquet(f"{path}/frames")
    order = [F.col("doc_id").asc_nulls_last(), "n", "crc", "place"]
    sorted_frames = frames.repartitionByRange(max(1, -(-n // SHARD)), *order).sortWithinPartitions(*order).select("doc_id", "n", "frame")

    def pack_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId() if task else 0
        ids, counts, held, size, block = [], [], [], 0, 0

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([pack(ids, counts, held, sha)], pa.binary())], ["shard", "block", "n_tokens", "image"]
            )

        for batch in batches:
            for doc_id, n_ids, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                if size >= IMAGE:
                    yield image()
                    block += 1
                    ids, counts, held, size = [], [], [], 0
                ids.append(doc_id)
                counts.append(n_ids)
                held.append(frame)
                size += len(frame)
        if held:
            yield image()

    sorted_frames.mapInArrow(trimmed(pack_up), "shard int, block long, n_tokens long, image binary").write.option("compression", "none").parquet(f"{path}/images")


def read_shards(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids, from the files at ``path``."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    shared = spark.sparkContext.broadcast(dictionary)
    images = spark.read.parquet(f"{path}/images")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                image = Image(batch.column("image")[row].as_py(), shared.value)
                counts = image.counts.astype(np.int64)
                texts = [image.serialized(i) for i in range(image.n)]
                columns = [
                    pa.array([batch.column("shard")[row].as_py()] * image.n, pa.int32()), pa.array([batch.column("block")[row].as_py()] * image.n, pa.int64()),
                    pa.array(image.doc_ids, pa.int64(), mask=image.null.astype(bool)), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in texts], pa.list_(pa.int32()))] if ids else []), names)

    schema = "shard int, block long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]
    blocks = images.select("shard", "block", F.col("n_tokens").alias("total"))
    # a block starts after the groups of shards, the shards of its group and the blocks of its shard before it
    sums = blocks.groupBy("shard").agg(F.sum("total").alias("n")).withColumn("group", F.floor(F.col("shard") / GROUP))
    before, rows = 0, []
    for r in sums.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect():  # a row for GROUP shards
        rows.append((r["group"], before))
        before += r["n"]
    groups = spark.createDataFrame(rows, "group long, group_start long")
    running = F.sum("n").over(Window.partitionBy("group").orderBy("shard")) - F.col("n")
    begins = sums.withColumn("within", running).join(F.broadcast(groups), "group").select("shard", (F.col("group_start") + F.col("within")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block")
    starts = blocks.withColumn("block_start", F.sum("total").over(within) - F.col("total")).join(begins, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("_start"))
    found = images.select("shard", "block", "image").mapInArrow(trimmed(run), schema)
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * ids))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-shards")
    write_shards(read(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
