"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the folder that spark.checkpoint.dir names, and go on from there.

    Only where the session names no folder a temporary one is set, and that on one machine alone.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hold(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, when it is first read, onto the executors' disks, until ``unpersist``: for what is read a few
    times at once. A block is a plain file, while a checkpoint or Parquet file goes through Hadoop, which without its
    native library starts a chmod for each file and for its checksums, and a process that starts shares all of the
    executor's memory. A lost block is computed again. Not for many steps, each on
    the one before: the plan of what is held is part of each plan that reads it.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nothing refers to any more: it does so after a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system: Arrow's pool and the C library keep it, and a worker that waits for its
    next task would hold what its largest one took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a task gives its memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: for what a checkpoint would make too large."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, made ready for checkpoints."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return named or sc.getCheckpointDir()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def field(df: DataFrame, name: str):
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, salt_by: list[str], salts: int = 16) -> DataFrame:
    """``left`` joined to ``right``, of one short row a key, where a key may hold a third of ``left``.

    Every row of ``left`` gets one of ``salts`` numbers from ``salt_by``, and ``right`` is repeated for each,
    so that a hot key is dealt to as many tasks. Null keys match nothing.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(many, [*keys, "_salt"], how).drop("_salt")


#: Bits of a filter by the rows it is for; beyond the most, which is 256 MB of broadcast, none is made.
FILTER_BITS, LEAST_FILTER, MOST_FILTER = 16, 1 << 20, 1 << 31
_FILTER_ROW = 1 << 16


def bit_set(places: DataFrame) -> np.ndarray | None:
    """A set of bits, one for each of the rows' longs (column `place`) by its size; sized from their number, which is
    counted. None if they are too many."""
    bits = LEAST_FILTER
    many = places.count()
    while bits < FILTER_BITS * many:
        bits *= 2
    if bits > MOST_FILTER:
        return None

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            place = batch.column("place").to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(own, (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        rows = [i for i in range(0, len(own), _FILTER_ROW) if own[i : i + _FILTER_ROW].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([pa.compress(own[i : i + _FILTER_ROW].tobytes(), "zstd", asbytes=True) for i in rows], pa.binary())], ["row", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, b in zip(batch.column("row").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                more = np.frombuffer(pa.decompress(b, _FILTER_ROW, "zstd", asbytes=True), np.uint8)
                sums[row] = sums[row] | more if row in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in places.select("place").mapInArrow(trimmed(some), "row long, bits binary").repartition("row").mapInArrow(trimmed(merge), "row long, bits binary").collect():
        out[r["row"] : r["row"] + _FILTER_ROW] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bits(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the places' bits are set."""
    place = places.astype(np.uint64) % np.uint64(8 * len(bits))
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of ``column`` (a longer row alone)."""
    lengths = batch.column(column).fill_null("").cast(pa.large_string()) if batch.num_rows else None
    if lengths is None:
        return
    ends = offsets(lengths)[1:] - offsets(lengths)[0]
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def offsets(texts: pa.Array) -> np.ndarray:
    """The byte offsets of a large_string array without nulls."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: none), one after the other, and the offset where each text starts."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = offsets(texts)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Spans:
    """64-bit hashes of byte spans: equal for equal bytes, wherever they stand."""

    def __init__(self, data: np.ndarray):
        powers = np.full(len(data) + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers[:-1], dtype=np.uint64, out=self.sums[1:])
        back = np.full(len(data) + 1, _INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + mix((end - start).astype(np.uint64)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The hashes of ascending spans that don't overlap, with memory for about ``step`` bytes of text at a time."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + step, "right")))
        high = int(end[to - 1])
        if high - low <= step:
            out[at:to] = Spans(data[low:high]).hash(start[at:to] - low, end[at:to] - low)
        else:  # one span longer than a step: its parts are added up, each by its place
            total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for a in range(low, high, step):
                part = data[a : min(high, a + step)]
                total += Spans(part).sums[-1] * power
                power *= np.uint64(pow(int(_BASE), len(part), 1 << 64))
            out[at] = mix(total + mix(np.array([high - low], np.uint64)))[0]
        at = to
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in texts that lie one after the other, and the number of its text."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of set flags in each text."""
    out = np.zeros(len(at) - 1, np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])  # of an empty one reduceat would give the next flag
    if len(full):
        out[full] = np.add.reduceat(flags, at[full], dtype=np.int64)
    return out


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, and does an equal one stand before it?"""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:]] = same
        twice[order[1:]] = same
        twice[order[:-1]] |= same
    return twice, later
