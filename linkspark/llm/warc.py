"""WARC archives as chunked record tables (op8).

A record is its WARC header and, for a response, an HTTP header and the payload, cut into rows (archive, record,
chunk, chunks, running, data) of ``CHUNK`` bytes; `running` is the SHA-1 of the payload up to that chunk's end. Rows
are written as Parquet, which any store of Spark's holds; the data of a record's rows, one after the other, are its
bytes in an archive. Reading streams the chunks of a record in order and holds one of them at a time.

A payload that equals that of a record with a smaller page_id, if it has ``min_bytes`` bytes or more, is written as a
revisit: its header names the response, the payload's digest and its length, and it has no payload. Which records are
revisits is found from ids and digests alone. They are counted, and broadcast if few; else a set of bits leaves the
payloads that are surely responses where they are, and only the others are shuffled.

Record ids are UUIDs by the page's id and payload under a new one for each call, so that a task that runs again writes
the same; of rows that share both, by their place too (a revisit of these names their page and URL, but no record).
Dates are the call's. Reading checks each chunk's running digest, the payload's digest and its length.

Defined results: null html is an empty payload. Rows that share both page_id and payload are responses each if theirs
is the smallest page_id. Null page_ids come last: they revisit any other, and with each other are all responses. A null
url is an empty target. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bit_set, hold, in_bits, read, salted_join, scratch

CHUNK = 1 << 20
MIN_BYTES = 0
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: So many revisits at most are broadcast.
BROADCAST_REVISITS = 100_000
_LAST = 0x7FFFFFFFFFFFFFFF


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(run: str, page_id: int | None, sha1: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), f'{page_id} {sha1} {place}')}>"


def _target(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _records(batches: Iterator[pa.RecordBatch], run: str, date: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    archive, count = task.partitionId() if task else 0, 0
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "record", "chunk", "chunks", "running", "data"])

    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "bytes", "sha1", "refers_to", "refers_url", "refers_many", "revisit", "many", "html")]
        for i in range(batch.num_rows):
            page_id, url, size, sha1, refers_to, refers_url, refers_many, revisit, many = (c[i].as_py() for c in columns[:-1])
            value = columns[-1][i]
            payload = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
            record = f"{archive}-{count}"
            count += 1
            head = {
                "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(run, page_id, sha1, record if revisit or many else ""), "WARC-Date": date, "X-Page-ID": "" if page_id is None else page_id,
                "WARC-Target-URI": _target(url), "WARC-Payload-Digest": f"sha1:{base32(bytes.fromhex(sha1))}", "X-Payload-Length": size, "Content-Type": "application/http; msgtype=response",
            }
            if revisit:
                head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": "" if refers_to is None else refers_to, "WARC-Refers-To-Target-URI": _target(refers_url), "WARC-Refers-To-Date": date}
                if not refers_many:
                    head["WARC-Refers-To"] = record_id(run, refers_to, sha1)
                payload = memoryview(b"")
            head["Content-Length"] = len(HTTP) + len(payload)
            start = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
            chunks, digest = max(1, -(-len(payload) // CHUNK)), hashlib.sha1()
            for k in range(chunks):
                part = payload[k * CHUNK : (k + 1) * CHUNK]
                digest.update(part)
                data = b"".join([start.encode() + HTTP if k == 0 else b"", part, b"\r\n\r\n" if k == chunks - 1 else b""])
                rows.append((archive, record, k, chunks, digest.hexdigest(), data))
                held += len(data)
                if held >= 8 * CHUNK:
                    yield out()
                    rows, held = [], 0
    if rows:
        yield out()


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha1"), payload.alias("html"))
    order = F.coalesce("page_id", F.lit(_LAST))
    # a row for each page and payload, without the payload
    known = hold(rows.select(order.alias("_page"), "url", "sha1", "bytes").groupBy("_page", "sha1").agg(F.min("bytes").alias("bytes"), F.min("url").alias("url"), F.count("*").alias("n")))
    sized = known.filter(F.col("bytes") >= min_bytes)
    least = F.min(F.struct("_page", "url", (F.col("n") > 1).alias("many")))
    shared = sized.groupBy("sha1").agg(least.alias("_first"), F.max("_page").alias("_max")).filter("_first._page < _max").select("sha1", "_first")
    later = salted_join(sized.select("_page", "sha1"), shared, ["sha1"], "inner", ["_page"]).filter("_page > _first._page").select("_page", "sha1", "_first")
    # what a row doesn't know by itself: that it is a revisit, or one of several rows of one page and payload
    told = hold(known.filter("n > 1").select("_page", "sha1", F.lit(True).alias("many")).join(later, ["_page", "sha1"], "full").withColumn("many", F.coalesce("many", F.lit(False))))
    keyed, on = rows.withColumn("_page", order), ["_page", "sha1"]
    if told.count() <= BROADCAST_REVISITS:
        marked = keyed.join(F.broadcast(told), on, "left")
    else:
        bits = bit_set(told.select(F.xxhash64(*on).alias("place")))
        if bits is None:
            marked = keyed.join(told, on, "left")
        else:
            shared_bits = pages.sparkSession.sparkContext.broadcast(bits)

            @arrow_udf("boolean")
            def may_be(places: pa.Array) -> pa.Array:
                return pa.array(in_bits(shared_bits.value, places.to_numpy(zero_copy_only=False).view(np.uint64)))

            keyed = keyed.withColumn("_place", F.xxhash64(*on))
            marked = keyed.filter(~may_be("_place")).unionByName(keyed.filter(may_be("_place")).join(told, on, "left"), allowMissingColumns=True)
    first = F.col("_first")
    marked = marked.select(
        "page_id", "url", "bytes", "sha1", first["_page"].alias("refers_to"), first["url"].alias("refers_url"), first["many"].alias("refers_many"), first.isNotNull().alias("revisit"), F.coalesce("many", F.lit(False)).alias("many"),
        F.when(first.isNull(), F.col("html")).alias("html"),
    )
    schema = "archive int, record string, chunk int, chunks int, running string, data binary"
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    marked.mapInArrow(partial(_records, run=str(uuid.uuid4()), date=date), schema).write.option("compression", "zstd").parquet(path)
    told.unpersist()
    known.unpersist()


def _parse(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


class _Reader:
    """A record from its chunks."""

    def __init__(self):
        self.head, self.digest, self.size = b"", hashlib.sha1(), 0
        self.fields: dict[str, str] | None = None

    def feed(self, data: memoryview, last: bool, running: str) -> None:
        if self.fields is None:
            whole = bytes(data)
            header, _, rest = whole.partition(b"\r\n\r\n")
            self.fields = _parse(header)
            data = memoryview(rest)[len(HTTP) :]
        data = data[: len(data) - 4] if last else data
        self.digest.update(data)
        self.size += len(data)
        if self.digest.hexdigest() != running:
            raise ValueError(f"a chunk of record {self.fields['WARC-Record-ID']} isn't what its running digest says")

    def row(self) -> tuple:
        f = self.fields
        revisit = f["WARC-Type"] == "revisit"
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (digest != base32(self.digest.digest()) or self.size != int(f["X-Payload-Length"])):
            raise ValueError(f"the payload of record {f['WARC-Record-ID']} isn't what its header says")
        number = lambda key: int(f[key]) if f.get(key) else None
        return number("X-Page-ID"), f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, f["WARC-Type"], number("X-Refers-To-Page-ID")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = None
    for batch in batches:
        rows = []
        chunk, chunks, data, running = (batch.column(c) for c in ("chunk", "chunks", "data", "running"))
        for i in range(batch.num_rows):
            k, n = chunk[i].as_py(), chunks[i].as_py()
            if k == 0:
                reader = _Reader()
            reader.feed(memoryview(data[i].as_buffer()), k == n - 1, running[i].as_py())
            if k == n - 1:
                rows.append(reader.row())
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record; payloads are checked."""
    rows = spark.read.parquet(path).select("record", "chunk", "chunks", "running", "data")
    many = rows.filter("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return rows.filter("chunks = 1").mapInArrow(_read, schema).unionByName(many.mapInArrow(_read, schema))


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")


