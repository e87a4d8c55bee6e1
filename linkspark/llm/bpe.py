"""Byte-level BPE by monoid tree reduction (op4).

A text is halved down to leaves, each leaf is encoded by the tokenizer, and neighbours are joined up the tree. A
join re-encodes a window about the border: it grows to both sides, doubling, until it ends at places where a space
or line feed follows a character that isn't white space. No alternative of the pattern matches across such a place,
and what is matched from there on depends on the rest of the text alone, so the tokens outside the window are those
of the whole text. Where a half has no such place, the window takes all of it. Decoding splits the ids in halves
and concatenates their bytes up the tree.

Defined results: a null text is encoded as an empty one (no ids). Repeated rows are encoded each. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read, trimmed

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf, characters that a window first takes of each half, ids of a leaf in decoding.
LEAF, WINDOW, DECODED = 2048, 32, 1024


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _certain(text: str, at: int) -> bool:
    """Does a match of the pattern always begin at ``at``?"""
    return text[at] in " \n" and not text[at - 1].isspace()


def _left_edge(text: str, start: int, middle: int) -> int:
    """The last certain place in ``text[start:middle]``, looked for in growing windows, or ``start``."""
    size, seen = WINDOW, middle
    while seen > start:
        low = max(start, middle - size)
        for at in range(seen - 1, max(low, start + 1) - 1, -1):
            if _certain(text, at):
                return at
        seen, size = low, 2 * size
    return start


def _right_edge(text: str, middle: int, end: int) -> int:
    """The first certain place in ``text[middle + 1:end]``, looked for in growing windows, or ``end``."""
    size, seen = WINDOW, middle + 1
    while seen < end:
        high = min(end, middle + size)
        for at in range(seen, high):
            if _certain(text, at):
                return at
        seen, size = max(seen, high), 2 * size
    return end


def encode(text: str, leaf: Callable[[str], list[int]], start: int = 0, end: int | None = None, size: int = LEAF) -> list[int]:
    """The ids of ``text[start:end]``."""
    end = len(text) if end is None else end
    if end - start <= size:
        return leaf(text[start:end])
    middle = (start + end) // 2
    if middle > start and _certain(text, middle):
        return encode(text, leaf, start, middle, size) + encode(text, leaf, middle, end, size)
    left, right = _left_edge(text, start, middle), _right_edge(text, middle, end)
    if left == start or right == end:  # the window takes a whole half: there is nothing to keep of its tokens
        head = encode(text, leaf, start, left, size) if left > start else []
        tail = encode(text, leaf, right, end, size) if right < end else []
        return head + leaf(text[left:right]) + tail
    a, b = encode(text, leaf, start, middle, size), encode(text, leaf, middle, end, size)
    return a[: len(a) - len(leaf(text[left:middle]))] + leaf(text[left:right]) + b[len(leaf(text[middle:right])) :]


def decode(ids: list[int], leaf: Callable[[list[int]], bytes], size: int = DECODED) -> bytes:
    if len(ids) <= size:
        return leaf(ids)
    half = len(ids) // 2
    return decode(ids[:half], leaf, size) + decode(ids[half:], leaf, size)


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the decoded bytes, the ids and, if wanted, the decoded bytes."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                counts, shas, digests, lists, whole = [], [], [], [], []
                for text in part.column("text"):
                    got = encode(text.as_py() or "", enc.encode_ordinary)
                    array = np.array(got, "<u4")
                    counts.append(len(got))
                    shas.append(hashlib.sha256(array.tobytes()).hexdigest())
                    back = decode(got, enc.decode_bytes)
                    digests.append(hashlib.sha256(back).hexdigest())
                    if ids:
                        lists.append(array.astype(np.int32))
                    if decoded:
                        whole.append(back)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if ids else []) + ([pa.array(whole, pa.binary())] if decoded else []), names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded binary" * decoded
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), ids=False)
