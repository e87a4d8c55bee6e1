"""N-gram Jaccard join by prefix trees (op10).

A document's set holds the 64-bit hashes of its shingles of some words, three in op10 and five in the pipeline (A-Z
lower-cased; with fewer words, of the whole sequence). Equal sets are one node, so that copies never meet each other.
All sets are ordered alike, by hash, but last the shingles whose bucket is much fuller than others in a count sketch of
fixed size over the whole corpus. Two sets of a similarity of s, 0.9 in op10 and 0.8 in the pipeline, share one among
the first n - ceil(s n) + 1 of each:

1. one pass over the texts gives the nodes, with the parities of their set over 512 buckets or more, and the sketch;
2. one gives the postings of those first shingles; the ones that a single node has go;
3. in two of its lists, each node is checked with the compatible partner that is nearest, and links are joined into
   components. Nodes are compatible if their sizes are, and if the difference of their parities, which is never more
   than that of the sets, is small enough; the nearest are those of the least difference, as of many copies of one text
   each is near to that, but not to all the others;
4. lists whose nodes are all of one component go; in the others, each component is checked with the nearest compatible
   node of another, and links are joined again;
5. in the lists that still have several components, all compatible pairs of different ones are checked. That leaves out no link between components, and few pairs within one. A long list is split: its largest
   component in blocks against blocks of all others, and these against each other. For a check, one pass over the
   texts gives the ordered sets it needs.

A check puts the ordered sets of many candidates into a prefix tree and walks it with the set of one node: the
overlap with a shared beginning is counted once, and a subtree is left as soon as what remains of both can't reach
the overlap that its smallest set needs.

Large sets post some of their prefix only, so few that the chance that linked sets share none is ``MISSED`` at most;
``missed=None`` posts whole prefixes, and is exact but for equal hashes.

Defined results: a null text, or one without words, has an empty set and links with nothing. A null doc_id takes part;
component_id is the smallest doc_id that isn't null (null if there is none). Repeated rows are copies. An empty table
gives an empty result. Long texts are hashed in windows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import WORD, bit_set, cut, fresh, in_bits, mix, pieces, read, release, salted_join, span_hashes, table, trimmed, utf8, words

#: op10's words of a shingle and least similarity, as a part of 100.
SHINGLE, SIMILARITY = 3, 90
#: Those of the pipeline's near duplicates.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 80
#: Buckets of the sketch and of its rows.
SKETCH, ROW = 1 << 21, 1 << 16
#: Bits of a set's parities, by the size above which a set has them. Each number divides the next.
PARITIES = {0: 512, 1024: 2048, 8192: 8192}
#: Longer posting lists are split into blocks of about this many nodes; sets checked with one node at a time.
BLOCK, BUNDLE = 1024, 256
#: The chance that linked sets share none of the postings of a set that is mostly of shingles that aren't hot.
MISSED = 0.2**32
#: Tokens of a trie's edge that are counted at once.
EDGE = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def needed(a, b, similarity: int = SIMILARITY):
    """The least overlap of sets of these sizes that link."""
    return -(-(similarity * (a + b)) // (100 + similarity))


def postings_enough(similarity: int = SIMILARITY) -> int | None:
    """So many postings are enough for a set of which half or more isn't hot; None: all of its prefix are needed."""
    apart = 2 * (100 - similarity) / 100
    return math.ceil(round(math.log(MISSED, apart), 6)) if 0 < apart < 1 else None


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct hashes."""
    data, at = utf8(texts)
    data = _LOWER[data]
    start, end, text = words(data, at)
    hashes = span_hashes(data, start, end)
    first = np.searchsorted(text, np.arange(len(at)))
    rolled = hashes[: max(0, len(hashes) - size + 1)].copy()
    for k in range(1, size):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole]) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _parities(found: np.ndarray) -> bytes:
    """Whether each of some buckets, more for large sets, holds an odd number of the set. Two sets whose bits differ
    in d places differ in d shingles at least: one in each of these buckets."""
    bits = max(b for above, b in PARITIES.items() if len(found) > above or not above)
    return np.packbits(np.bincount((found >> np.uint64(20)) % np.uint64(bits), minlength=bits).astype(np.uint8) & 1).tobytes()


def _levels(parities: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of bits of PARITIES: the place of each set that has so many in a matrix of them (-1: it has
    fewer), and the matrix. More bits fold to fewer, as a bucket of few is the sum of some of many."""
    size = np.array([len(x) for x in parities])
    out = []
    for bits in PARITIES.values():
        rows = np.flatnonzero(8 * size >= bits)
        matrix = np.zeros((len(rows), bits // 64), np.uint64)
        for more in PARITIES.values():
            own = np.flatnonzero(8 * size[rows] == more)
            if len(own):
                whole = np.frombuffer(b"".join(parities[k] for k in rows[own]), np.uint64)
                matrix[own] = np.bitwise_xor.reduce(whole.reshape(len(own), more // bits, bits // 64), axis=1)
        place = np.full(len(size), -1)
        place[rows] = np.arange(len(rows))
        out.append((place, matrix))
    return out


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(43)).astype(np.int64)


def hot(sketch: np.ndarray) -> np.ndarray:
    """The sketch with 0 for all but buckets that are much fuller than the mean one."""
    return np.where(sketch > 32 + 4 * (sketch.sum(dtype=np.uint64) / SKETCH), sketch, 0).astype(np.uint32)


def ordered(found: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A sorted set in the order of all sets: shingles that aren't hot by hash, the others by fullness and hash."""
    return found[np.argsort(sketch[_bucket(found)], kind="stable")]


def prefix(found: np.ndarray, sketch: np.ndarray, similarity: int = SIMILARITY, missed: float | None = MISSED) -> np.ndarray:
    """The first shingles of a sorted set that its postings are made of: all of its prefix, if ``missed`` is None.

    Else, of a set of which a share h is hot, some are enough: without the hot ones, sets that link at a similarity of
    s, one of which has a hot share of h at most, have a similarity of (s - h) / (1 - h) at least, so a part of
    (1 - s) / (1 - h) of their union isn't common. The first by hash are a random sample of that union, so that the
    chance that sets share none of the first k is that part to the power of k (for the smaller k of the two, which
    goes with the smaller h). Without hot shingles 23 are enough for 0.9 and 32 for 0.8.
    """
    many = len(found) + (-similarity * len(found)) // 100 + 1
    if missed is not None and len(found):
        hot_share = int((sketch[_bucket(found)] != 0).sum()) / len(found)
        apart = (100 - similarity) / 100 / (1 - hot_share) if hot_share < 1 else 1.0
        if apart < 0.5:
            many = min(many, math.ceil(round(math.log(missed) / math.log(apart), 6)))
    return ordered(found, sketch)[:many]


_NODES = "doc_id long, key binary, n long, node binary, parities binary, row int, counts binary"


def _first_pass(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """A row for each document; at the end the task's counts, a row for each ROW buckets of the sketch."""
    names = [x.split()[0] for x in _NODES.split(", ")]
    counts, seen, held, many = np.zeros(SKETCH, np.uint32), set(), [], 0

    def count() -> None:
        nonlocal counts, held, many
        if held:
            counts += np.bincount(_bucket(np.concatenate(held)), minlength=SKETCH).astype(np.uint32)
        held, many = [], 0

    for batch in batches:
        for part in pieces(batch, "text"):
            sets = shingle_sets(part.column("text"), shingle)
            nodes = [_digest(s) if len(s) else None for s in sets]
            for node, s in zip(nodes, sets, strict=True):
                if node is not None and node not in seen:  # most copies count once
                    seen.add(node)
                    held.append(s)
                    many += len(s)
            if many > 1 << 21:
                count()
            if len(seen) > 200_000:
                seen.clear()
            empty = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([_parities(s) if len(s) else None for s in sets], pa.binary()), empty.cast(pa.int32()), empty.cast(pa.binary())], names
            )
    count()
    rows = [i for i in range(SKETCH // ROW) if counts[i * ROW : (i + 1) * ROW].any()]
    if rows:
        none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(rows, pa.int32()), pa.array([pa.compress(counts[i * ROW : (i + 1) * ROW].tobytes(), "zstd", asbytes=True) for i in rows], pa.binary())], names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            more = np.frombuffer(pa.decompress(counts, 4 * ROW, "zstd", asbytes=True), np.uint32)
            sums[row] = sums[row] + more if row in sums else more.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "counts"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sketch: SKETCH numbers, whatever the corpus."""
    out = np.zeros(SKETCH, np.uint32)
    sums = rows.filter("row is not null").select("row", "counts").repartition("row").mapInArrow(trimmed(_add_up), "row int, counts binary")
    for r in sums.collect():
        out[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(r["counts"], np.uint32)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys``; a group isn't parted between tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        at = batch.num_rows - 1
        while at > 0 and all(batch.column(k)[at - 1] == x for k, x in zip(keys, last, strict=True)):
            at -= 1
        if at == 0 and held and all(held[-1].column(k)[held[-1].num_rows - 1] == x for k, x in zip(keys, last, strict=True)):
            held.append(batch)
            continue
        if at or held:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def _pairs_within(sizes: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of positions within consecutive groups of these sizes, or those with i below ``first[j]``."""
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(sizes.sum())
    many = (place if first is None else first) - begin  # partners before it
    j = np.repeat(place, many)
    i = np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    return i, j


def _slack(i: np.ndarray, j: np.ndarray, n: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the pairs i, j whose sizes and parities don't rule a link out, and by how many shingles not."""
    ok = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
    both = n[i[ok]] + n[j[ok]]
    allowed = both - 2 * needed(0, both, similarity)
    left = allowed.copy()
    for place, matrix in levels:
        if not len(matrix):
            continue
        kept, slacks, step = [], [], (1 << 21) // matrix.shape[1]
        for a in range(0, len(ok), step):
            part = ok[a : a + step]
            x, y = place[i[part]], place[j[part]]
            apart = np.bitwise_count(matrix[x] ^ matrix[y]).sum(1, dtype=np.int64)
            now = np.where((x < 0) | (y < 0), left[a : a + step], allowed[a : a + step] - apart)
            kept.append(now >= 0)
            slacks.append(now)
        if kept:
            keep = np.concatenate(kept)
            ok, allowed, left = ok[keep], allowed[keep], np.concatenate(slacks)[keep]
    return ok, left


def _compatible(i: np.ndarray, j: np.ndarray, n: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], similarity: int = SIMILARITY) -> np.ndarray:
    return _slack(i, j, n, levels, similarity)[0]


def _nearest(i: np.ndarray, j: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """For each number that some of the pairs have, on either side, the pair of greatest slack (then the first)."""
    own, pair = np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, -slack[pair], own))
    first = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(order) else np.zeros(0, bool)
    return np.unique(pair[order[first]])


#: Candidate pairs that a task holds before it hands them on, and that it remembers to have handed on.
HELD = 100_000


def _pair_batch(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _candidates(labelled: bool, every: bool, similarity: int) -> Callable:
    """From posting lists (key, side, node, n, parities, label), sorted by key, label and node: every compatible pair of
    different labels, or for each label of a list (each node, if they have none) that which is nearest by parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[bytes, bytes]] = set()
        for table in _groups(batches, ["key"]):
            table = table.combine_chunks()
            key = table.column("key").to_numpy()
            node = np.array(table.column("node").to_pylist(), object)
            n = table.column("n").to_numpy().astype(np.int64)
            levels = _levels(table.column("parities").to_pylist())
            side = table.column("side").to_numpy()
            new = np.concatenate([[True], key[1:] != key[:-1]])
            edges = np.flatnonzero(new)
            sizes = np.diff(np.append(edges, len(key)))
            # pairs of one label needn't be made: partners stand before the first of the same list and label
            first = np.arange(len(key))
            if labelled:
                label = np.array(table.column("label").to_pylist(), object)
                starts = np.flatnonzero(new | np.concatenate([[True], label[1:] != label[:-1]]))
                first = np.repeat(starts, np.diff(np.append(starts, len(key))))
            work = np.add.reduceat(first - np.repeat(edges, sizes), edges) if len(edges) else np.zeros(0, np.int64)
            found: set[tuple[bytes, bytes]] = set()
            done = 0
            while done < len(sizes):  # some millions of pairs at a time
                to = done + max(1, int(np.searchsorted(np.cumsum(work[done:]), 1 << 21, "right")))
                base = edges[done]
                end = edges[to] if to < len(edges) else len(key)
                i, j = _pairs_within(sizes[done:to], first[base:end] - base)
                i, j = i + base, j + base
                keep = (side[i] != side[j]) | (side[i] == 2)
                i, j = i[keep], j[keep]
                ok, slack = _slack(i, j, n, levels, similarity)
                if not every:
                    ok = ok[_nearest(first[i[ok]], first[j[ok]], slack)]  # where a list's label, or node, begins
                for part in range(0, len(ok), HELD):
                    some = ok[part : part + HELD]
                    found.update((min(a, b), max(a, b)) for a, b in zip(node[i[some]], node[j[some]], strict=True) if a != b)
                    found -= told
                    if len(found) >= HELD:
                        yield _pair_batch(found)
                        told = found
                        found = set()
                done = to
            if found:
                yield _pair_batch(found)
                told = found if len(told) > HELD else told | found

    return run


def walk(probe: np.ndarray, sets: list[np.ndarray], similarity: int = SIMILARITY) -> Iterator[int]:
    """The numbers of the ordered sets that link with the ordered set ``probe``, by a walk of their prefix tree.

    The tree's nodes are ranges of the lexicographically sorted sets that share a beginning of some length."""
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    mine, a = np.sort(probe), len(probe)
    lengths = np.array([len(sets[k]) for k in order])
    stack = [(0, len(order), 0, 0)]
    while stack:
        low, high, depth, overlap = stack.pop()
        least, most = int(lengths[low:high].min()), int(lengths[low:high].max())
        if overlap + min(a - overlap, most - depth) < needed(a, least, similarity):
            continue
        first, last = sets[order[low]], sets[order[high - 1]]
        end = min(len(first), len(last), depth + EDGE)
        differ = np.flatnonzero(first[depth:end] != last[depth:end])
        end = depth + int(differ[0]) if len(differ) else end
        edge = first[depth:end]
        if len(edge):
            overlap += int((mine[np.minimum(np.searchsorted(mine, edge), a - 1)] == edge).sum())
        while low < high and lengths[low] == end:  # sets that end here come first
            if overlap >= needed(a, end, similarity):
                yield order[low]
            low += 1
        if low < high and len(differ):
            at = low
            while at < high:
                token, to = sets[order[at]][end], at + 1
                while to < high and sets[order[to]][end] == token:
                    to += 1
                stack.append((at, to, end, overlap))
                at = to
        elif low < high:
            stack.append((low, high, end, overlap))


def _check(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Links from bundles (a, bundle, node, tokens), where the node a itself stands among its candidates."""
    for table in _groups(batches, ["a", "bundle"]):
        a, bundle = table.column("a").to_pylist(), table.column("bundle").to_pylist()
        node, tokens = table.column("node").to_pylist(), table.column("tokens").to_pylist()
        begin, links = 0, []
        for end in range(1, len(a) + 1):
            if end < len(a) and a[end] == a[begin] and bundle[end] == bundle[begin]:
                continue
            probe = next((np.frombuffer(tokens[k], np.uint64) for k in range(begin, end) if node[k] == a[begin]), None)
            others = [k for k in range(begin, end) if node[k] != a[begin]]
            links += [(a[begin], node[others[k]]) for k in walk(probe, [np.frombuffer(tokens[k], np.uint64) for k in others], similarity)]
            begin = end
        if links:
            x, y = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])


def _links(pairs: DataFrame, docs: DataFrame, sketch, shingle: int, similarity: int) -> DataFrame:
    """Those of the pairs that link."""
    active = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    sets = _sets(docs, active, sketch, shingle)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BUNDLE).alias("_k"))
    many = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "_k").alias("bundle"), "b")
    members = many.select("a", "bundle", F.col("b").alias("node")).unionByName(many.select("a", "bundle", F.col("a").alias("node")).distinct())
    filled = members.join(sets, "node").repartition("a", "bundle").sortWithinPartitions("a", "bundle")
    return cut(filled.select("a", "bundle", "node", "tokens").mapInArrow(trimmed(partial(_check, similarity=similarity)), "a binary, b binary"))


#: So many links are joined in one task, which holds some 30 MB then; more in rounds over all tasks, each of many stages.
FEW = 1 << 18


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label from links a, b: the least node that links connect with it."""
    held = list(batches)
    a, b = (pa.chunked_array([x.column(c) for x in held], pa.binary()) for c in ("a", "b"))
    if not len(a):
        return
    nodes = pc.unique(pa.chunked_array([*a.chunks, *b.chunks]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    over = list(range(len(nodes)))  # the places of nodes in the same component, never greater

    def least(x: int) -> int:
        while over[x] != x:
            over[x] = x = over[over[x]]
        return x

    for x, y in zip(*(pc.index_in(c, value_set=nodes).to_pylist() for c in (a, b)), strict=True):
        x, y = least(x), least(y)
        if x < y:
            over[y] = x
        else:
            over[x] = y
    for at in range(0, len(nodes), 10_000):
        own = range(at, min(len(nodes), at + 10_000))
        yield pa.RecordBatch.from_arrays([nodes.slice(at, len(own)), nodes.take(pa.array([least(x) for x in own]))], ["node", "label"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """node, label of all nodes that have a link: the same label where links connect them, the least of their nodes.

    Of more than ``few`` links every node takes the least label of its neighbours and itself, then the label of its
    label, until none changes.
    """
    if links.count() <= few:
        return cut(links.select("a", "b").coalesce(1).mapInArrow(trimmed(_join_up), "node binary, label binary"))
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("new"), "label")
        jump = better.select(F.col("node").alias("_n"), F.col("new").alias("_l"))
        after = cut(better.join(jump, better["new"] == jump["_n"], "left").select("node", F.least("new", "_l").alias("new"), "label"))
        changed = after.filter("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: these join labels, of which there are fewer than nodes."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    every = cut(labels.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label")))
    of = lambda end: every.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    new = components(cut(joined.distinct())).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return cut(every.join(new, "label", "left").select("node", F.coalesce("_new", "label").alias("label")))


#: Keys of hot shingles are dealt to so many tasks; a shingle that isn't hot has few postings by the sketch.
SALTS = 16


def _shared_lists(listed: DataFrame) -> DataFrame:
    """key, node, n, df: the postings (key, hot, node, n) whose key two nodes or more have. Those of one key are
    shuffled once, and counted and joined where they are then."""
    node = F.xxhash64("node")
    stats = [F.min(node).alias("low"), F.max(node).alias("high"), F.count("*").alias("df")]
    cold = listed.filter(~F.col("hot")).select("key", "node", "n").repartition("key")
    several = cold.groupBy("key").agg(*stats).filter("low <> high").select("key", "df")
    out = cold.join(several, "key").select("key", "node", "n", "df").distinct()
    warm = listed.filter("hot").select("key", "node", "n")
    return out.unionByName(salted_join(warm, warm.groupBy("key").agg(*stats).filter("low <> high").select("key", "df"), ["key"], "inner", ["node"], SALTS).select("key", "node", "n", "df").distinct())


def _blocks(lists: DataFrame) -> DataFrame:
    """key, side, node, n, label: lists of several labels (key, node, n, label, df), the long ones split so that each
    two nodes of different labels meet once or more, and no list has over about 2 * BLOCK."""
    small = lists.filter(F.col("df") <= 2 * BLOCK).select("key", F.lit(2).alias("side"), "node", "n", "label")
    large = lists.filter(F.col("df") > 2 * BLOCK)
    top = large.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    large = large.drop("df").join(top, "key")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    large = large.withColumns({"_own": F.col("label") == F.col("top.label"), "_a": blocks(F.col("top.c")), "_b": blocks(F.col("all") - F.col("top.c"))})
    large = large.withColumn("_at", F.pmod(F.xxhash64("node"), F.when(F.col("_own"), F.col("_a")).otherwise(F.col("_b"))).cast("int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    parts = []
    for own, other, names in ((True, "_b", ("_at", "_c")), (False, "_a", ("_c", "_at"))):  # the top label against the others
        met = large.filter(F.col("_own") == own).withColumn("_c", spread(F.col(other)))
        parts.append(met.select(F.xxhash64("key", F.lit("across"), *names).alias("key"), F.lit(int(own)).alias("side"), "node", "n", "label"))
    met = large.filter(~F.col("_own")).withColumn("_c", spread(F.col("_b")))
    side = F.when(F.col("_at") == F.col("_c"), 2).otherwise((F.col("_at") < F.col("_c")).cast("int"))
    parts.append(met.select(F.xxhash64("key", F.lit("among"), F.least("_at", "_c"), F.greatest("_at", "_c")).alias("key"), side.alias("side"), "node", "n", "label"))
    return small.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])


def _linked(docs: DataFrame, shingle: int, similarity: int, missed: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From doc_id, key, text: a row for each document (doc_id, key, n, node), the nodes, and the labels of those that
    have a link."""
    first = cut(docs.mapInArrow(trimmed(partial(_first_pass, shingle=shingle)), _NODES))
    sketch = docs.sparkSession.sparkContext.broadcast(hot(_sketch(first)))
    rows = first.filter("row is null").select("doc_id", "key", "n", "node", "parities")
    # copies meet here, a row for each task and node
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("parities").alias("parities"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = cut(nodes)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                keys, owners, sizes = [], [], []
                for s in shingle_sets(part.column("text"), shingle):
                    if not len(s) or (node := _digest(s)) in seen:
                        continue
                    seen.add(node)
                    keys.append(prefix(s, sketch.value, similarity, missed))
                    owners.append(node)
                    sizes.append(len(s))
                if len(seen) > 200_000:
                    seen.clear()
                if keys:
                    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                    every = np.concatenate(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(sketch.value[_bucket(every)] != 0), pa.array(owners, pa.binary()).take(pa.array(row)), pa.array(np.array(sizes, np.int64)[row])], ["key", "hot", "node", "n"])

    # a node's postings stand together: Parquet keeps the node once
    listed = table(docs.select("text").mapInArrow(trimmed(postings), "key long, hot boolean, node binary, n long"))
    lists = cut(_shared_lists(listed))
    release(docs.sparkSession)

    parities = nodes.select("node", "parities")
    two = F.row_number().over(Window.partitionBy("node").orderBy("key"))
    dealt = lists.withColumn("_two", two).filter("_two <= 2").join(parities, "node")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("df") / BLOCK))  # a long list's nodes meet within blocks only
    dealt = dealt.select(F.when(F.col("df") > 2 * BLOCK, F.xxhash64("key", block)).otherwise(F.col("key")).alias("key"), F.lit(2).alias("side"), "node", "n", "parities")
    near = cut(dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(trimmed(_candidates(False, False, similarity)), "a binary, b binary").distinct())
    labels = components(_links(near, docs, sketch, shingle, similarity))
    release(docs.sparkSession)
    for every in (False, True):
        labelled = lists.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).repartition("key")
        mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("df")).filter("low <> high").select("key", "df")
        again = _blocks(cut(labelled.join(mixed, "key"))).join(parities, "node").repartition("key").sortWithinPartitions("key", "label", "node")
        more = cut(again.mapInArrow(trimmed(_candidates(True, every, similarity)), "a binary, b binary").distinct())
        labels = merged(labels, _links(more, docs, sketch, shingle, similarity))
        release(docs.sparkSession)
    return rows.drop("parities"), nodes, labels


def link_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, missed: float | None = MISSED) -> DataFrame:
    """doc_id, n_shingles, component_id, by shingles of so many words and the least similarity as a part of 100."""
    rows, nodes, labels = _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("key"), "text"), shingle, similarity, missed)
    found = labels.join(nodes.select("node", "least"), "node")
    least = found.groupBy("label").agg(F.min("least").alias("component_id"))
    found = found.join(least, "label").select("node", "component_id")
    # what a document doesn't find in its own row: nodes of a link and nodes of copies
    known = cut(nodes.filter("copies > 1").select("node", "least", "copies").join(found, "node", "full").select("node", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies")))
    rows = rows.select("doc_id", "n", "node")
    # of a hundredth of all rows or more: 100 nodes at most, so they can be broadcast
    hot_nodes = known.filter(F.col("copies") >= F.lit(max(rows.count() // 100, 1000))).select("node", F.col("component_id").alias("_hot"), F.lit(True).alias("_is"))
    marked = rows.join(F.broadcast(hot_nodes), "node", "left")
    direct = marked.filter("_is").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_hot", "doc_id").alias("component_id"))
    rest = marked.filter("_is is null").select("doc_id", "n", "node").join(known.drop("copies"), "node", "left")
    return direct.unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def _sets(docs: DataFrame, active: DataFrame, sketch, shingle: int) -> DataFrame:
    """node, tokens of the active nodes. A set of bits leaves most others out before the join."""
    # a node's first eight bytes, by built-in functions: two Python steps in one stage would need twice the workers
    first = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(active.select(first.alias("place"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                nodes = [_digest(s) if len(s) else b"" for s in sets]
                wanted = np.array([len(s) > 0 for s in sets], bool)
                if shared.value is not None:
                    wanted &= in_bits(shared.value, np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in nodes), ">u8").astype(np.uint64))
                out = []
                for k in np.flatnonzero(wanted):
                    if nodes[k] not in seen:
                        seen.add(nodes[k])
                        out.append((nodes[k], ordered(sets[k], sketch.value).tobytes()))
                if len(seen) > 200_000:
                    seen.clear()
                if out:
                    x, y = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["node", "tokens"])

    return docs.select("text").mapInArrow(trimmed(build), "node binary, tokens binary").join(active, "node").dropDuplicates(["node"])


def distinct_documents(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: int = NEAR_SIMILARITY, missed: float | None = MISSED) -> DataFrame:
    """A row of each component, with its own columns: of the smallest doc_id (null last), then of the least digest of
    its text, whatever doc_ids other components have. A row without words is its own component, but rows of one
    doc_id (that isn't null) and text are copies. Texts are shuffled of those documents alone that may go."""
    null, number, digest, place, row = names = fresh(docs, "_null", "_id", "_key", "_place", "_row")
    keys = {null: F.col("doc_id").isNull(), number: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), digest: F.unhex(F.md5("text"))}
    rows, _, labels = _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), keys[digest].alias("key"), "text"), shingle, similarity, missed)
    worded_rows = rows.filter("node is not null").select("node", F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(-1)).alias(number), F.col("key").alias(digest))
    own = names[:3]
    kept = worded_rows.groupBy("node").agg(F.min(F.struct(*own)).alias("first")).join(labels, "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min("first").alias("first")).select("first.*")
    counted = worded_rows.groupBy(*own).agg(F.count("*").alias("n")).join(kept.withColumn("head", F.lit(True)), own, "left")
    counted = cut(counted.select(*own, "n", F.coalesce("head", F.lit(False)).alias("head")))
    rows = labels = kept = worded_rows = None
    release(docs.sparkSession)
    heads = counted.filter("head").select(*own)
    # rows of a key that stays and that one row has: most
    bits = bit_set(counted.filter("n > 1 or not head").select(F.xxhash64(*own).alias("place")))
    keyed, worded = docs.withColumns(keys).withColumn(place, F.xxhash64(*own)), F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    held = keyed.filter(worded)
    empty = keyed.filter(~worded).withColumn(row, F.when(F.col(null), F.monotonically_increasing_id())).dropDuplicates([*own, row])
    if bits is None:
        return held.join(heads, own, "left_semi").dropDuplicates(own).select(*docs.columns).unionByName(empty.select(*docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @arrow_udf("boolean")
    def may_go(places: pa.Array) -> pa.Array:
        return pa.array(in_bits(shared.value, places.to_numpy(zero_copy_only=False).view(np.uint64)))

    sure, doubtful = held.filter(~may_go(place)), held.filter(may_go(place)).join(heads, own, "left_semi").dropDuplicates(own)
    return sure.select(*docs.columns).unionByName(doubtful.select(*docs.columns)).unionByName(empty.select(*docs.columns))


def op10_ngram_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents"), SHINGLE, SIMILARITY)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.m)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(m) AS component_id FROM c GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
