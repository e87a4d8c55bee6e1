"""Exact top-k inner products by the threshold algorithm (op3).

Vectors are turned into integers, floor(256 x), and dealt to blocks of about ``BLOCK`` by the nearest of some centres,
so that what is alike stands together. Centres are fitted on a bounded sample (``SAMPLE`` rows a length of vector);
every row is indexed, and the result doesn't depend on them. A block keeps its distinct vectors, each with the ids of
its copies that can be among k results, and for each dimension the list of vectors sorted by that component.

1. Queries are bundled by centre. Each bundle first searches one block of its centre; the kth score that a query has
   there is a threshold for all other blocks.
2. A bundle then meets those blocks only whose box (the ends of their lists) and longest vector allow a score of the
   bundle's least threshold; a query goes into those only that allow its own.
3. In a block, a query goes down all lists at once, from the end that its component's sign favours, and scores what
   it meets for the first time in full. It stops when the kth score so far, or its threshold, exceeds the bound on
   what it hasn't met: the query times the components reached, or, if less, times the longest vector that such
   components allow (no vector below is longer than the block's longest).

`scored` is the number of distinct vectors that a query scored. The bounds stop early where vectors cluster or their
mass is in few dimensions; for directions spread evenly over all dimensions none can, and most are scored.

Defined results: a vector that is null, empty or has null or non-finite components takes no part, neither as query nor
as candidate. Vectors of different lengths don't meet. Rows with equal vec_id and vector are one; rows with the query's
vec_id are its own. A null vec_id takes no part. Scores are exact whatever the components' size; one that a long can't
hold is given as the nearest long, and ranked as it is. 256 x stays below the greatest double. An empty table gives an
empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, table
from .jaccard import _groups

K = 5
SCALE = 256
BLOCK, QUERIES = 4096, 256
#: Rows that centres are fitted on, the most centres, and rounds of fitting.
SAMPLE, CENTRES, ROUNDS = 8192, 256, 6
#: Entries of each list read in the first step; they double.
STEP = 8
_MOST = 2**63 - 1


def _integers(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, centre, vector: integers as doubles, which hold 256 x and its floor exactly."""
    for batch in batches:
        column = batch.column("embedding")
        ids, out, dims, near = [], [], [], []
        values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        greatest = np.finfo(float).max
        for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * values[at[i] : at[i + 1]].astype(np.float64)), -greatest, greatest)
            if len(x):
                own = centres.get(len(x))
                with np.errstate(over="ignore", invalid="ignore"):
                    near.append(int(np.argmax(own @ x - (own * own).sum(1) / 2)) if own is not None else 0)
                ids.append(vec_id)
                out.append(x.astype("<f8").tobytes())
                dims.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(near, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "centre", "vector"])


def fit_centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """Some rounds of k-means from evenly spaced rows."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centres.T - (centres * centres).sum(1) / 2, axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _small(matrix: np.ndarray) -> np.ndarray:
    """The same integers in fewer bytes, where they fit."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8")


_TYPES = {"i2": "<i2", "i4": "<i4", "f8": "<f8"}
_INDEX = "dim int, centre int, sub long, owners array<array<long>>, kind string, matrix binary, lists binary, low binary, high binary, longest double"


def _index(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its distinct vectors, the k + 1 least ids of each, the lists, their ends and the longest."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    for group in _groups(batches, ["dim", "centre", "sub"]):
        keys = list(zip(*(group.column(c).to_pylist() for c in ("dim", "centre", "sub")), strict=True))
        ids, vectors = group.column("vec_id").to_pylist(), group.column("vector").to_pylist()
        begin = 0
        for end in range(1, len(ids) + 1):
            if end < len(ids) and keys[end] == keys[begin]:
                continue
            dim, centre, sub = keys[begin]
            copies: dict[bytes, list[int]] = {}
            for i, v in zip(ids[begin:end], vectors[begin:end], strict=True):  # ascending ids
                own = copies.setdefault(v, [])
                if len(own) <= k and (not own or own[-1] != i):
                    own.append(i)
            whole = np.frombuffer(b"".join(copies), "<f8").reshape(-1, dim)
            matrix = _small(whole)
            lists = np.argsort(-whole.T, axis=1, kind="stable").astype("<u4")
            with np.errstate(over="ignore"):
                longest = float(np.sqrt((whole * whole).sum(1).max()))
            values = [[dim], [centre], [sub], [list(copies.values())], [matrix.dtype.str[1:]], [matrix.tobytes()], [lists.tobytes()], [whole.min(0).tobytes()], [whole.max(0).tobytes()], [longest]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)
            begin = end


_BUNDLE = "dim int, centre int, part long, queries array<long>, vectors binary"


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bundle of queries."""
    names = [x.split()[0] for x in _BUNDLE.split(", ")]
    for group in _groups(batches, ["dim", "centre", "part"]):
        for (dim, centre, part), own in group.to_pandas().groupby(["dim", "centre", "part"]):
            own = own.drop_duplicates(["vec_id", "vector"])
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((dim, centre, part, own["vec_id"].tolist(), b"".join(own["vector"])), kinds, strict=True)], names)


def furthest(query: np.ndarray, reach: np.ndarray, longest: float) -> float:
    """No vector x of a length of ``longest`` at most, with x * sign(query) at most ``reach`` in each dimension, has a
    greater product with the query; a little above, for rounding. The greatest is min(reach, t |query|) for some t."""
    size = np.abs(query)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        total = float((size * reach).sum())
        if not np.isfinite(total):
            return np.inf
        if longest * longest > float((reach * reach).sum()):
            return total
        # dimensions in the order in which they reach their limit as t grows; t is between two of these
        full = np.where(size > 0, reach / np.where(size > 0, size, 1), np.inf)
        order = np.argsort(full, kind="stable")
        size, reach, full = size[order], reach[order], full[order]
        held = np.concatenate([[0.0], np.cumsum(reach * reach)])  # of those at their limit
        free = np.concatenate([np.cumsum((size * size)[::-1])[::-1], [0.0]])  # of the others
        t = np.sqrt(np.maximum(longest * longest - held, 0) / np.where(free > 0, free, 1))
        k = int(np.argmax((t <= np.append(full, np.inf)) & (held <= longest * longest)))
        # at t the length is the longest; another k gives a greater value, never a smaller bound than is right
        value = float((size[:k] * reach[:k]).sum() + t[k] * free[k])
    cauchy = float(np.sqrt((size * size).sum())) * longest
    slack = 1e-9 * (abs(total) + cauchy) + 1
    return min(total, max(value, 0.0) if (reach >= 0).all() else cauchy, cauchy) + slack


def threshold(query: np.ndarray, matrix: np.ndarray, lists: np.ndarray, k: int, floor: float = -np.inf, longest: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of ``matrix`` among which are all those that score as much as the kth or more (and ``floor`` or more), their
    scores, and how many rows were scored."""
    used = np.flatnonzero(query)
    n = len(matrix)
    if not len(used):
        return np.arange(n), np.zeros(n, matrix.dtype), n
    walk = np.where(query[used, None] > 0, lists[used], lists[used, ::-1])
    rows, sign = query[used].astype(float), np.sign(query[used].astype(float))
    longest = np.inf if longest is None else longest
    seen = np.zeros(n, bool)
    found, scores = [], []
    at, step, met = 0, STEP, 0
    kth = floor
    while at < n:
        reach = sign * matrix[walk[:, at], used].astype(float)  # what is first met from here on is no further
        if met and len(found) and met >= k:
            every = np.concatenate(scores)
            kth = max(kth, np.partition(every, len(every) - k)[len(every) - k])
        if kth > furthest(rows, reach, longest):
            break
        to = min(n, at + step)
        new = np.zeros(n, bool)
        new[walk[:, at:to].ravel()] = True
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        met += len(new)
        found.append(new)
        scores.append(matrix[new] @ query)
        if met == n:
            break
        at, step = to, 2 * step
    return (np.concatenate(found), np.concatenate(scores), met) if found else (np.zeros(0, np.int64), np.zeros(0, matrix.dtype), 0)


def _exact(values: np.ndarray) -> np.ndarray:
    """As Python's integers, which don't overflow."""
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


_FOUND = "dim int, centre int, part long, queries array<long>, vectors binary, floors array<double>, met array<long>, found array<struct<query: int, vec_id: long, score: decimal(38,0)>>"
_LIMIT = 10**38 - 1


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Bundles that met a block: what they found there, with the kth scores so far and how many vectors they scored."""
    import decimal

    names = ["dim", "centre", "part", "queries", "vectors", "floors", "met", "found"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.struct([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0))]))]
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c: batch.column(c)[r]  # noqa: B023, E731
            dim = get("dim").as_py()
            matrix = np.frombuffer(get("matrix").as_buffer(), _TYPES[get("kind").as_py()]).reshape(-1, dim)
            lists = np.frombuffer(get("lists").as_buffer(), "<u4").reshape(dim, -1)
            owners, wanted, longest = get("owners").as_py(), get("queries").as_py(), get("longest").as_py()
            vectors = np.frombuffer(get("vectors").as_buffer(), "<f8").reshape(-1, dim)
            floors = get("floors").as_py() or [-np.inf] * len(wanted)
            # products and sums below 2^53 are exact as doubles, which are faster
            with np.errstate(over="ignore"):
                exact = float(np.abs(matrix).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * dim < 2**53
            m, q = (matrix.astype(float), vectors) if exact else (_exact(matrix), _exact(vectors))
            found, now, met = [], [], []
            for j, (query_id, query) in enumerate(zip(wanted, q, strict=True)):
                rows, scores, scored = threshold(query, m, lists, k + 1, floors[j], longest)
                if scores.dtype != object:  # what is below the threshold can't be among the results
                    high = scores >= floors[j]
                    rows, scores = rows[high], scores[high]
                    order = np.argsort(-scores, kind="stable")
                else:
                    order = sorted(range(len(rows)), key=lambda i: -scores[i])  # noqa: B023
                best: list[tuple[int, int]] = []
                held = 0
                for place, i in enumerate(order):
                    if held >= k and scores[i] < scores[order[place - 1]]:
                        break  # ties with the kth may have smaller ids
                    more = [(-int(scores[i]), v) for v in owners[rows[i]] if v != query_id]
                    best += more
                    held += len(more)
                best = sorted(best)[:k]
                found += [{"query": j, "vec_id": v, "score": decimal.Decimal(max(-_LIMIT, min(_LIMIT, -s)))} for s, v in best]
                now.append(max(floors[j], float(-best[k - 1][0])) if len(best) == k else floors[j])
                met.append(scored)
            values = [dim, get("centre").as_py(), get("part").as_py(), wanted, bytes(get("vectors").as_buffer()), now, met, found]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of a bundle's box and a block's box: those that allow a score of the bundle's least threshold."""
    for batch in batches:
        keep = []
        for r in range(batch.num_rows):
            a, b, c, d = (np.frombuffer(batch.column(x)[r].as_buffer(), "<f8") for x in ("q_low", "q_high", "low", "high"))
            with np.errstate(over="ignore", invalid="ignore"):
                products = np.stack([a * c, a * d, b * c, b * d])
                bound = min(float(products.max(0).sum()), batch.column("q_longest")[r].as_py() * batch.column("longest")[r].as_py())
            slack = 1 + 1e-9 * abs(bound) if np.isfinite(bound) else 0
            keep.append(not bound + slack < batch.column("least")[r].as_py())  # also where the bound isn't a number
        yield batch.filter(pa.array(keep, pa.bool_())).select(["dim", "centre", "part", "b_centre", "sub"])


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            x = np.frombuffer(batch.column("vectors")[r].as_buffer(), "<f8").reshape(-1, batch.column("dim")[r].as_py())
            with np.errstate(over="ignore"):
                rows.append((x.min(0).tobytes(), x.max(0).tobytes(), float(np.sqrt((x * x).sum(1).max())), min(batch.column("floors")[r].as_py())))
        low, high, longest, least = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("centre"), batch.column("part"), pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.array(longest, pa.float64()), pa.array(least, pa.float64())], ["dim", "centre", "part", "q_low", "q_high", "q_longest", "least"])


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length of vector: about a centre for BLOCK rows, CENTRES at most."""
    sizes = {r["dim"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(16).collect()}
    out = {}
    for dim, n in sizes.items():
        k = min(CENTRES, -(-n // BLOCK))
        if k > 1:
            part = rows.filter((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / n) * (1 << 20)))).select("embedding").limit(2 * SAMPLE).collect()
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(SCALE * np.array([r[0] for r in part], float), -1e100, 1e100)
            if len(x) > k:
                out[dim] = fit_centres(x, k)
    return out


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score, scored: the ``k`` best of every row of ``vectors`` that ``is_query`` picks."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & sound)
    dealt = cut(rows.mapInArrow(partial(_integers, centres=_centres(rows)), "vec_id long, dim int, centre int, vector binary"))
    # a row for each length and centre, of which there are few
    sizes = dealt.groupBy("dim", "centre").agg(F.count("*").alias("n"))
    asked = dealt.filter(is_query)
    split = lambda df, name, size: df.join(F.broadcast(sizes.select("dim", "centre", F.ceil(F.col("n") / size).alias("_k"))), ["dim", "centre"]).withColumn(name, F.pmod(F.xxhash64("vec_id"), "_k")).drop("_k")
    blocks = split(dealt, "sub", BLOCK).repartition("dim", "centre", "sub").sortWithinPartitions("dim", "centre", "sub", "vec_id")
    index = table(blocks.mapInArrow(partial(_index, k=k), _INDEX))
    bundles = split(asked, "part", 50 * QUERIES).repartition("dim", "centre", "part").sortWithinPartitions("dim", "centre", "part", "vec_id").mapInArrow(_bundle, _BUNDLE)
    payload = ["owners", "kind", "matrix", "lists", "longest"]
    run = lambda met: met.repartition("dim", "centre", "part", "b_centre", "sub").mapInArrow(partial(_search, k=k), _FOUND)

    # first each bundle in one block of its own centre
    home = index.groupBy("dim", "centre").agg(F.max("sub").alias("last"))
    first = bundles.join(home, ["dim", "centre"]).withColumn("sub", F.pmod("part", F.col("last") + 1)).drop("last").withColumn("floors", F.array().cast("array<double>"))
    first = cut(run(first.join(index.select("dim", "centre", "sub", *payload), ["dim", "centre", "sub"]).withColumn("b_centre", F.col("centre"))))
    begun = first.join(home, ["dim", "centre"]).withColumn("home", F.pmod("part", F.col("last") + 1)).drop("last", "met", "found")

    boxes = first.select("dim", "centre", "part", "vectors", "floors").mapInArrow(_boxes, "dim int, centre int, part long, q_low binary, q_high binary, q_longest double, least double")
    ends = index.select("dim", F.col("centre").alias("b_centre"), "sub", "low", "high", "longest")
    meet = boxes.join(ends, "dim").mapInArrow(_meeting, "dim int, centre int, part long, b_centre int, sub long")
    meet = begun.join(meet, ["dim", "centre", "part"]).filter("b_centre <> centre or sub <> home").drop("home")
    second = cut(run(meet.join(index.select("dim", F.col("centre").alias("b_centre"), "sub", *payload), ["dim", "b_centre", "sub"])).drop("vectors", "floors"))

    every = first.drop("vectors", "floors").unionByName(second)
    scored = every.select(F.explode(F.arrays_zip("queries", "met")).alias("x")).groupBy(F.col("x.queries").alias("query_id")).agg(F.sum("x.met").alias("scored"))
    found = every.select("queries", F.explode("found").alias("f")).select(F.element_at("queries", F.col("f.query") + 1).alias("query_id"), "f.vec_id", "f.score").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(scored, "query_id")
    return top.select("query_id", "rank", "vec_id", F.greatest(F.lit(-_MOST - 1).cast("decimal(38,0)"), F.least(F.lit(_MOST).cast("decimal(38,0)"), F.col("score"))).cast("long").alias("score"), "scored")


def op3_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without `scored`, which SQL can't give."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("scored")


OP3_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
