"""Retrieval channels: candidates (q, s1, score, rank) for query records among index records of their country block.

All blocks run in one job: the country is part of every key. Statistics come from the index alone. Lists longer than
a cap are left out by the channels' definition, before the join. Scores are rounded to 9 digits before ranking and ties go to the smaller s1.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import rules
from ..functions import arrays as A
from ..functions import text as T
from ..functions.unicode import fold
from ..sources.staging import staged

BLOCK = "country_clean"
#: Records of a block and queries of a bundle, about, that meet in one step of the channels by terms.
ROWS, BUNDLE = 8192, 8192
#: Records of each side of a key that meet in one row of the exact channels.
TILE = 256
_ALL = {"A": 1, "B": 1, "C": 1, "D": 10, "E'": 10, "F": 10, "G": 10}
#: All channels, all but one, and the mixes.
ABLATIONS = {"all": _ALL, **{f"- {x}": {k: n for k, n in _ALL.items() if k != x} for x in _ALL}, **rules.MIXES}


def folded(df: DataFrame, column: str) -> Column:
    """A column without diacritics: as stored, if it is."""
    return F.col(f"{column}_folded") if f"{column}_folded" in df.columns else fold(F.col(column))


def ranked(scored: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by, "q").orderBy(F.col("score").desc(), "s1")
    return scored.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*by, "q", "s1", "score", "rank")


def _keys(df: DataFrame, name: str, keys: list[Column]) -> DataFrame:
    """A row a record: SHA-256 digests of its keys in their block, each once."""
    found = df.select(BLOCK, F.col("entity_id").alias(name), F.explode(F.array(*keys)).alias("key")).filter("key <> ''")
    digest = F.sha2(F.concat(F.length(BLOCK).cast("string"), F.lit("|"), F.col(BLOCK), F.col("key")), 256)
    return found.select(name, digest.alias("key")).filter("key is not null").groupBy(name).agg(F.collect_set("key").alias("keys"))


def _expanded(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs (q, s1) of records with their keys that share one. A key's records meet in tiles of ``TILE`` by ``TILE``, dealt
    evenly, so that no task holds all pairs of a common key, and no pair is shuffled: of several keys that a pair shares
    the least counts."""
    side = lambda df, name: df.select(F.explode("keys").alias("key"), F.struct(F.col(name).alias("id"), F.when(F.size("keys") > 1, F.col("keys")).alias("keys")).alias(name))
    both = side(queries, "q").unionByName(side(index, "s1"), allowMissingColumns=True)
    met = both.groupBy("key").agg(F.collect_list("q").alias("q"), F.collect_list("s1").alias("s1")).filter((F.size("q") > 0) & (F.size("s1") > 0))
    parts = lambda c: F.transform(F.sequence(F.lit(1), F.size(c), F.lit(TILE)), lambda i: F.slice(c, i, F.lit(TILE)))
    tiles = met.select("key", F.explode(parts("q")).alias("q"), parts("s1").alias("s1")).select("key", "q", F.explode("s1").alias("s1"))
    tiles = tiles.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = tiles.select("key", F.explode("q").alias("q"), "s1").select("key", "q", F.explode("s1").alias("s1"))
    first = F.array_min(F.array_intersect("q.keys", "s1.keys")) == F.col("key")
    return pairs.filter(F.col("q.keys").isNull() | F.col("s1.keys").isNull() | first).select(F.col("q.id").alias("q"), F.col("s1.id").alias("s1"))


def exact(index: DataFrame, queries: DataFrame, index_keys: list[Column], query_keys: list[Column]) -> DataFrame:
    """Every pair that shares a key: score 1, rank 1, no cut."""
    pairs = _expanded(_keys(index, "s1", index_keys), _keys(queries, "q", query_keys))
    return pairs.select("q", "s1", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))


def exact_among(pairs: DataFrame, index: DataFrame, queries: DataFrame, index_keys: list[Column], query_keys: list[Column]) -> DataFrame:
    """Those of ``pairs`` (q, s1) that ``exact`` finds, without making the others."""
    both = pairs.select("q", "s1").distinct().join(_keys(queries, "q", query_keys).withColumnRenamed("keys", "_q"), "q").join(_keys(index, "s1", index_keys).withColumnRenamed("keys", "_s1"), "s1")
    return both.filter(F.arrays_overlap("_q", "_s1")).select("q", "s1", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))


def exact_sizes(index: DataFrame, queries: DataFrame, index_keys: list[Column], query_keys: list[Column]) -> DataFrame:
    """(q, n): how many index records ``exact`` finds, a row a query. Those of one key are counted by it; only pairs of
    queries of several keys are made."""
    posted, asked = _keys(index, "s1", index_keys), _keys(queries, "q", query_keys)
    counts = posted.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    single = asked.filter(F.size("keys") == 1).select("q", F.element_at("keys", 1).alias("key")).join(counts, "key").select("q", "n")
    several = _expanded(posted, asked.filter(F.size("keys") > 1)).groupBy("q").agg(F.count("*").alias("n"))
    return queries.select(F.col("entity_id").alias("q")).join(single.unionByName(several), "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))


def channel_a(index: DataFrame, queries: DataFrame) -> DataFrame:
    return exact(index, queries, [F.col("name_clean")], [F.col("name_clean")])


def channel_b(index: DataFrame, queries: DataFrame) -> DataFrame:
    return exact(index, queries, [folded(index, "name_base")], [folded(queries, "name_base")])


def channel_c(index: DataFrame, queries: DataFrame) -> DataFrame:
    spelt = [T.compact(folded(index, "name_base")), T.compact(folded(index, "name_clean"))]
    return exact(index, queries, spelt, [T.domain_stem(F.col("name_domain")), T.compact(folded(queries, "name_base"))])


def _classes(df: DataFrame, by: list[str], values: Column) -> DataFrame:
    """A row for the records of a block that have the same values: ``head``, the least id, stands for ``ids``. Classes
    spare the pairs of copies; what is found for a head holds for all."""
    rows = df.select(BLOCK, *by, F.col("entity_id").alias("id"), values.alias("value")).filter("value is not null")
    own = rows.groupBy(BLOCK, *by, "id").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return own.groupBy(BLOCK, *by, "values").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("head", F.element_at("ids", 1))


def _spread(best: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best records of each query from the k best heads of its class. Of a class no more than k records count."""
    s1 = index.select(BLOCK, F.col("head").alias("s1"), F.slice("ids", 1, k).alias("_s1"))
    q = queries.select(BLOCK, F.col("head").alias("q"), F.col("ids").alias("_q"))
    rows = ranked(best, k, BLOCK).join(s1, [BLOCK, "s1"]).select(BLOCK, "q", F.explode("_s1").alias("s1"), "score")
    rows = ranked(rows, k, BLOCK).join(q, [BLOCK, "q"]).select(F.explode("_q").alias("q"), "s1", "score")
    return ranked(rows, k)


def overlap(index: DataFrame, queries: DataFrame, keys, cap: int, k: int) -> DataFrame:
    """The k best by the summed idf of shared keys that ``cap`` index records or fewer have."""
    def lists(df: DataFrame) -> DataFrame:
        rows = df.select(BLOCK, "entity_id", F.explode(keys(df)).alias("key")).filter("key is not null")
        own = rows.groupBy(BLOCK, "entity_id").agg(F.array_sort(F.collect_set("key")).alias("values"))
        return own.groupBy(BLOCK, "values").agg(F.array_sort(F.collect_list("entity_id")).alias("ids")).withColumn("head", F.element_at("ids", 1))

    shared, asked = _kept(lists(index)), _kept(lists(queries))
    sizes = index.groupBy(BLOCK).agg(F.count("*").alias("n"))
    posted = shared.select(BLOCK, "head", F.size("ids").alias("of"), F.explode("values").alias("key"))
    df = posted.groupBy(BLOCK, "key").agg(F.sum("of").alias("df")).filter(F.col("df") <= cap).join(F.broadcast(sizes), BLOCK)  # a row a country
    idf = df.select(BLOCK, "key", (F.log("n") - F.log("df")).alias("idf"))
    weighted = posted.join(idf, [BLOCK, "key"]).groupBy(BLOCK, "head").agg(F.array_sort(F.collect_list(F.struct("key", "idf"))).alias("v"))
    records = weighted.select(BLOCK, "head", F.col("v.key").alias("terms"), F.col("v.idf").alias("ws"))
    bundles = asked.select(BLOCK, "head", F.col("values").alias("terms"), F.transform("values", lambda _: F.lit(1.0)).alias("ws"))
    met = _dealt(bundles, [BLOCK], BUNDLE, "bundle", "queries").join(_dealt(records, [BLOCK], ROWS, "block", "records"), BLOCK)
    return _spread(_met(met, k, True), shared, asked, k)


def _in_region(values: Column) -> Column:
    region = F.col("address_region")
    return F.when(region.isNotNull(), F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.concat(region, F.lit("|"), x)))


def channel_d(index: DataFrame, queries: DataFrame, cap: int = 1000, k: int = 10) -> DataFrame:
    return overlap(index, queries, lambda df: A.tokens(folded(df, "name_clean")), cap, k)


def channel_f(index: DataFrame, queries: DataFrame, cap: int = 50, k: int = 10) -> DataFrame:
    return overlap(index, queries, lambda _: _in_region(F.col("address_numbers")), cap, k)


def channel_g(index: DataFrame, queries: DataFrame, cap: int = 500, k: int = 10) -> DataFrame:
    return overlap(index, queries, lambda df: _in_region(A.tokens(folded(df, "address_clean"))), cap, k)


def _kept(df: DataFrame) -> DataFrame:
    """Written once, as several steps read it."""
    return staged(df.sparkSession, f"channel {uuid.uuid4().hex}", lambda: df)


@arrow_udf(ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())])))
def _trigrams(values: pa.Array) -> pa.Array:
    """Trigrams of a record's texts as ``arrays.trigrams`` has them, in order, and how often each is met."""
    out = []
    for texts in values.to_pylist():
        padded = [f" {t} " for t in texts]
        out.append([{"term": t, "tf": n} for t, n in sorted(Counter(t[i : i + 3] for t in padded for i in range(len(t) - 2)).items())])
    return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))


def _counted(df: DataFrame, by: list[str], text: Column) -> DataFrame:
    counts = _classes(df, by, text).withColumn("v", _trigrams("values"))
    return _kept(counts.select(BLOCK, *by, "head", "ids", F.col("v.term").alias("terms"), F.col("v.tf").alias("tfs")))


def _trigram_sides(index: DataFrame, queries: DataFrame, share: float, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of records and of queries with their trigrams' counts, and by block the trigrams' idf."""
    shared = _counted(index, by, folded(index, "name_clean"))
    sizes = index.groupBy(BLOCK).agg(F.count("*").alias("n"))
    df = shared.select(BLOCK, F.size("ids").alias("of"), F.explode("terms").alias("tri")).groupBy(BLOCK, "tri").agg(F.sum("of").alias("df")).join(F.broadcast(sizes), BLOCK)  # a row a country
    df = df.filter(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    idf = df.groupBy(BLOCK).agg(F.collect_list(F.struct("tri", (F.log(1 + F.col("n")) - F.log(1 + F.col("df")) + 1).alias("w"))).alias("v")).select(BLOCK, F.col("v.tri").alias("known"), F.col("v.w").alias("idf"))
    return shared, _counted(queries, by, F.coalesce("name_latin", folded(queries, "name_clean"))), idf


def _dealt(vectors: DataFrame, by: list[str], size: int, number: str, rows: str) -> DataFrame:
    """Rows of about ``size`` vectors of one group of ``by``, nulls being one too. There are few groups."""
    groups = vectors.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_k")).withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    dealt = vectors.join(F.broadcast(groups), same).withColumn(number, F.pmod(F.xxhash64("head"), "_k"))
    return dealt.groupBy(*by, number).agg(F.collect_list(F.struct("head", "terms", "ws")).alias(rows))


def _side(rows: pa.Array, idf: dict[str, float] | None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Heads, and the terms, owners and weights of all their postings. With ``idf``, weights are counts, and made
    vectors of length 1 of the terms that it has."""
    heads = np.array(rows.field("head").to_pylist(), object)
    terms, ws = rows.field("terms").flatten(), rows.field("ws").flatten().to_numpy(zero_copy_only=False).astype(float)
    owners = np.repeat(np.arange(len(heads)), np.diff(rows.field("terms").offsets.to_numpy()))
    if idf is not None:
        coded = pc.dictionary_encode(terms)
        ws = (1 + np.log(ws)) * np.array([idf.get(t, 0.0) for t in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        had = ws > 0
        ws, owners, terms = ws[had], owners[had], terms.filter(pa.array(had))
        ws = ws / np.sqrt(np.bincount(owners, ws * ws, len(heads)))[owners]
    return heads, terms, owners, ws


def _best(batches: Iterator[pa.RecordBatch], k: int, zeros: bool) -> Iterator[pa.RecordBatch]:
    """The k best products of each query of a bundle with the records of a block: a term's postings are added up.
    ``zeros``: a shared term alone makes a pair."""
    for batch in batches:
        for r in range(batch.num_rows):
            idf = dict(zip(batch.column("known")[r].as_py(), batch.column("idf")[r].as_py(), strict=True)) if "known" in batch.schema.names else None
            ids, terms, owner, weight = _side(batch.column("records")[r].values, idf)
            heads, asked, of, ws = _side(batch.column("queries")[r].values, idf)
            by_id = np.argsort(np.argsort(ids, kind="stable"))  # so that ties go to the lesser
            ids, owner = np.sort(ids), by_id[owner]
            coded = pc.dictionary_encode(terms)
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            owner, weight, ends = owner[order], weight[order], np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            place = pc.index_in(asked, value_set=coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
            has = place >= 0
            place, of, ws = place[has], of[has], ws[has]
            begins = np.searchsorted(of, np.arange(len(heads) + 1))
            found_q, found_s, found_n = [], [], []
            for j in np.flatnonzero(np.diff(begins)):
                own = list(zip(ends[place[begins[j] : begins[j + 1]]].tolist(), ends[place[begins[j] : begins[j + 1]] + 1].tolist(), ws[begins[j] : begins[j + 1]].tolist(), strict=True))
                rows = np.concatenate([owner[a:b] for a, b, _ in own])
                scores = np.bincount(rows, np.concatenate([weight[a:b] if w == 1 else w * weight[a:b] for a, b, w in own]), len(ids))
                if zeros:
                    touched = np.zeros(len(ids), bool)
                    touched[rows] = True
                    some = np.flatnonzero(touched)
                else:
                    some = np.flatnonzero(scores >= 5e-10)
                values = np.round(scores[some], 9)
                if len(some) > k:
                    top = values >= np.partition(values, -k)[-k]  # with the ties of the kth
                    some, values = some[top], values[top]
                top = np.lexsort((some, -values))[:k]
                found_q.append(np.full(len(top), j))
                found_s.append(some[top])
                found_n.append(values[top])
            if found_q:
                q, s1 = heads[np.concatenate(found_q)], ids[np.concatenate(found_s)]
                block = pa.array([batch.column(BLOCK)[r].as_py()] * len(q), pa.string())
                yield pa.RecordBatch.from_arrays([block, pa.array(q, pa.string()), pa.array(s1, pa.string()), pa.array(np.concatenate(found_n))], [BLOCK, "q", "s1", "score"])


def _met(met: DataFrame, k: int, zeros: bool) -> DataFrame:
    """Blocks and bundles meet as wholes, dealt evenly, so that no pair of records is shuffled but each block's k best."""
    dealt = met.repartition(4 * int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(partial(_best, k=k, zeros=zeros), f"{BLOCK} string, q string, s1 string, score double")


def _nearest(queries: DataFrame, index: DataFrame, idf: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the records of its country, and of its ``target`` region where it has one."""
    by = [c for c in index.columns if c == "address_region"]
    blocks = _dealt(index.withColumnRenamed("tfs", "ws"), [BLOCK, *by], ROWS, "block", "records")
    bundles = _dealt(queries.withColumnRenamed("tfs", "ws"), [BLOCK, *(["target"] if by else [])], BUNDLE, "bundle", "queries")
    if by:
        near = bundles.filter("target is not null").join(blocks.withColumnRenamed("address_region", "target"), [BLOCK, "target"])
        wide = bundles.filter("target is null").join(blocks.drop("address_region"), BLOCK)
        met = near.select(BLOCK, "queries", "records").unionByName(wide.select(BLOCK, "queries", "records"))
    else:
        met = bundles.join(blocks, BLOCK).select(BLOCK, "queries", "records")
    return _spread(_met(met.join(F.broadcast(idf), BLOCK), k, False), index, queries, k)  # a row a country


def channel_e(index: DataFrame, queries: DataFrame, share: float = 0.02, k: int = 10) -> DataFrame:
    """Cosine of trigram TF-IDF vectors over the country's vocabulary."""
    s1, q, idf = _trigram_sides(index, queries, share, [])
    return _nearest(q, s1, idf, k)


def channel_e_region(index: DataFrame, queries: DataFrame, share: float = 0.02, k: int = 10) -> DataFrame:
    """As channel_e within the query's region; queries without one, or whose region has no index record, see all."""
    s1, q, idf = _trigram_sides(index, queries, share, ["address_region"])
    regions = index.filter("address_region is not null").select(BLOCK, "address_region").distinct().withColumn("target", F.col("address_region"))
    return _nearest(q.join(F.broadcast(regions), [BLOCK, "address_region"], "left"), s1, idf, k)  # a row a region


def make(name: str, index: DataFrame, queries: DataFrame, k: int = 10, caps: str = "medium") -> DataFrame:
    if name in "ABC":
        return {"A": channel_a, "B": channel_b, "C": channel_c}[name](index, queries)
    if name in ("E", "E'"):
        return (channel_e if name == "E" else channel_e_region)(index, queries, k=k)
    return {"D": channel_d, "F": channel_f, "G": channel_g}[name](index, queries, rules.CAPS[caps][name], k)


def union(index: DataFrame, queries: DataFrame, channels: dict[str, int] | None = None, caps: str = "medium") -> DataFrame:
    """Distinct pairs of all the channels, each with its own k."""
    channels = channels or rules.RECOMMENDED["channels"]
    return reduce(DataFrame.union, (make(c, index, queries, k, caps).select("q", "s1") for c, k in channels.items())).distinct()


def cut(candidates: DataFrame, k: int) -> DataFrame:
    return candidates.filter(F.col("rank") <= k)
