"""Mixing sources to target weights by subset-sum budget fitting (op6).

Targets: the sources, ordered by code point with the null source last, weigh 5, 2, 1, 5, ... and share the words of
all documents; a share stops at ``MAX_REPEATS`` times its source's size and its excess goes to the others by weight.

A target of b whole sizes and a rest takes every document b times, and once more a subset whose sizes sum up to the
rest: from the number of documents of each exact size, every size gives its share rounded down, then sizes give one
more in order of what rounding cost them, and what is still missing is filled by a bounded-knapsack dynamic
programme over the documents that are left. How many documents of a size are taken is then exact; which, the hashes
of their ids and texts decide.

Defined results: a null or text without words has size 0 and nothing is taken of it. Documents with a null doc_id and
repeated rows count each. With no words at all, all targets are 0. An empty table gives an empty result. Other columns
stay as they are in ``mixed``, whatever their names, and don't appear in ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, read

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
#: The rest that the dynamic programme fills at most.
PROGRAMME = 16_384
#: Documents of one source and size are dealt to so many groups.
SALTS = 256


def fill(weights: np.ndarray, sizes: np.ndarray, total: float) -> np.ndarray:
    """Targets: shares of ``total`` by weight, none over MAX_REPEATS times its size."""
    caps = MAX_REPEATS * sizes.astype(float)
    target, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        share = (total - target[~free].sum()) * weights / weights[free].sum()
        over = free & (share > caps)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = caps[over]
        free &= ~over
    return target


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as great as can be but not over ``budget``."""
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        left = min(int(counts[i]), budget // length)
        size = 1
        while left > 0:
            size = min(size, left)
            steps.append((i, size, reach))
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        if reach >> budget:
            break
    best, take = reach.bit_length() - 1, np.zeros(len(lengths), np.int64)
    for i, size, before in reversed(steps):
        if not (before >> best) & 1:
            best -= int(lengths[i]) * size
            take[i] += size
    return take


def subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for ``budget`` words."""
    total = int((lengths * counts).sum())
    exact = counts * (min(budget, total) / total) if total else counts * 0.0
    take = np.floor(exact).astype(np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(take - exact, kind="stable"):
        if left <= PROGRAMME:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if left <= PROGRAMME:
            break
        more = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    usable = (lengths <= left) & (take < counts)
    if left > 0 and usable.any():
        take[usable] += knapsack(lengths[usable], (counts - take)[usable], min(left, PROGRAMME))
    return take


def _key(source: Column) -> Column:
    """A source as a join key that isn't null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source))


def _targets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames), ignore_index=True)  # one row a source
    rows = rows.sort_values(["_key"], key=lambda c: c.map(lambda k: (k == "n", k)))
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], float)
    rows["target"] = fill(weights, rows["source_size"].to_numpy(), float(rows["source_size"].sum()))
    yield rows[["_key", "source_size", "target"]]


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """The sizes of one source with the documents of each that are taken once more, and the copies of all."""
    source_size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    base = min(MAX_REPEATS, int(target // source_size)) if source_size else 0
    rest = round(target - base * source_size) if base < MAX_REPEATS else 0
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    take = np.zeros(len(rows), np.int64)
    worded = lengths > 0
    take[worded] = subset(lengths[worded], counts[worded], rest)
    return rows[["_key", "size"]].assign(_base=base, _take=take)


def _mix(docs: DataFrame, seed: int, text: Column) -> DataFrame:
    """doc_id, _key, _text, size, source_size, target, _copies, a row for each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("source").cast("string")).alias("_key"), size.alias("size"), text.alias("_text"), F.xxhash64("text").alias("_words"))
    rows = cut(rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "_words"))).drop("_words").withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int"))
    groups = cut(rows.groupBy("_key", "size", "_salt").agg(F.count("*").alias("n")))
    lengths = groups.groupBy("_key", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(sources.coalesce(1).mapInPandas(_targets, "_key string, source_size long, target double"))
    plan = lengths.join(targets, "_key").groupBy("_key").applyInPandas(_plan, "_key string, size long, _base int, _take long")
    before = F.sum("n").over(Window.partitionBy("_key", "size").orderBy("_salt")) - F.col("n")
    quotas = groups.withColumn("_before", before).join(plan, ["_key", "size"]).join(targets, "_key")
    quotas = quotas.select("_key", "size", "_salt", "source_size", "target", "_base", F.greatest(F.lit(0), F.least(F.col("n"), F.col("_take") - F.col("_before"))).alias("_quota"))
    number = F.row_number().over(Window.partitionBy("_key", "size", "_salt").orderBy("_h", "doc_id", "_text"))
    copies = F.col("_base") + (number <= F.col("_quota")).cast("int")
    return rows.join(quotas, ["_key", "size", "_salt"]).select("doc_id", "_key", "_text", "size", "source_size", "target", copies.alias("_copies"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return _mix(docs, seed, F.lit(None).cast("binary")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents as often as the mix takes them. Rows of one doc_id (or none), source and text take together what
    they take; as such rows differ by a copy at most, so many of them take one more."""
    names = null, number, source, digest, base, more, copies, copy = fresh(docs, "_null", "_id", "_source", "_digest", "_base", "_more", "_copies", "_copy")
    same = list(names[:4])
    keys = {null: F.col("doc_id").isNull(), number: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), source: _key(F.col("source").cast("string")), digest: F.unhex(F.md5("text"))}
    mix = _mix(docs, seed, keys[digest]).filter("size > 0")
    taken = mix.groupBy(keys[null].alias(null), keys[number].alias(number), F.col("_key").alias(source), F.col("_text").alias(digest))
    taken = taken.agg(F.min("_copies").alias(base), (F.sum("_copies") - F.min("_copies") * F.count("*")).alias(more)).filter(F.col(base) + F.col(more) > 0)
    rows = docs.withColumns(keys).join(taken, same)
    times = F.col(base) + (F.row_number().over(Window.partitionBy(*same).orderBy(number)) <= F.col(more)).cast("int")
    return rows.withColumn(copies, times.cast("int")).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(*names)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents"))
