"""Recall and size of candidate sets, and the matching metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.unicode import fold
from ..sources.io import sample_bucket


def truth_pairs(index: DataFrame, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs (s1, q) with five flags of what makes them hard."""
    side = lambda df, p, k: df.select(F.col("entity_id").alias(k), F.col("country_clean").alias(f"{p}country"), F.array_distinct(A.tokens(fold(F.col("name_clean")))).alias(f"{p}tokens"))
    extra = queries.select(F.col("entity_id").alias("q"), "source", "name_has_non_latin", "name_is_domain_only", "address_missing")
    pairs = truth.join(side(index, "a_", "s1"), "s1").join(side(queries, "b_", "q"), "q").join(extra, "q").filter("a_country = b_country")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return pairs.select(
        "s1", "q", "source", F.col("a_country").alias("country"), F.coalesce("name_has_non_latin", F.lit(False)).alias("non_latin_name"), F.coalesce("name_is_domain_only", F.lit(False)).alias("domain_only"),
        F.coalesce(shared == 0, F.lit(True)).alias("no_shared_token"), F.col("address_missing").alias("missing_address"), F.coalesce(F.array_sort("a_tokens") == F.array_sort("b_tokens"), F.lit(False)).alias("reordered"),
    )


SLICES = ("non_latin_name", "domain_only", "no_shared_token", "missing_address", "reordered")


def hits(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    found = candidates.select("s1", "q").distinct().withColumn("hit", F.lit(True))
    return truth.join(found, ["s1", "q"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def recall(truth: DataFrame, candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs found, and entities all of whose pairs are found, in per cent."""
    entities = hits(truth, candidates).groupBy(*by, "s1").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    return entities.groupBy(*by).agg(
        F.sum("n").alias("pairs"), F.round(F.sum("k") * 100 / F.sum("n"), 3).alias("pair_recall"), F.count("*").alias("entities"), F.round(F.avg((F.col("k") == F.col("n")).cast("int")) * 100, 3).alias("entity_recall"),
    )


def slice_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    found = hits(truth, candidates).select("hit", *(F.col(s).cast("string").alias(s) for s in SLICES)).unpivot("hit", list(SLICES), "slice", "inside")
    return found.filter("inside = 'true'").groupBy("slice").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("hit").cast("int")) * 100, 3).alias("pair_recall"))


def sizes(queries: DataFrame, candidates: DataFrame, side: str = "q") -> DataFrame:
    """Candidates a record: those without any count as zero."""
    counts = candidates.select("q", "s1").distinct().groupBy(side).agg(F.count("*").alias("n"))
    return size_figures(queries.select(F.col("entity_id").alias(side)).join(counts, side, "left").select(F.coalesce("n", F.lit(0)).alias("n")))


def size_figures(counts: DataFrame) -> DataFrame:
    """Of ``n``, a row a record."""
    return counts.agg(F.round(F.avg("n"), 4).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"), F.max("n").alias("max"), F.sum("n").alias("total"))


def by_matches(index: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The view of index records by how many true matches they have."""
    counts = hits(truth, candidates).groupBy("s1").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    every = index.select(F.col("entity_id").alias("s1")).join(counts, "s1", "left").na.fill(0, ["n", "k"])
    bucket = F.when(F.col("n") == 0, "0").when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").otherwise("4+")
    return every.groupBy(bucket.alias("true_matches")).agg(F.count("*").alias("records"), F.sum("n").alias("pairs"), F.sum("k").alias("found"))


def missed(truth: DataFrame, candidates: DataFrame, examples: int = 20) -> tuple[DataFrame, DataFrame]:
    """Missed pairs by country and source, and some of them in the order of a hash."""
    lost = truth.join(candidates.select("s1", "q"), ["s1", "q"], "left_anti")
    return lost.groupBy("country", "source").agg(F.count("*").alias("missed"), *(F.count_if(s).alias(s) for s in SLICES)), lost.orderBy(F.md5(F.concat("s1", F.lit("|"), "q")), "s1", "q").limit(examples)


def sample_block(index: DataFrame, queries: DataFrame, truth: DataFrame, pct: int = 10) -> tuple[DataFrame, DataFrame]:
    """A share of the index, with the matches of these and the same share of queries that match nothing."""
    picked = index.filter(sample_bucket(F.col("entity_id"), 100) < pct)
    own = truth.join(picked.select(F.col("entity_id").alias("s1")), "s1", "left_semi").select(F.col("q").alias("entity_id")).distinct()
    free = queries.join(truth.select(F.col("q").alias("entity_id")), "entity_id", "left_anti").filter(sample_bucket(F.col("entity_id"), 100) < pct)
    return picked, queries.join(own, "entity_id", "left_semi").unionByName(free)


def f_half(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Macro F0.5 over all S1 records of ``truth``, (s1, ids) each: 1.25 P R / (0.25 P + R); without true matches 1 if
    none is predicted, else 0."""
    none = F.array().cast("array<string>")
    both = truth.select("s1", F.array_distinct(F.coalesce("ids", none)).alias("t")).join(predicted.select("s1", F.array_distinct(F.coalesce("ids", none)).alias("p")), "s1", "left").withColumn("p", F.coalesce("p", none))
    k, t, p = F.size(F.array_intersect("t", "p")), F.size("t"), F.size("p")
    score = F.when(t == 0, (p == 0).cast("double")).when(k == 0, 0.0).otherwise(1.25 * (k / p) * (k / t) / (0.25 * (k / p) + k / t))
    return both.agg(F.count("*").alias("entities"), F.avg(score).alias("f_half"))


