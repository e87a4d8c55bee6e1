"""Aggregates, windows and profiles that the reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def rate(flag: Column) -> Column:
    """Per cent of rows where the flag isn't null."""
    return F.avg(flag.cast("int")) * 100


def rate0(flag: Column) -> Column:
    """Per cent of all rows; null counts as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int")) * 100


def n_unique(c: Column) -> Column:
    """Distinct values, null among them."""
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def quantile(c: Column, q: float) -> Column:
    return F.percentile(c, F.lit(q))


def nearest_quantile(c: Column, q: float) -> Column:
    """The value at the rank nearest to q; of one group's values, which must fit a task: for reports."""
    found = F.sort_array(F.collect_list(c))
    return F.try_element_at(found, (F.round((F.size(found) - 1) * q) + 1).cast("int"))


def order_domain(df: DataFrame, columns: list[str], first: tuple[str, ...] = ("ALL", "train", "test")) -> DataFrame:
    """Sorted with some values before all others."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, first)), F.col(c).cast("string")), F.lit(0))
    return df.orderBy(*(x for c in columns for x in (F.when(rank(c) == 0, 99).otherwise(rank(c)), F.col(c).asc_nulls_first())))


def group_rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.round(rate(e), 2).alias(k) for k, e in flags.items()))


def with_total(df: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Groups, and a row of all with nulls for the keys."""
    return df.rollup(*by).agg(*aggregates, F.grouping_id().alias("_g")).filter(F.col("_g").isin(0, 2 ** len(by) - 1)).drop("_g")


def share_of(df: DataFrame, count: str, by: list[str]) -> DataFrame:
    return df.withColumn("pct", F.round(F.col(count) * 100 / F.sum(count).over(Window.partitionBy(*by)), 3))


def hashed(*parts: Column) -> Column:
    """128 bits of some values, to group by in place of long texts; null if one is."""
    both = F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))
    return F.when(reduce(Column.__and__, (p.isNotNull() for p in parts)), both)


def duplicate_stats(df: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """How many values repeat, how many rows they hold, and the largest group. Null is a value."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key] + [F.col(c).isNull() for c in key]
    return _repeats(df.select(*by, hashed(*shown).alias("_h")), by)


def _repeats(hashes: DataFrame, by: list[str]) -> DataFrame:
    counts = hashes.groupBy(*by, "_h").agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return counts.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_values"), F.count_if(many).alias("repeated_values"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("rows_in_repeated"), F.max("n").alias("max_group"),
    )


def group_sizes(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("groups"))


def histogram(df: DataFrame, value: Column, by: list[str], low: int, high: int) -> DataFrame:
    """Rows by value, clipped to the range."""
    return df.filter(value.isNotNull()).groupBy(*by, F.least(F.greatest(value, F.lit(low)), F.lit(high)).alias("value")).agg(F.count("*").alias("rows"))


def collisions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Values of ``after`` that several values of ``before`` were merged into."""
    return df.filter(F.col(after).isNotNull()).groupBy(after).agg(F.count_distinct(before).alias("distinct_before"), F.count("*").alias("rows")).filter("distinct_before > 1")


def stage_effects(df: DataFrame, stages: list[str], by: list[str]) -> DataFrame:
    """For each stage and group: rows changed from the stage before, values that became null, distinct values. One pass:
    a row for each stage, by the hash of its value."""
    def step(before: str, after: str) -> Column:
        a, b = F.col(before), F.col(after)
        return F.struct(F.lit(after).alias("stage"), (~a.eqNullSafe(b)).cast("int").alias("changed"), (a.isNotNull() & b.isNull()).cast("int").alias("lost"), hashed(b).alias("h"))

    long = df.select(*by, F.explode(F.array(*(step(a, b) for a, b in zip(stages, stages[1:], strict=False)))).alias("s")).select(*by, "s.*")
    values = long.groupBy(*by, "stage", "h").agg(F.count("*").alias("n"), F.sum("changed").alias("changed"), F.sum("lost").alias("lost"))
    return values.groupBy(*by, "stage").agg(F.sum("n").alias("rows"), F.round(F.sum("changed") * 100 / F.sum("n"), 3).alias("pct_changed"), F.sum("lost").alias("became_null"), F.count("h").alias("distinct_values"))


def record_keys(df: DataFrame) -> dict[str, list[Column]]:
    """Ten composite keys of processed records."""
    from .channels import folded

    c = F.col
    pairs = {"raw": ("business_name_raw", "business_address_raw"), "norm": ("name_norm", "address_norm"), "clean": ("name_clean", "address_clean")}
    both = {f"name_{k} + address_{k}": [c(n), c(a)] for k, (n, a) in pairs.items()}
    alone = {f"{k} only": [c({"name_raw": "business_name_raw"}.get(k, k))] for k in ("name_raw", "name_clean", "name_base", "address_clean")}
    return both | {
        "folded name_clean + folded address_clean": [folded(df, "name_clean"), folded(df, "address_clean")], "name_base + address_clean": [c("name_base"), c("address_clean")],
        "sorted name_tokens + sorted address_tokens": [A.sorted_key(c("name_tokens")), A.sorted_key(c("address_tokens"))],
    } | alone


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """A row for each record and composite key that it has."""
    keys = record_keys(df)
    parts = df.select(*by, "entity_id", *(p.alias(f"_{i}_{j}") for i, ps in enumerate(keys.values()) for j, p in enumerate(ps)))
    each = F.array(*(F.struct(F.lit(k).alias("key"), hashed(*(F.col(f"_{i}_{j}") for j in range(len(ps)))).alias("_h")) for i, (k, ps) in enumerate(keys.items())))
    return parts.select(*by, "entity_id", F.explode(each).alias("_k")).select(*by, "entity_id", "_k.*").filter("_h is not null")


def key_collisions(df: DataFrame, by: list[str]) -> DataFrame:
    """duplicate_stats of each composite key, rows with a null in it left out, in one pass."""
    return _repeats(_keyed(df, by), [*by, "key"])


def key_collision_examples(df: DataFrame, by: list[str], k: int = 2, shown: int = 3) -> DataFrame:
    """Of each composite key the k largest groups and some of their ids."""
    groups = _keyed(df, by).groupBy(*by, "key", "_h").agg(F.count("*").alias("n"), F.min("entity_id").alias("first"), F.array_sort(F.collect_set("entity_id")).alias("ids")).filter("n > 1")
    return first_n(groups, [*by, "key"], [F.col("n").desc(), F.col("first")], k).select(*by, "key", "n", F.slice("ids", 1, shown).alias("examples"))


def purity(records: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Of keys that several records share: how many join records of different entities. ``truth``: (entity_id, s1)."""
    groups = records.filter(F.col(key).isNotNull()).join(truth, "entity_id", "left").groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("s1").alias("s1s"), F.count_if(F.col("s1").isNull()).alias("unmatched"))
    mixed = F.col("s1s") + (F.col("unmatched") > 0).cast("int") > 1
    return groups.filter("n > 1").agg(F.count("*").alias("shared_keys"), F.count_if(mixed).alias("mixed_keys"), F.round(F.avg(mixed.cast("int")) * 100, 3).alias("pct_mixed"))


def agreement(pairs: DataFrame, left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Per cent of pairs (s1, q) that agree on each column, of pairs where both have it."""
    a = left.select(F.col("entity_id").alias("s1"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = right.select(F.col("entity_id").alias("q"), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = pairs.join(a, "s1").join(b, "q")
    row = both.agg(F.count("*").alias("pairs"), *(F.round(rate(F.col(f"a_{c}") == F.col(f"b_{c}")), 3).alias(c) for c in columns))
    return row.unpivot("pairs", columns, "representation", "pct_equal")


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks within groups."""
    def ranks(c: str) -> Column:
        w = Window.partitionBy(*by).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    return df.dropna(subset=[a, b]).select(*by, ranks(a).alias("_a"), ranks(b).alias("_b")).groupBy(*by).agg(F.round(F.corr("_a", "_b"), 6).alias("spearman"), F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, by: list[str], k: int) -> DataFrame:
    """The k commonest values of each group, ties to the smaller."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), column))).filter(F.col("rank") <= k)


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def shuffled_partner(df: DataFrame, key: str, by: list[str], seed: int = 42) -> DataFrame:
    """Each row with the row that a seeded shuffle of its group puts in its place: a random baseline."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    other = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key))
    right = df.select(*by, F.col(key).alias("partner"), other.alias("_p"))
    return df.withColumn("_p", place).join(right, [*by, "_p"]).drop("_p")


def fingerprint(df: DataFrame) -> DataFrame:
    """A sum of hashes for each column: the same for the same rows in any order, and in any engine that has MD5."""
    number = lambda c: F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), *(F.sum(number(c)).alias(c) for c in df.columns))
