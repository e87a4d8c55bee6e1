"""The study of channels: each is computed once for the largest k, then cut, joined and scored in many ways."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..sources.staging import staged
from . import channels as CH
from . import evaluate as EV


class Meter:
    """Seconds and the driver's peak memory of named steps. Executors' own is in Spark's metrics."""

    def __init__(self):
        self.rows: list[tuple[str, float, float]] = []

    def measure(self, name: str, make):
        begin = time.perf_counter()
        out = make()
        self.rows.append((name, round(time.perf_counter() - begin, 3), round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)))
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, seconds double, driver_peak_mb double")


def channel_runs(name: str, index: DataFrame, queries: DataFrame, caps: str = "medium", k: int = 30, channels: Iterable[str] = tuple(CH.ABLATIONS["all"]), meter: Meter | None = None) -> dict[str, DataFrame]:
    """Each channel's candidates for the largest k, staged under ``name``."""
    spark, meter = index.sparkSession, meter or Meter()
    return {c: meter.measure(f"channel {c}", lambda c=c: staged(spark, f"{name} {caps} {k} {c}", lambda: CH.make(c, index, queries, k, caps))) for c in channels}


def joined(runs: dict[str, DataFrame], ks: dict[str, int]) -> DataFrame:
    """Distinct pairs of some channels, each cut at its own k; channels of exact keys aren't cut."""
    return reduce(DataFrame.union, (CH.cut(runs[c], k if c not in "ABC" else 1).select("q", "s1") for c, k in ks.items())).distinct()


def _scored(pairs: DataFrame, candidates: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    found, size = EV.recall(pairs, candidates), EV.sizes(queries, candidates)
    return found.join(F.broadcast(size.select("mean", "total"))).withColumn("config", F.lit(name))  # one row each


def ablation(pairs: DataFrame, runs: dict[str, DataFrame], queries: DataFrame, configs: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Recall and candidates a record of each mix of channels."""
    configs = configs or CH.ABLATIONS
    return reduce(DataFrame.unionByName, (_scored(pairs, joined(runs, ks), queries, name) for name, ks in configs.items()))


def curve(pairs: DataFrame, runs: dict[str, DataFrame], queries: DataFrame, caps: str, ks: Iterable[int] = rules.KS) -> DataFrame:
    """Recall and candidates a record of all channels by k, for one set of caps."""
    return reduce(DataFrame.unionByName, (_scored(pairs, joined(runs, dict.fromkeys(runs, k)), queries, f"{caps} k={k}").withColumns({"caps": F.lit(caps), "k": F.lit(k)}) for k in ks))


def channel_summary(pairs: DataFrame, runs: dict[str, DataFrame], queries: DataFrame, ks: dict[str, int] | None = None) -> DataFrame:
    """Recall and sizes of each channel alone and of all together."""
    ks = ks or CH.ABLATIONS["all"]
    single = [_scored(pairs, joined(runs, {c: ks[c]}), queries, c) for c in runs]
    return reduce(DataFrame.unionByName, [*single, _scored(pairs, joined(runs, {c: ks[c] for c in runs}), queries, "union of all")])


def grouped_recall(pairs: DataFrame, candidates: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return EV.recall(pairs, candidates, by)


def unlabelled_counts(index: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Where there is no truth: by country, records and candidates a record."""
    country = queries.select(F.col("entity_id").alias("q"), "country_clean")
    counts = candidates.select("q", "s1").distinct().groupBy("q").agg(F.count("*").alias("n"))
    rows = country.join(counts, "q", "left").na.fill(0, ["n"]).groupBy("country_clean").agg(F.count("*").alias("queries"), F.sum("n").alias("candidates"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("max"))
    return rows.join(index.groupBy("country_clean").agg(F.count("*").alias("index_records")), "country_clean", "left")


def write_manifest(path: str, meter: Meter, config: dict) -> str:
    """Steps and configuration as JSON, on the driver."""
    text = json.dumps({"steps": [dict(zip(("step", "seconds", "driver_peak_mb"), r, strict=True)) for r in meter.rows], "config": config}, ensure_ascii=False, indent=1)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return text
