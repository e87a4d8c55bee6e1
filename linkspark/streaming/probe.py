"""New records against a static index, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.channels import union
from ..plans.build import build, with_folded
from ..sources.io import RAW
from ..sources.staging import staged


def probe(spark: SparkSession, incoming: str, index: DataFrame, out: str, checkpoint: str, channels: dict[str, int] | None = None):
    """A query that normalises each batch of Parquet files of raw records at ``incoming`` and appends its candidates."""

    ready = staged(index.sparkSession, f"index of {checkpoint}", lambda: with_folded(index))  # once, not for each batch

    def each(batch: DataFrame, number: int) -> None:
        found = union(ready, with_folded(build(batch, "stream", "s2")), channels)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that comes again is written over

    stream = spark.readStream.schema(RAW).parquet(incoming)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
