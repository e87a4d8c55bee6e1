"""Sources and sinks."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..rules import RAW_COLUMNS

RAW = StructType([StructField(c, StringType()) for c in RAW_COLUMNS])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def scan_tsv(spark: SparkSession, path: str, schema: StructType = RAW, strict: bool = True) -> DataFrame:
    """Tab-separated text with a header, no quoting, nothing inferred. Malformed bytes arrive as U+FFFD; ``strict``
    makes a row of them an error when it is read."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    if not strict:
        return df
    bad = reduce(Column.__or__, (F.coalesce(F.col(c).contains("�"), F.lit(False)) for c in df.columns))
    first = df.columns[0]
    return df.withColumn(first, F.when(bad, F.raise_error(F.lit("malformed UTF-8")).cast("string")).otherwise(F.col(first)))


def scan_source(spark: SparkSession, root: str, split: str, source: str) -> DataFrame:
    number = source[-1]
    return scan_tsv(spark, f"{root}/{split}/{split}_source{number}.tsv", strict=False).withColumns({"split": F.lit(split), "source": F.lit(source)})


def scan_sources(spark: SparkSession, root: str, splits=("train", "test"), sources=("s1", "s2", "s3")) -> DataFrame:
    return reduce(DataFrame.unionByName, (scan_source(spark, root, a, b) for a in splits for b in sources))


def ground_truth(raw: DataFrame) -> DataFrame:
    """The id list parsed, and its counts by source."""
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    df = raw.select("source1_entity_id", F.col("matched_entity_ids").alias("matched_entity_ids_raw"), ids.alias("matched_entity_ids"))
    of = lambda p: F.size(F.filter("matched_entity_ids", lambda x: x.startswith(p)))
    return df.select("*", F.size("matched_entity_ids").alias("n_matches"), of("S2-").alias("n_s2"), of("S3-").alias("n_s3"))


def write_processed(df: DataFrame, path: str) -> None:
    """Parquet by split and source, sorted by country, so that filters on these prune files and row groups."""
    df.sortWithinPartitions("country_clean").write.mode("overwrite").option("compression", "zstd").partitionBy("split", "source").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files, each read in pieces by the task that it falls to."""
    def digest(frames):
        for paths in frames:
            rows = []
            for uri in paths["path"]:
                system, place = pa_fs.FileSystem.from_uri(uri)
                total, found = 0, hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while piece := stream.read(8 << 20):
                        total += len(piece)
                        found.update(piece)
                rows.append((uri, total, found.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "length", "sha256"])

    paths = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return paths.mapInPandas(digest, "path string, length long, sha256 string")


def sniff(spark: SparkSession, path: str, sep: str = "\t") -> dict[str, str]:
    """The types that a file's columns could have, by its values."""
    return dict(spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(path).dtypes)


def scan_truth(spark: SparkSession, path: str) -> DataFrame:
    """The ground truth's file, as text and parsed."""
    return ground_truth(scan_tsv(spark, path, TRUTH, strict=False))


def id_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values of a file's first column, its header left out."""
    lines = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return lines.select(F.col(lines.columns[0]).alias("id")).filter("id is not null").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()


def sample_bucket(key: Column, n: int) -> Column:
    """The same bucket in any engine that has MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n
