"""Frames that many queries read: computed once, written as Parquet to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; on one machine, where nothing does, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return named or _STAGED.setdefault((spark.sparkContext.applicationId, ""), tempfile.mkdtemp(prefix="staged"))


def staged(spark: SparkSession, name: str, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """``make()``, written the first time that this application asks for ``name`` and read from then on."""
    key = (spark.sparkContext.applicationId, name)
    if fresh or key not in _STAGED:
        path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def forget(spark: SparkSession, name: str) -> None:
    """Delete a staged frame."""
    path = _STAGED.pop((spark.sparkContext.applicationId, name), None)
    if path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
