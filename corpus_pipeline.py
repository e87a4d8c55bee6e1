"""A training corpus from documents: language, quality, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. The last returns doc_id, the count and digests of its tokens and their ids. That has no SQL:
Kneser-Ney models, knapsacks and BPE aren't expressible.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from linkspark.llm import bpe, jaccard, langid, mixing, quality
from linkspark.llm.common import scratch

ORACLE_SQL = None


def _stage(operator, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return operator(docs)


STAGES = [
    ("language", partial(_stage, langid.filter_documents)),
    ("quality", partial(_stage, quality.filter_documents)),
    ("near duplicates", partial(_stage, jaccard.distinct_documents)),
    ("mix", partial(_stage, mixing.mixed)),
    ("tokens", partial(_stage, bpe.encode_documents)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
