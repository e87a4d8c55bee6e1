from pyspark.sql import functions as F

from linkspark.llm import langid


def test_sample_of_languages_stays_bounded(spark):
    """The row of least hash is in the sample whatever its remainder is, and doesn't widen it."""
    rows = spark.range(12000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 6).cast("string")).alias("lang"), F.concat(F.lit("text of "), F.md5(F.col("id").cast("string"))).alias("text"))
    fitted = langid.fit(rows, 50)
    used = {r.lang: r["count"] for r in rows.filter(langid.learnable() & fitted.used()).groupBy("lang").count().collect()}
    assert len(used) == 6 and all(20 <= n <= 90 for n in used.values())
    assert rows.filter(fitted.calibrates()).count() + sum(used.values()) == rows.filter(langid.learnable()).count()


def test_grams_counted_in_few_tasks(spark, monkeypatch):
    """Rows of grams don't grow with the partitions that texts are dealt over."""
    made = []
    monkeypatch.setattr(langid, "Model", lambda counts: made.append(counts) or counts)
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.concat(F.lit("same text "), F.col("id").cast("string")).alias("text"))
    tasks = []
    count = langid._count
    monkeypatch.setattr(langid, "_count", lambda batches: count(batches))
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, g=type(rows).mapInArrow: tasks.append(self.rdd.getNumPartitions()) or g(self, f, schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        langid.fit(rows.repartition(13), 1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made[-1]) == 1 and max(tasks) <= langid.COUNTERS
