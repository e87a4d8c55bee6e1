"""Integrity checks of processed files and the checker of result files. A check is a row: (check, expected, observed, passed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One pass over ``df``: an expected and an observed aggregate for each check."""
    one = df.agg(*(x for k, (e, o) in checks.items() for x in (e.cast("long").alias(f"{k}|e"), o.cast("long").alias(f"{k}|o"))))
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(f"{k}|e").alias("expected"), F.col(f"{k}|o").alias("observed")) for k in checks)))
    return one.select(found.alias("c")).select("c.*").withColumn("passed", F.col("expected").eqNullSafe(F.col("observed")))


def check_processed(raw: DataFrame, processed: DataFrame, prefix: str) -> DataFrame:
    """Counts, ids, raw values kept, missing flags and losses, in two passes: over the processed rows and over a full
    join with the raw ones."""
    c, zero = F.col, F.lit(0)
    lost = lambda a, b: F.count_if(c(a).isNotNull() & c(b).isNull())
    own = _rows(processed, {
        "ids distinct": (F.count("*"), F.count_distinct("entity_id")), "ids not null": (zero, F.count_if(c("entity_id").isNull())), "id prefix": (F.count("*"), F.count_if(c("entity_id").startswith(prefix))),
        "one split": (F.lit(1), F.count_distinct("split")), "one source": (F.lit(1), F.count_distinct("source")),
        "replacement characters": (zero, F.count_if(c("business_name_raw").contains("�") | c("business_address_raw").contains("�"))),
        "name missing": (F.count_if(c("name_norm").isNull()), F.count_if("name_missing")), "address missing": (F.count_if(c("address_norm").isNull()), F.count_if("address_missing")),
        "clean names without tokens": (zero, lost("name_clean", "name_tokens")), "clean addresses without tokens": (zero, lost("address_clean", "address_tokens")),
        "retokenised names": (zero, F.count_if(F.array_join("name_tokens", " ") != c("name_clean"))), "retokenised addresses": (zero, F.count_if(F.array_join("address_tokens", " ") != c("address_clean"))),
        "name digits kept": (zero, F.count_if(F.regexp_replace("name_norm", r"(?U)\D", "") != F.regexp_replace(F.coalesce("name_clean", F.lit("")), r"(?U)\D", ""))),
        "romanised Latin names": (zero, F.count_if(c("name_latin").isNotNull() & c("name_script").isin("Latin", "None"))), "regions of unknown form": (zero, F.count_if(~c("address_region").rlike(r"^[A-Z]{2}-[A-Z]{2,3}$"))),
        "region flag": (F.count("address_region"), F.count_if("address_region_found")), "base is no longer than clean": (zero, F.count_if(F.length("name_base") > F.length("name_clean"))),
    })
    a = raw.select("entity_id", F.struct("business_name", "business_address", "country").alias("r"), F.lit(1).alias("_r"))
    b = processed.select("entity_id", F.struct(c("business_name_raw").alias("business_name"), c("business_address_raw").alias("business_address"), c("country_raw").alias("country")).alias("p"), F.lit(1).alias("_p"))
    both = _rows(a.join(b, "entity_id", "full"), {
        "row count": (F.count("_r"), F.count("_p")), "ids lost": (zero, F.count_if(c("_p").isNull())), "ids added": (zero, F.count_if(c("_r").isNull())), "raw values kept": (F.count("*"), F.count_if(c("r").eqNullSafe(c("p")))),
    })
    return own.unionByName(both)


def check_truth(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """Ground truth: distinct S1 ids, no id matched twice, only known ids, counts that add up."""
    pairs = truth.select("source1_entity_id", F.explode("matched_entity_ids").alias("entity_id"))
    unknown = pairs.join(ids.select("entity_id"), "entity_id", "left_anti").agg(F.count("*").alias("observed"))
    unknown = unknown.select(F.lit("known ids").alias("check"), F.lit(0).cast("long").alias("expected"), "observed", (F.col("observed") == 0).alias("passed"))
    own = _rows(truth, {"S1 ids distinct": (F.count("*"), F.count_distinct("source1_entity_id")), "counts add up": (F.sum("n_matches"), F.sum(F.col("n_s2") + F.col("n_s3"))), "no empty id": (F.lit(0), F.count_if(F.array_contains("matched_entity_ids", "")))})
    return own.unionByName(_rows(pairs, {"matched once": (F.count("*"), F.count_distinct("entity_id"))})).unionByName(unknown)


def _finding(rule: str, df: DataFrame, value: Column) -> DataFrame:
    """The rule's number of findings and its first five, sorted."""
    found = df.select(value.cast("string").alias("v")).distinct()
    counted = found.agg(F.count("*").alias("n"), F.lit(rule).alias("rule"))
    shown = found.orderBy("v").limit(5).agg(F.array_sort(F.collect_list("v")).alias("examples"), F.lit(rule).alias("rule"))
    return counted.join(shown, "rule").filter("n > 0").select("rule", "n", "examples")  # a row each


def id_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """Rows (s1, ids) and malformed lines of a file of S1 ids and comma lists, and its header."""
    lines = spark.read.text(path)
    numbered = lines.withColumn("_i", F.monotonically_increasing_id())
    header = numbered.orderBy("_i").limit(1).collect()
    if not header:
        return numbered.limit(0).select("value"), numbered.limit(0).select("value"), ""
    body = numbered.filter(F.col("_i") != header[0]["_i"])
    split = F.split("value", "\t", 2)
    rest = F.element_at(split, 2)
    rows = body.filter(F.col("value").contains("\t")).select(F.element_at(split, 1).alias("s1"), F.when(F.trim(rest) != "", F.split(rest, ",")).otherwise(F.array().cast("array<string>")).alias("ids"))
    return rows, body.filter(~F.col("value").contains("\t") & (F.trim("value") != "")).select("value"), header[0]["value"]


def check_submission(spark: SparkSession, path: str, header: list[str], required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Findings (rule, n, examples) of a result file; none if it is sound. ``required``: (s1); ``known``: (id)."""
    none = spark.createDataFrame([], "rule string, n long, examples array<string>")
    say = lambda rule, text: spark.createDataFrame([(rule, 1, [text])], "rule string, n long, examples array<string>")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return say("file not found", path)
    rows, malformed, first = id_lists(spark, path)
    if not first:
        return say("empty file", path)
    if "\t" not in first and "," in first:
        return say("commas instead of tabs", first)
    if [x.strip().lower() for x in first.split("\t")] != header:
        return say("unexpected header", first)
    ids = rows.select(F.explode("ids").alias("id"))
    out = [
        none, _finding("malformed row", malformed, F.col("value")), _finding("duplicate row", rows.groupBy("s1").count().filter("count > 1"), F.col("s1")),
        _finding("repeated id in a list", rows.filter(F.size("ids") != F.size(F.array_distinct("ids"))), F.col("s1")), _finding("self match", ids.filter(F.col("id").startswith("S1-")), F.col("id")),
        _finding("wrong prefix", ids.filter(~F.col("id").rlike("^S[123]-")), F.col("id")), _finding("missing S1", required.select("s1").join(rows, "s1", "left_anti"), F.col("s1")),
        _finding("unexpected S1", rows.join(required, "s1", "left_anti"), F.col("s1")),
    ]
    if known is not None:
        out.append(_finding("unknown id", ids.filter(F.col("id").rlike("^S[23]-")).join(known, "id", "left_anti"), F.col("id")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def not_among_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that aren't candidates: a warning, not an error."""
    pairs = lambda df: df.select("s1", F.explode("ids").alias("id"))
    return pairs(matches).join(pairs(candidates), ["s1", "id"], "left_anti")
