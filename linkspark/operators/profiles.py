"""Reports over processed records (measurement) and raw ones (profiling). Each is a few aggregates over one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import arrays as A
from ..functions import text as T
from . import reports as R


def u(pattern: str) -> str:
    """A pattern whose \\s, \\d and \\b are Unicode-aware, whatever flags it begins with."""
    return f"(?iU){pattern[4:]}" if pattern.startswith("(?i)") else f"(?U){pattern}"


def flags(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "boolean"]


# ---------------------------------------------------------------- measurement of processed records


def source_comparison(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, the rate of every flag, and means and medians of counts and lengths."""
    c, mean = F.col, lambda e, digits=3: F.round(F.avg(e), digits)
    rates = {f"pct_{f}": R.rate(c(f)) for f in flags(df)} | {"pct_postal_code_candidate": R.rate(c("postal_code_candidate").isNotNull())}
    rates |= {f"pct_{x}_has_numbers": R.rate(F.size(f"{x}_numbers") > 0) for x in ("name", "address") if f"{x}_numbers" in df.columns}
    out = [F.count("*").alias("records"), *(F.round(e, 3).alias(k) for k, e in rates.items())]
    for x in ("name", "address"):
        out += [mean(F.size(f"{x}_tokens")).alias(f"{x}_tokens_mean"), F.median(F.size(f"{x}_tokens")).alias(f"{x}_tokens_median")]
        out += [mean(F.length(f"business_{x}_raw"), 2).alias(f"{x}_len_raw_mean"), mean(F.length(f"{x}_clean"), 2).alias(f"{x}_len_clean_mean")]
    return df.groupBy(*by).agg(*out, mean(F.size("address_segments")).alias("address_segments_mean"))


def uniqueness(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values of each representation, null among the names', and by how much cleaning lowers their number. The
    values are hashed and counted in one pass."""
    names = {"name_raw": "business_name_raw", "name_norm": "name_norm", "name_clean": "name_clean", "name_base": "name_base"}
    addresses = {"address_raw": "business_address_raw", "address_norm": "address_norm", "address_clean": "address_clean"}
    value = lambda k, c: F.struct(F.lit(k).alias("k"), F.coalesce(R.hashed(F.col(c)), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).alias("h"), F.col(c).isNull().alias("null"))
    every = {**names, **addresses}
    distinct = df.select(*by, F.explode(F.array(*(value(k, c) for k, c in every.items()))).alias("v")).groupBy(*by, "v.k", "v.h", "v.null").agg(F.count("*").alias("n"))
    count = lambda k: F.count_if((F.col("k") == k) & (~F.col("null") if k in addresses else F.lit(True)))
    out = distinct.groupBy(*by).agg(F.sum(F.when(F.col("k") == "name_raw", F.col("n"))).alias("records"), *(count(k).alias(k) for k in every))
    less = lambda after, before: F.round((1 - F.col(after) / F.col(before)) * 100, 3)
    return out.withColumns({
        "name_pct_unique_reduction_raw_to_clean": less("name_clean", "name_raw"), "name_pct_unique_reduction_raw_to_base": less("name_base", "name_raw"), "address_pct_unique_reduction_raw_to_clean": less("address_clean", "address_raw"),
    })


def country_values(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "country_raw", "country_clean").agg(F.count("*").alias("records"))


def missing_values(df: DataFrame, by: list[str]) -> DataFrame:
    nulls = {
        "name_null_raw": "business_name_raw", "address_null_raw": "business_address_raw", "country_null_raw": "country_raw", "name_norm_null": "name_norm", "name_clean_null": "name_clean", "name_base_null": "name_base", "address_norm_null": "address_norm",
        "address_clean_null": "address_clean", "country_clean_null": "country_clean",
    }
    return df.groupBy(*by).agg(F.count("*").alias("records"), *(F.count_if(F.col(c).isNull()).alias(k) for k, c in nulls.items() if c in df.columns), F.count_if("address_placeholder_only").alias("address_placeholder_only"))


def scripts(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Records by script, and their share of the group."""
    counts = df.groupBy(*by, F.col(column).alias("script")).agg(F.count("*").alias("records"))
    return R.share_of(counts, "records", by)


def legal_forms(df: DataFrame, by: list[str]) -> DataFrame:
    """How often each class of legal form occurs in 100 records of a group."""
    forms = df.select(*by, F.explode("name_legal_forms").alias("form")).groupBy(*by, "form").agg(F.count("*").alias("occurrences"))
    return forms.join(df.groupBy(*by).agg(F.count("*").alias("records")), by).withColumn("per_100_records", F.round(F.col("occurrences") / F.col("records") * 100, 3))


def domain_tlds(df: DataFrame, by: list[str]) -> DataFrame:
    return df.filter("name_domain is not null").groupBy(*by, T.top_level_domain(F.col("name_domain")).alias("tld")).agg(F.count("*").alias("records"))


def postal_candidates(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("records"), F.count("postal_code_candidate").alias("with_candidate"), F.min("postal_code_candidate").alias("example"))


def token_counts(df: DataFrame, by: list[str], most: dict[str, int] | None = None) -> DataFrame:
    """Records by the number of tokens of their name and address, up to a greatest number each."""
    most = most or {"name": 15, "address": 40}
    each = F.array(*(F.struct(F.lit(k).alias("field"), F.least(F.greatest(F.size(f"{k}_tokens"), F.lit(0)), F.lit(n)).alias("n"), F.col(f"{k}_tokens").isNotNull().alias("has")) for k, n in most.items()))
    long = df.select(*by, F.explode(each).alias("t")).select(*by, "t.*")
    return long.groupBy(*by, "field", F.when(F.col("has"), F.col("n")).alias("n")).agg(F.count("*").alias("records"))


def noise_patterns() -> dict[str, Column]:
    """Noise that the build deliberately leaves in place."""
    name, address, c = F.col("name_clean"), F.col("address_clean"), F.col
    has = lambda column, pattern: column.rlike(u(pattern))
    states = rf"\b(?:{'|'.join(k.lower() for k in rules.US_CODES)})\b"
    return {
        "name: letter-digit mixed token": has(name, rules.MIXED_TOKEN), "name: non-Latin script": c("name_has_non_latin"), "name: whole name is a domain": c("name_is_domain_only"), "name: legal form first token": c("name_legal_at_start"),
        "name: very long token": F.exists(A.tokens(name), lambda t: F.length(t) >= rules.LONG_TOKEN), "name: honorific or prefix": has(name, rules.HONORIFIC), "name: repeated token": A.repeats(A.tokens(name)), "name: '&' present": name.contains("&"),
        "name: 'and' present": has(name, r"\band\b"), "address: abbreviated street type": has(address, rules.SHORT_STREET), "address: full street type": has(address, rules.FULL_STREET), "address: non-Latin script": has(address, rules.NON_LATIN_LETTER),
        "address: US state code as a token": (c("country_clean") == "US") & has(address, states), "address: zero-padded number": c("address_has_zero_padded_number"), "address: null token inside a segment": has(address, rules.NULL_TOKEN),
        "address: letter-digit mixed token": has(address, rules.MIXED_TOKEN), "address: single segment only": F.size("address_segments") == 1,
    }


def remaining_noise(df: DataFrame, by: list[str]) -> DataFrame:
    """Of all records of a group, those with each kind of noise, in per cent; a null counts as none."""
    found = noise_patterns()
    wide = df.groupBy(*by).agg(F.count("*").alias("records"), *(F.round(R.rate0(e), 3).alias(k) for k, e in found.items()))
    return wide.unpivot([*by, "records"], [F.col(f"`{k}`") for k in found], "pattern", "pct_records")


def examples(df: DataFrame, cases: dict[str, Column], by: list[str], columns: list[str], k: int = 2, one_of: int = 1) -> DataFrame:
    """Of each case and group the first k records by the hash of their id, of one in ``one_of`` of them."""
    from ..sources.io import sample_bucket

    found = F.array_compact(F.array(*(F.when(F.coalesce(e, F.lit(False)), F.lit(n)) for n, e in cases.items())))
    some = df.filter(sample_bucket(F.col("entity_id"), one_of) == 0).withColumn("case", F.explode(found))
    return R.first_n(some.withColumn("_md5", F.md5("entity_id")), [*by, "case"], [F.col("_md5"), F.col("entity_id")], k).select(*by, "case", *columns)


def interesting() -> Column:
    """Records whose representations differ in ways worth showing."""
    c = F.col
    some = ("name_has_special_chars", "name_has_non_latin", "name_is_domain_only", "address_has_placeholder", "name_legal_at_start", "address_has_encoding_artifact", "name_has_latin_diacritics")
    return reduce(Column.__or__, (F.coalesce(c(x), F.lit(False)) for x in some), F.coalesce(c("business_name_raw").rlike(r"\p{L}\.\p{L}\.|\p{L}'\p{L}"), F.lit(False)))


def representation_examples(df: DataFrame, k: int = 3, one_of: int = 20) -> DataFrame:
    lists = {"name_tokens", "name_legal_forms", "name_numbers", "address_segments", "address_numbers"}
    shown = [F.array_join(c, " | ").alias(c) if c in lists else F.col(c) for c in df.columns]
    return examples(df.withColumn("country", F.col("country_clean")), {"interesting": interesting()}, ["country"], ["entity_id"], k, one_of).select("entity_id").join(df.select(*shown), "entity_id")


def preprocessing_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """A row a file: records, distinct ids, and what is missing before and after."""
    return df.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_distinct("entity_id").alias("distinct_ids"), F.count_if(F.col("business_address_raw").isNull()).alias("address_null_raw"), F.count_if(F.col("address_clean").isNull()).alias("address_clean_null"),
        F.count_if(F.col("name_clean").isNull()).alias("name_clean_null"), F.count_if(~F.col("business_name_raw").eqNullSafe(F.col("name_clean"))).alias("names_changed"),
    )


# ---------------------------------------------------------------- profiling of raw records


def file_overview(df: DataFrame, by: list[str], prefix: Column) -> DataFrame:
    """Rows, distinct ids, ids of the wrong form (``prefix``: what an id must begin with, a dash and digits after it)."""
    sound = F.col("entity_id").startswith(prefix) & F.regexp_replace("entity_id", r"^[^-]*-", "").rlike(r"^\d+\z")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("entity_id").alias("distinct_ids"), F.count_if(~sound).alias("bad_ids"), F.count_if(F.col("business_name").isNull()).alias("null_names"), F.count_if(F.col("business_address").isNull()).alias("null_addresses"))


def id_form(c: Column, source: str) -> Column:
    return c.rlike(rf"^{source}-\d+\z")


def legal_words(df: DataFrame, by: list[str], name: Column) -> DataFrame:
    """Rates of legal forms as words of ``name`` (profiling's normaliser), of any, and of any at its start."""
    any_form = "|".join(f"(?:{p})" for p in rules.LEGAL_FORMS.values())
    df = df.withColumn("_n", name)
    rate = lambda pattern: F.round(R.rate(F.col("_n").rlike(u(pattern))), 2)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), rate(any_form).alias("ANY_legal_form"), rate(rf"^(?:{any_form})\b").alias("legal_form_at_START"), *(rate(p).alias(k) for k, p in rules.LEGAL_FORMS.items()))


def address_structure(df: DataFrame, by: list[str], a: Column) -> DataFrame:
    """Mean number of segments, and rates of the ways in which addresses are built."""
    found = {k: a.rlike(u(p)) for k, p in rules.ADDRESS_PATTERNS.items()}
    found["house no. only in later segment"] &= ~a.rlike(u(rules.STARTS_WITH_NUMBER))
    segments = F.length(F.regexp_replace(a, "[^,]", "")) + 1
    return df.filter(a.isNotNull()).groupBy(*by).agg(F.count("*").alias("rows"), F.round(F.avg(segments), 2).alias("mean_comma_segments"), *(F.round(R.rate(e), 2).alias(k) for k, e in found.items()))


def address_terms(df: DataFrame, by: list[str], a: Column) -> DataFrame:
    """term, form (full or abbr), pct of addresses with it."""
    forms = {f"{t}|{form}": p for t, both in rules.ADDRESS_TERMS.items() for form, p in zip(("full", "abbr"), both, strict=True)}
    wide = df.withColumn("_a", a).filter("_a is not null").groupBy(*by).agg(*(F.round(R.rate(F.col("_a").rlike(u(p))), 2).alias(k) for k, p in forms.items()))
    long = wide.unpivot(by, [F.col(f"`{k}`") for k in forms], "term_form", "pct")
    parts = F.split("term_form", r"\|")
    return long.select(*by, parts[0].alias("term"), parts[1].alias("form"), "pct")


def uniqueness_raw_and_normalised(df: DataFrame, by: list[str], name: Column, address: Column) -> DataFrame:
    """Distinct names, addresses and pairs of both, raw and by profiling's normaliser, and the part that is merged."""
    df = df.select(*by, "business_name", "business_address", name.alias("_n"), address.alias("_a"))
    kinds = {"name": (F.col("business_name"), F.col("_n")), "address": (F.col("business_address"), F.col("_a"))}
    hashes = {f"{k}_{w}": R.hashed(F.coalesce(e, F.lit(""))) for k, both in kinds.items() for w, e in zip(("raw", "normalised"), both, strict=True)}
    hashes |= {f"both_{w}": R.hashed(*(F.coalesce(kinds[k][i], F.lit("")) for k in kinds)) for i, w in enumerate(("raw", "normalised"))}
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), h.alias("h")) for k, h in hashes.items()))).alias("v")).select(*by, "v.*").distinct()
    out = long.groupBy(*by).agg(*(F.count_if(F.col("k") == k).alias(k) for k in hashes))
    return out.withColumns({f"{k}_pct_merged": F.round((1 - F.col(f"{k}_normalised") / F.col(f"{k}_raw")) * 100, 3) for k in ("name", "address", "both")})


# ---------------------------------------------------------------- ground truth


def truth_summary(gt: DataFrame) -> DataFrame:
    """metric, value over (source1_entity_id, matched_entity_ids, n_matches, n_s2, n_s3)."""
    n = F.col("n_matches")
    values = {
        "S1 entities": F.count("*"), "total matched records (pairs)": F.sum(n), "pairs to S2": F.sum("n_s2"), "pairs to S3": F.sum("n_s3"), "singletons (0 matches)": F.count_if(n == 0), "exactly 1 match": F.count_if(n == 1), ">=2 matches": F.count_if(n >= 2),
        "mean matches / S1": F.round(F.avg(n), 3), "median matches / S1": F.median(n), "max matches / S1": F.max(n), "duplicate ids inside a list": F.sum(F.size("matched_entity_ids") - F.size(F.array_distinct("matched_entity_ids"))),
    }
    wide = gt.agg(*(e.cast("double").alias(k) for k, e in values.items()))
    return wide.unpivot([], [F.col(f"`{k}`") for k in values], "metric", "value")


def match_counts(gt: DataFrame) -> DataFrame:
    counts = gt.groupBy("n_matches").agg(F.count("*").alias("s1_entities"))
    return counts.withColumn("pct", F.round(F.col("s1_entities") / F.sum("s1_entities").over(Window.partitionBy(F.lit(0))) * 100, 2))  # a row a number of matches


def match_crosstab(gt: DataFrame) -> DataFrame:
    return gt.groupBy("n_s2", "n_s3").agg(F.count("*").alias("s1_entities"))


def coverage(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """By source: records, and those that are matched."""
    hit = pairs.select(F.col("q").alias("entity_id")).distinct().withColumn("hit", F.lit(1))
    rows = others.select("entity_id", "source").join(hit, "entity_id", "left").groupBy("source").agg(F.count("*").alias("records"), F.count("hit").alias("matched"))
    return rows.withColumn("pct_matched", F.round(F.col("matched") / F.col("records") * 100, 2))


def country_agreement(pairs: DataFrame, df: DataFrame) -> DataFrame:
    side = lambda k, c: df.select(F.col("entity_id").alias(k), F.col("country_clean").alias(c))
    return pairs.join(side("s1", "s1_country"), "s1").join(side("q", "m_country"), "q").groupBy("s1_country", "m_country").agg(F.count("*").alias("pairs"))


def singletons(gt: DataFrame, df: DataFrame) -> DataFrame:
    """By country: the part of S1 entities without a match, and the mean numbers of matches."""
    rows = gt.join(df.select(F.col("entity_id").alias("source1_entity_id"), "country_clean"), "source1_entity_id")
    return rows.groupBy("country_clean").agg(F.count("*").alias("s1_entities"), F.round(R.rate(F.col("n_matches") == 0), 2).alias("pct_singleton"), *(F.round(F.avg(f"n_{k}"), 2).alias(f"mean_{k}") for k in ("matches", "s2", "s3")))


def pair_frame(pairs: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (s1, q) with both sides' columns, a_ and b_."""
    side = lambda k, p: df.select(F.col("entity_id").alias(k), *(F.col(c).alias(f"{p}{c}") for c in columns))
    return pairs.join(side("s1", "a_"), "s1").join(side("q", "b_"), "q")


def similarity(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Each true pair with how alike its names and addresses are."""
    both = pair_frame(pairs, df, ["name_clean", "address_clean", "name_script", "address_missing", "source"])
    tokens = lambda c: A.tokens(F.coalesce(F.col(c), F.lit("")))
    latin = lambda c: F.col(c).isin("Latin", "None")
    return both.select(
        "s1", "q", F.col("b_source").alias("source"), (F.col("a_name_clean") == F.col("b_name_clean")).alias("name_equal"), (F.col("a_address_clean") == F.col("b_address_clean")).alias("address_equal"),
        (A.sorted_key(tokens("a_name_clean")) == A.sorted_key(tokens("b_name_clean"))).alias("name_same_tokens"), A.jaccard(tokens("a_name_clean"), tokens("b_name_clean")).alias("name_jaccard"),
        A.jaccard(tokens("a_address_clean"), tokens("b_address_clean")).alias("address_jaccard"), F.col("b_address_missing").alias("match_address_missing"), (latin("a_name_script") & ~latin("b_name_script")).alias("match_non_latin"),
    )


def hard_cases() -> dict[str, Column]:
    c = F.col
    return {
        "no shared name token": c("name_jaccard") == 0, "match name in non-Latin script": c("match_non_latin"), "same tokens, different order": c("name_same_tokens") & ~c("name_equal"), "match address missing": c("match_address_missing"),
        "low address overlap (<0.2) despite equal name": c("name_equal") & (c("address_jaccard") < 0.2),
    }


def hard_rates(alike: DataFrame) -> DataFrame:
    found = hard_cases()
    return alike.agg(*(F.round(R.rate(e), 2).alias(k) for k, e in found.items())).unpivot([], [F.col(f"`{k}`") for k in found], "case", "pct_of_pairs")


def similarity_profile(alike: DataFrame, by: list[str]) -> DataFrame:
    return alike.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.round(R.rate(F.col("name_equal")), 2).alias("pct_name_equal"), F.round(R.rate(F.col("address_equal")), 2).alias("pct_address_equal"), F.round(R.rate(F.col("name_same_tokens")), 2).alias("pct_name_same_tokens"),
        F.round(F.avg("name_jaccard"), 4).alias("name_jaccard_mean"), F.round(F.avg("address_jaccard"), 4).alias("address_jaccard_mean"),
    )


def similarity_histogram(alike: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Pairs by twentieth of a similarity from 0 to 1, and their share."""
    place = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = alike.filter(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("pairs"))
    return counts.withColumn("pct", F.round(F.col("pairs") * 100 / F.sum("pairs").over(Window.partitionBy(F.lit(0))), 3))  # a row a bin


def show_group(s1: str, pairs: DataFrame, df: DataFrame) -> DataFrame:
    """An S1 record and its matches, that first."""
    ids = pairs.filter(F.col("s1") == s1).select(F.col("q").alias("entity_id")).union(pairs.sparkSession.createDataFrame([(s1,)], "entity_id string"))
    return df.join(F.broadcast(ids.distinct()), "entity_id").withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("entity_id") != s1, "entity_id")))  # one entity


def decoys(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """How well an equal name finds true matches, by country and by whether the S1 record has any: precision, recall, and
    records of equal name that aren't matches."""
    heads = df.filter("source = 's1'").select(F.col("entity_id").alias("s1"), F.col("country_clean").alias("country"), F.col("name_clean").alias("k"))
    named = df.filter("source <> 's1'").select(F.col("entity_id").alias("q"), F.col("name_clean").alias("k"))
    hits = heads.select("s1", "k").join(named, "k").join(pairs.select("s1", "q", F.lit(1).alias("true")), ["s1", "q"], "left").groupBy("s1").agg(F.count("*").alias("same"), F.count("true").alias("true"))
    matches = pairs.groupBy("s1").agg(F.count("*").alias("n"))
    rows = heads.select("s1", "country").join(matches, "s1", "left").join(hits, "s1", "left").na.fill(0, ["n", "same", "true"]).withColumn("decoys", F.col("same") - F.col("true"))
    some = F.col("decoys") > 0
    return rows.groupBy("country", (F.col("n") == 0).alias("singleton")).agg(
        F.count("*").alias("s1_entities"), F.round(R.rate(F.col("same") > 0), 2).alias("pct_with_same_name_record"), F.round(R.rate(some), 2).alias("pct_with_decoy"), F.median(F.when(some, F.col("decoys"))).alias("median_decoys_when_any"),
        F.round(F.try_divide(F.sum("true"), F.sum("same")), 3).alias("exact_name_precision"), F.round(F.try_divide(F.sum("true"), F.sum("n")), 3).alias("exact_name_recall"),
    )


def overlap_between(df: DataFrame, column: str, by: str, left: str, right: str) -> DataFrame:
    """Distinct values of a column that two groups share, and each group's own number: train and test, say."""
    sides = df.filter(F.col(column).isNotNull() & F.col(by).isin(left, right)).groupBy(R.hashed(F.col(column)).alias("h")).agg(F.max((F.col(by) == left).cast("int")).alias("l"), F.max((F.col(by) == right).cast("int")).alias("r"))
    return sides.agg(F.sum("l").alias("left_values"), F.sum("r").alias("right_values"), F.sum(F.col("l") * F.col("r")).alias("shared_values"))
