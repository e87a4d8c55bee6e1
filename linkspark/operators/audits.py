"""Audits of what processing added, and comparisons of its stages."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import arrays as A
from ..functions import text as T
from ..functions import unicode as U
from ..sources.staging import staged
from . import reports as R
from .channels import folded
from .profiles import pair_frame, u

# ---------------------------------------------------------------- row order


def positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows numbered from 0 within their file, and by their place in it from 0 to 1. Files are numbered by parts: each
    task numbers its own rows, after the rows of the parts before."""
    number = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("row", F.row_number().over(number) - 1).withColumn("part_of_file", F.col("row") / F.count("*").over(Window.partitionBy(*by)))


def indexed(df: DataFrame, name: str = "row") -> DataFrame:
    """A global row index in the frame's own order, without a sort in one task: rows are numbered in their partition,
    after the counts of the partitions before it (a number a partition comes to the driver). Rows are staged with their
    partition, as another run of the same plan may deal them otherwise: bounds of ranges come from a sample."""
    spark = df.sparkSession
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = staged(spark, f"indexed {uuid.uuid4().hex}", lambda: df.withColumns({"_p": F.spark_partition_id(), "_m": within}))
    before, starts = 0, []
    for r in sorted(parts.groupBy("_p").count().collect(), key=lambda r: r["_p"]):
        starts.append((r["_p"], before))
        before += r["count"]
    begins = F.broadcast(spark.createDataFrame(starts, "_p int, _s long"))
    return parts.join(begins, "_p").withColumn(name, F.col("_s") + F.col("_m")).drop("_p", "_m", "_s")


def _shuffled(df: DataFrame, key: str, by: list[str], columns: list[str], seed: int) -> DataFrame:
    """Columns dealt anew among the rows of each group, by a seeded hash."""
    partner = R.shuffled_partner(df.select(key, *by), key, by, seed)
    return df.drop(*columns).join(partner.select(key, "partner"), key).join(df.select(F.col(key).alias("partner"), *columns), "partner").drop("partner")


def row_order(pairs: DataFrame, df: DataFrame, seed: int = 42) -> DataFrame:
    """Whether the place of a match in its file tells the place of its S1 record, beside a random pairing: Spearman's
    correlation of rows and of the ids' numbers, the mean gap, and the parts within 0.1 % and 1 % of a file. ``df``:
    entity_id, source, row, part_of_file."""
    side = lambda k, p: df.select(F.col("entity_id").alias(k), F.col("row").alias(f"{p}row"), F.col("part_of_file").alias(f"{p}part"), T.id_number(F.col("entity_id")).alias(f"{p}id"))
    met = pairs.join(side("s1", "a_"), "s1").join(side("q", "b_"), "q").join(df.select(F.col("entity_id").alias("q"), "source"), "q").select("s1", "q", "source", "a_row", "a_part", "a_id", "b_row", "b_part", "b_id")
    every = met.withColumn("pairing", F.lit("true pairs")).unionByName(_shuffled(met, "q", ["source"], ["b_row", "b_part", "b_id"], seed).withColumn("pairing", F.lit("random pairing")))
    gap, by = F.abs(F.col("a_part") - F.col("b_part")), ["source", "pairing"]
    stats = every.groupBy(*by).agg(F.count("*").alias("pairs"), F.round(F.avg(gap), 5).alias("mean_abs_position_gap"), F.round(R.rate(gap < 0.001), 4).alias("pct_within_0_1pct_of_file"), F.round(R.rate(gap < 0.01), 4).alias("pct_within_1pct_of_file"))
    rho = lambda a, b, name: R.spearman(every, a, b, by).select(*by, F.round("spearman", 5).alias(name))
    return stats.join(rho("a_row", "b_row", "spearman_row_position"), by, "left").join(rho("a_id", "b_id", "spearman_numeric_id"), by, "left")


def same_entity_gaps(pairs: DataFrame, df: DataFrame, seed: int = 43) -> DataFrame:
    """Whether records of one entity stand close in their file: the gaps between them, beside dealt-out rows."""
    met = pairs.join(df.select(F.col("entity_id").alias("q"), "source", "row"), "q").select("s1", "q", "source", "row")
    every = met.withColumn("pairing", F.lit("same entity")).unionByName(_shuffled(met, "q", ["source"], ["row"], seed).withColumn("pairing", F.lit("random")))
    gap = F.col("row") - F.lag("row").over(Window.partitionBy("pairing", "s1", "source").orderBy("row"))
    gaps = every.withColumn("gap", gap).filter("gap is not null")
    return gaps.groupBy("source", "pairing").agg(F.count("*").alias("consecutive_same_entity_pairs"), F.median("gap").alias("median_row_gap"), F.round(R.rate(F.col("gap") <= 1), 4).alias("pct_gap_le_1"), F.round(R.rate(F.col("gap") <= 100), 4).alias("pct_gap_le_100"))


def cross_source_order(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """The same between S2 and S3 records of one entity."""
    met = pairs.join(df.select(F.col("entity_id").alias("q"), "source", "part_of_file", T.id_number(F.col("entity_id")).alias("id")), "q")
    side = lambda s, n: met.filter(F.col("source") == s).select("s1", F.col("part_of_file").alias(f"v{n}"), F.col("id").alias(f"id{n}"))
    both = side("s2", 2).join(side("s3", 3), "s1").withColumn("comparison", F.lit("S2 vs S3 records of the same entity"))
    rows = R.spearman(both, "v2", "v3", ["comparison"]).select("comparison", F.col("n").alias("pairs"), F.round("spearman", 5).alias("spearman_row_position"))
    return rows.join(R.spearman(both, "id2", "id3", ["comparison"]).select("comparison", F.round("spearman", 5).alias("spearman_numeric_id")), "comparison")


# ---------------------------------------------------------------- regions


def region_coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Records with a region, of all and of those with an address, against the bar of their country."""
    found, bar = F.col("address_region").isNotNull(), F.lit(None).cast("double")
    for country, least in rules.REGION_BARS.items():
        bar = F.when(F.col("country_clean") == country, F.lit(least)).otherwise(bar)
    rows = df.groupBy(*by, "country_clean").agg(F.count("*").alias("records"), F.round(R.rate(found), 2).alias("pct_found"), F.round(F.avg(F.when(~F.col("address_missing"), found.cast("int"))) * 100, 2).alias("pct_found_nonmissing_address"))
    return rows.withColumn("pass_bar", bar).withColumn("passed", F.col("pct_found") >= F.col("pass_bar"))


def region_agreement(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Of true pairs where both have a region, those that agree on it, by country and source and in all."""
    both = pair_frame(pairs, df, ["country_clean", "address_region", "source"])
    held = F.col("a_address_region").isNotNull() & F.col("b_address_region").isNotNull()
    some = both.filter(held).select(F.col("a_country_clean").alias("country"), F.col("b_source").alias("match_source"), (F.col("a_address_region") == F.col("b_address_region")).alias("same"))
    rows = R.with_total(some, ["country", "match_source"], [F.count("*").alias("pairs"), F.round(R.rate(F.col("same")), 3).alias("pct_agree")])
    share = both.agg(F.round(R.rate(held), 2).alias("pct_pairs_both_found"))
    return rows.withColumns({"pass_bar": F.lit(rules.AGREEMENT_BAR), "passed": F.col("pct_agree") >= rules.AGREEMENT_BAR}).join(F.broadcast(share))  # one row


def region_disagreements(pairs: DataFrame, df: DataFrame, k: int = 15) -> DataFrame:
    both = pair_frame(pairs, df, ["country_clean", "address_region"]).filter("a_address_region <> b_address_region")
    return both.groupBy(F.col("a_country_clean").alias("country"), "a_address_region", "b_address_region").agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "country", "a_address_region", "b_address_region").limit(k)


def region_decoys(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Records of an S1 record's name that are its matches or not: how often their regions differ."""
    heads = df.filter("source = 's1'").select(F.col("entity_id").alias("s1"), F.col("name_clean").alias("k"), F.col("country_clean").alias("country"), F.col("address_region").alias("a"))
    others = df.filter("source <> 's1'").select(F.col("entity_id").alias("q"), F.col("name_clean").alias("k"), F.col("address_region").alias("b"))
    met = heads.join(others, "k").filter("a is not null and b is not null").join(pairs.select("s1", "q", F.lit(True).alias("t")), ["s1", "q"], "left")
    kind = F.when(F.col("t"), "same-name TRUE pair").otherwise("same-name DECOY")
    return met.groupBy("country", kind.alias("kind")).agg(F.count("*").alias("pairs"), F.round(R.rate(F.col("a") != F.col("b")), 2).alias("pct_region_disagree"))


def region_identity(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups of S1 records of equal name and address, with and without the region: a column more merges nothing."""
    rows = df.filter("source = 's1'").groupBy(*by, R.hashed(*(F.coalesce(c, F.lit("")) for c in ("name_clean", "address_clean"))).alias("h"), "address_region").agg(F.count("*").alias("n"))
    two = rows.groupBy(*by, "h").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("within"))
    return two.groupBy(*by).agg(F.count_if(F.col("n") > 1).alias("groups_by_name_and_address"), F.sum("within").alias("groups_with_region"), F.greatest(F.lit(0), F.sum("within") - F.count_if(F.col("n") > 1)).alias("new_merges"))


# ---------------------------------------------------------------- romanised names, legal forms


def romanisation(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """How alike the S1 name and a match in another script are, as it is and romanised: medians by script and in all,
    and what romanising adds to the median ratio."""
    both = pair_frame(pairs, df, ["name_clean", "name_latin", "name_script"]).filter(~F.col("b_name_script").isin("Latin", "None"))
    script = F.regexp_replace("b_name_script", r"^Latin\+", "")
    each = F.explode(F.array(F.struct(F.lit("raw").alias("method"), F.coalesce("b_name_clean", F.lit("")).alias("n")), F.struct(F.lit("romanised").alias("method"), F.coalesce("b_name_latin", F.lit("")).alias("n"))))
    long = both.select(script.alias("script"), F.coalesce("a_name_clean", F.lit("")).alias("a"), each.alias("m")).select("script", "a", "m.*")
    scored = long.select("script", "method", U.ratio("a", "n").alias("ratio"), U.jaro_winkler("a", "n").alias("jw"))
    stats = [F.count("*").alias("pairs"), F.round(F.median("ratio"), 1).alias("median_ratio"), F.round(F.median("jw"), 3).alias("median_jaro_winkler"), F.round(R.rate(F.col("jw") >= 0.8), 2).alias("pct_jw_ge_0_8")]
    rows = scored.groupBy("method", "script").agg(*stats).unionByName(scored.groupBy("method").agg(*stats).withColumn("script", F.lit("ALL")))
    raw = rows.filter("method = 'raw'").select("script", F.col("median_ratio").alias("_r"))
    return rows.join(raw, "script").withColumn("median_ratio_lift", F.round(F.col("median_ratio") - F.col("_r"), 1)).drop("_r")


def romanisation_examples(pairs: DataFrame, df: DataFrame, k: int = 2) -> DataFrame:
    both = pair_frame(pairs, df, ["name_clean", "name_latin", "name_script"]).filter(~F.col("b_name_script").isin("Latin", "None"))
    rows = both.withColumn("script", F.regexp_replace("b_name_script", r"^Latin\+", "")).withColumn("_md5", F.md5("q"))
    return R.first_n(rows, ["script"], [F.col("_md5"), F.col("q")], k).select("script", F.col("a_name_clean").alias("s1_name"), F.col("b_name_clean").alias("match_name"), F.col("b_name_latin").alias("romanised"))


def legal_coverage(df: DataFrame) -> DataFrame:
    """By script: records with a legal form, and with that of a partnership."""
    return df.groupBy(F.regexp_replace("name_script", r"^Latin\+", "").alias("script")).agg(
        F.count("*").alias("records"), F.round(R.rate(F.size("name_legal_forms") > 0), 2).alias("pct_has_legal_form"), F.round(R.rate(F.array_contains("name_legal_forms", "llp")), 2).alias("pct_has_llp"),
    )


def legal_gaps(df: DataFrame, k: int = 12) -> DataFrame:
    """The commonest tokens in other scripts that aren't known as legal forms, by script, romanised."""
    tokens = df.filter(~F.col("name_script").isin("Latin", "None")).select(F.regexp_replace("name_script", r"^Latin\+", "").alias("script"), F.explode(A.tokens(F.col("name_clean"))).alias("token"))
    unknown = tokens.filter(F.col("token").rlike(rules.NON_LATIN_LETTER) & ~A.is_legal(F.col("token")))
    return R.top_values(unknown, "token", ["script"], k).withColumn("romanised", U.romanise("token"))


# ---------------------------------------------------------------- comparison of stages

NAME_STEPS = (("raw", "unicode"), ("unicode", "lowercase"), ("lowercase", "norm"), ("norm", "clean"), ("clean", "fold"), ("clean", "base"), ("base", "base+fold"))
ADDRESS_STEPS = (("raw", "unicode"), ("unicode", "lowercase"), ("lowercase", "norm"), ("norm", "placeholder"), ("placeholder", "clean"), ("clean", "fold"))


def representations(df: DataFrame) -> dict[str, Column]:
    """The seventeen in which pairs are compared. Numbers are sets."""
    c = F.col
    as_set = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_sort(F.array_distinct(a)), ","))
    out = {}
    for x in ("name", "address"):
        raw = T.unicode_stage(c(f"business_{x}_raw"))
        out |= {f"{x}: raw": c(f"business_{x}_raw"), f"{x}: unicode": raw, f"{x}: lowercase": F.lower(raw), f"{x}: norm": c(f"{x}_norm"), f"{x}: clean": c(f"{x}_clean"), f"{x}: fold": folded(df, f"{x}_clean")}
    out |= {"name: base": c("name_base"), "name: base+fold": folded(df, "name_base"), "address: placeholder": A.placeholder_stage(c("address_norm"))}
    return out | {"numbers as written (set)": as_set(T.numbers(c("address_norm"))), "numbers zero-stripped (set)": as_set(c("address_numbers"))}


def _equal(pairs: DataFrame, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pairs (country, match_source) with a flag e0, e1, ... for each representation that both have and share."""
    found = representations(df)
    side = df.select("entity_id", "country_clean", "source", *(e.alias(f"r{i}") for i, e in enumerate(found.values())))
    hashes = side.select("entity_id", "country_clean", "source", *(R.hashed(F.col(f"r{i}")).alias(f"r{i}") for i in range(len(found))))  # long texts aren't shuffled
    both = pair_frame(pairs, hashes, ["country_clean", "source", *(f"r{i}" for i in range(len(found)))])
    return both.select(F.col("a_country_clean").alias("country"), F.col("b_source").alias("match_source"), *(F.coalesce(F.col(f"a_r{i}") == F.col(f"b_r{i}"), F.lit(False)).alias(f"e{i}") for i in range(len(found)))), list(found)


def agreement(pairs: DataFrame, df: DataFrame) -> DataFrame:
    flags, names = _equal(pairs, df)
    wide = flags.groupBy("country", "match_source").agg(F.count("*").alias("pairs"), *(F.round(R.rate(F.col(f"e{i}")), 3).alias(n) for i, n in enumerate(names)))
    return wide.unpivot(["country", "match_source", "pairs"], [F.col(f"`{n}`") for n in names], "representation", "pct_exactly_equal")


def gains(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """From each stage to the next: true pairs that become equal, and that stop being so."""
    flags, names = _equal(pairs, df)
    at = {n: F.col(f"e{i}") for i, n in enumerate(names)}
    steps = [(f"name: {a}", f"name: {b}") for a, b in NAME_STEPS] + [(f"address: {a}", f"address: {b}") for a, b in ADDRESS_STEPS] + [("numbers as written (set)", "numbers zero-stripped (set)")]
    each = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.count_if(at[a]).alias("equal_before"), F.count_if(at[b]).alias("equal_after"), F.count_if(~at[a] & at[b]).alias("gained"), F.count_if(at[a] & ~at[b]).alias("lost")) for a, b in steps))
    rows = flags.agg(F.count("*").alias("pairs"), each.alias("s")).select("pairs", F.explode("s").alias("s")).select("s.*", "pairs")
    return rows.withColumn("gain_pct_of_pairs", F.round(F.col("gained") * 100 / F.col("pairs"), 3)).drop("pairs")


def changes(df: DataFrame, by: list[str], stages: dict[str, list[str]]) -> DataFrame:
    """For each field and stage: nulls, mean length, and (in R.stage_effects) what changed."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(s).alias("stage"), F.col(s).alias("v")) for f, own in stages.items() for s in own))
    long = df.select(*by, F.explode(each).alias("x")).select(*by, "x.*")
    length = F.length("v")
    return long.groupBy(*by, "field", "stage").agg(F.count("*").alias("records"), F.count_if(F.col("v").isNull()).alias("missing"), F.round(F.avg(length), 3).alias("mean_length"), F.max(length).alias("max_length"))


def harmful(collisions: DataFrame, purity: DataFrame, key: str) -> DataFrame:
    """Values that a stage merged, beside how many of them join records of different entities."""
    return collisions.join(purity, key)


def symbols(df: DataFrame, by: list[str]) -> DataFrame:
    """Records with each symbol that the punctuation stage drops, and with slashed numbers in the address."""
    names = {f"name '{k}'": F.col("name_norm").rlike(p) for k, p in rules.SYMBOLS.items()}
    addresses = {f"addr '{k}'": F.col("address_norm").rlike(p) for k, p in rules.SYMBOLS.items() if k in "#/&"}
    every = names | addresses | {"addr slash-number": F.col("address_norm").rlike(u(rules.SLASH_NUMBER))}
    return df.groupBy(*by).agg(F.count("*").alias("records"), *(F.round(R.rate0(e), 3).alias(k) for k, e in every.items()))


def punctuation_merges(df: DataFrame) -> DataFrame:
    """Clean names that several normalised spellings became, and whether a symbol tells these apart."""
    groups = df.filter("name_clean is not null").groupBy("name_clean").agg(F.count_distinct("name_norm").alias("spellings"), F.count("*").alias("rows"), F.max(F.col("name_norm").rlike(r"[+@%$#]").cast("int")).alias("s"))
    return groups.filter("spellings > 1").select("name_clean", "spellings", "rows", (F.col("s") == 1).alias("by_symbol"))


def zero_strip_effect(df: DataFrame, by: list[str]) -> DataFrame:
    changed = F.array_join(T.numbers(F.col("address_norm")), ",") != F.array_join("address_numbers", ",")
    return df.groupBy(*by).agg(F.count("*").alias("records"), F.round(R.rate0(changed), 3).alias("pct_numbers_changed_by_zero_strip"))


def letterless(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col("name_script") == "None").alias("names_without_letters"), F.min(F.when(F.col("name_script") == "None", F.col("name_clean"))).alias("example"))


def transformation_cases() -> dict[str, Column]:
    c = F.col
    return {
        "mojibake repaired": c("business_address_raw").rlike(r"[âÂ]\x{80}"), "zero-width char removed": c("business_name_raw").rlike(r"\p{Cf}"), "dotted acronym joined": c("business_name_raw").rlike(u(r"\b\p{L}\.\p{L}\.")),
        "apostrophe joined": c("business_name_raw").rlike(r"\p{L}'\p{L}"), "leading junk / brackets": c("name_has_leading_junk") | c("name_has_brackets"), "repeated whitespace": c("name_has_repeated_whitespace"), "domain-only name": c("name_is_domain_only"),
        "legal form first": c("name_legal_at_start"), "Indic legal form": c("name_has_non_latin") & c("name_has_legal_form"), "placeholder segment": c("address_has_placeholder"),
        "French accents": (c("country_clean") == "France") & c("name_has_latin_diacritics") & c("address_has_latin_diacritics"),
    }


def same_frame(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    """Equal rows, in any order or in the frames' own."""
    if ordered:
        a, b = indexed(a, "_row"), indexed(b, "_row")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def any_of(flags: list[Column]) -> Column:
    return reduce(Column.__or__, flags)
