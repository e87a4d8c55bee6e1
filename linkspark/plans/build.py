"""Raw records to the processed schema, a layer of columns at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import arrays as A
from ..functions import text as T
from ..functions.unicode import fold, romanise

NAMED = (
    "entity_id split source business_name_raw business_address_raw country_raw country_clean name_missing address_missing country_missing name_norm name_clean name_tokens name_base name_legal_forms "
    "name_domain name_numbers name_script address_norm address_clean address_tokens address_segments address_numbers postal_code_candidate address_script name_n_tokens address_n_tokens address_n_segments"
).split()
NAME_FLAGS = (
    "name_is_upper name_is_lower name_has_digits name_has_non_latin name_has_latin_diacritics name_has_domain name_is_domain_only name_has_special_chars name_has_brackets name_has_leading_junk "
    "name_has_repeated_whitespace name_has_encoding_artifact name_has_legal_form name_legal_at_start name_legal_only name_clean_empty"
).split()
ADDRESS_FLAGS = (
    "address_is_upper address_has_digits address_has_non_latin address_has_latin_diacritics address_has_special_chars address_has_encoding_artifact address_has_placeholder address_placeholder_only "
    "address_has_zero_padded_number address_has_landmark address_has_care_of"
).split()
ADDED = ["address_region", "name_latin", "address_region_found"]
ORDER = [*NAMED, *NAME_FLAGS, *ADDRESS_FLAGS, *ADDED]


def _flags(n: Column, a: Column, a_norm: Column) -> dict[str, Column]:
    c = F.col
    return {
        "name_is_upper": T.is_upper(n), "name_is_lower": T.is_lower(n), "name_has_digits": n.rlike(r"(?U)\d"), "name_has_non_latin": n.rlike(rules.NON_LATIN_LETTER), "name_has_latin_diacritics": n.rlike(rules.LATIN_DIACRITIC),
        "name_has_domain": c("name_domain").isNotNull(), "name_is_domain_only": c("name_norm").rlike(T.DOMAIN_ONLY), "name_has_special_chars": n.rlike(rules.NAME_SPECIAL), "name_has_brackets": n.rlike(rules.BRACKETS),
        "name_has_leading_junk": n.rlike(r"^[^\p{L}\p{N}]"), "name_has_repeated_whitespace": n.rlike(r"(?U)\s{2,}"), "name_has_encoding_artifact": T.encoding_artifact(n), "name_has_legal_form": A.length(c("name_legal_forms")) > 0,
        "name_legal_at_start": A.is_legal(F.try_element_at("_folded", F.lit(1))), "name_legal_only": c("name_clean").isNotNull() & c("name_base").isNull(), "name_clean_empty": ~c("name_missing") & c("name_clean").isNull(),
        "address_is_upper": T.is_upper(a), "address_has_digits": a.rlike(r"(?U)\d"), "address_has_non_latin": a.rlike(rules.NON_LATIN_LETTER), "address_has_latin_diacritics": a.rlike(rules.LATIN_DIACRITIC),
        "address_has_special_chars": a.rlike(rules.NAME_SPECIAL), "address_has_encoding_artifact": T.encoding_artifact(a), "address_has_placeholder": F.exists(F.split(a_norm, ","), lambda s: A.is_placeholder(T.strip(s))),
        "address_placeholder_only": ~c("address_missing") & c("address_clean").isNull(), "address_has_zero_padded_number": a_norm.rlike(r"(?U)(?:^|\D)0\d"), "address_has_landmark": a_norm.rlike(rules.LANDMARK), "address_has_care_of": a_norm.rlike(rules.CARE_OF),
    }


def build(raw: DataFrame, split: str | Column = "train", source: str | Column = "s1") -> DataFrame:
    """58 columns from entity_id, business_name, business_address, country."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    c = F.col
    df = raw.select(
        "entity_id", as_column(split).alias("split"), as_column(source).alias("source"), c("business_name").alias("business_name_raw"), c("business_address").alias("business_address_raw"), c("country").alias("country_raw"),
    )
    n, a = c("business_name_raw"), c("business_address_raw")
    df = df.select(
        "*", T.country_clean(c("country_raw")).alias("country_clean"), T.missing(n).alias("name_missing"), T.missing(a).alias("address_missing"), T.missing(c("country_raw")).alias("country_missing"),
        T.norm(n).alias("name_norm"), T.norm(a).alias("address_norm"),
    )
    df = df.select("*", T.punctuation_stage(c("name_norm")).alias("name_clean"), A.address_segments_clean(c("address_norm")).alias("address_segments"))
    df = df.select(
        "*", A.tokens(c("name_clean")).alias("name_tokens"), A.tokens(fold(c("name_clean"))).alias("_folded"), F.when(F.size("address_segments") > 0, F.array_join("address_segments", " ")).alias("address_clean"),
        A.folded(c("address_segments"), ",").alias("_segments"),
    )
    df = df.select(
        "*", A.tokens(c("address_clean")).alias("address_tokens"), A.legal_forms(c("_folded")).alias("name_legal_forms"), A.name_base(c("name_tokens"), c("_folded")).alias("name_base"), T.domain(c("name_norm")).alias("name_domain"),
        T.numbers(c("name_norm")).alias("name_numbers"), T.numbers(A.placeholder_stage(c("address_norm")), True).alias("address_numbers"), T.postal_code(c("address_norm"), c("country_clean")).alias("postal_code_candidate"),
        T.script_label(n).alias("name_script"), T.script_label(a).alias("address_script"),
    )
    counts = {k: A.length(c(f"{k.replace('_n_', '_')}")) for k in ("name_n_tokens", "address_n_tokens", "address_n_segments")}
    latin = romanise(F.when(~c("name_script").isin("Latin", "None"), c("name_clean")))
    region = A.address_region(c("_segments"), c("country_clean"))
    df = df.select("*", *(e.alias(k) for k, e in (_flags(n, a, c("address_norm")) | counts).items()), region.alias("address_region"), latin.alias("name_latin"))
    return df.withColumn("address_region_found", c("address_region").isNotNull()).select(*ORDER)


def with_folded(df: DataFrame) -> DataFrame:
    """The columns on demand that channels read most, stored beside the others."""
    return df.withColumns({f"{c}_folded": fold(F.col(c)) for c in ("name_clean", "name_base", "address_clean")})


#: role of each column, for those who choose keys
ROLES = (
    {k: "identity" for k in NAMED[:3]} | {k: "raw" for k in NAMED[3:6]}
    | {k: "canonical" for k in ("country_clean", "name_norm", "name_clean", "name_tokens", "address_norm", "address_clean", "address_tokens", "address_segments")}
    | {k: "auxiliary" for k in ("name_base", "name_legal_forms", "name_domain", "name_numbers", "address_numbers", "postal_code_candidate", "address_region", "name_latin")}
)


def role(column: str) -> str:
    return ROLES.get(column, "descriptive")


LISTS = {"name_tokens", "name_legal_forms", "name_numbers", "address_tokens", "address_segments", "address_numbers"}
COUNTS = {"name_n_tokens", "address_n_tokens", "address_n_segments"}
TYPES = {c: "array<string>" if c in LISTS else "int" if c in COUNTS else "boolean" if c in {*NAME_FLAGS, *ADDRESS_FLAGS, "name_missing", "address_missing", "country_missing", "address_region_found"} else "string" for c in ORDER}


def conforms(df: DataFrame, types: bool = False) -> list[str]:
    """What is wrong with a processed frame's columns, in order, by name and, if wanted, by type: nothing if the list is
    empty."""
    found = [f"column {i} is {got}, not {want}" for i, (got, want) in enumerate(zip(df.columns, ORDER, strict=False)) if got != want]
    found += [f"{c} is {t}, not {TYPES[c]}" for c, t in df.dtypes if types and c in TYPES and t != TYPES[c]]
    return found + [f"{len(df.columns)} columns, not {len(ORDER)}"] * (len(df.columns) != len(ORDER))


def dictionary() -> str:
    """The columns as a Markdown table."""
    return "\n".join(["| column | type | role |", "|---|---|---|", *(f"| {c} | {TYPES[c]} | {role(c)} |" for c in ORDER)])
