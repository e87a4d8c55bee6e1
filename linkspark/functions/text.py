"""Text stages, Column to Column. Patterns that use \\s, \\d or \\b are Unicode-aware by (?U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .unicode import fold, nfkc

_WHITE = r"(?U)\s+"


def null_if_empty(c: Column) -> Column:
    """nullif, but ``c`` stands in it once: nullif repeats its argument, and nested stages would double each time."""
    return F.try_element_at(F.filter(F.array(c), lambda x: x != ""), F.lit(1))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(mapping: dict[str, str]) -> Column:
    """A map as one expression: building it entry by entry costs the driver seconds."""
    return F.expr("map(" + ",".join(f"{literal(k)},{literal(v)}" for k, v in mapping.items()) + ")")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def unicode_stage(c: Column) -> Column:
    """Mojibake repaired, NFKC, format characters dropped, control characters to spaces, quotes and dashes unified."""
    for pattern, to in rules.MOJIBAKE:
        c = F.regexp_replace(c, pattern, to)
    c = F.regexp_replace(F.regexp_replace(nfkc(c), r"\p{Cf}", ""), r"\p{Cc}", " ")
    kinds = ((rules.SINGLE_QUOTES, "'"), (rules.DOUBLE_QUOTES, '"'), (rules.DASHES, "-"))
    return F.translate(c, "".join(k for k, _ in kinds), "".join(to * len(k) for k, to in kinds))


def whitespace_stage(c: Column) -> Column:
    return null_if_empty(F.trim(F.regexp_replace(c, _WHITE, " ")))


def norm(c: Column) -> Column:
    return whitespace_stage(F.lower(unicode_stage(c)))


def punctuation_stage(c: Column) -> Column:
    """In-word apostrophes dropped, dotted acronyms joined, & a token of its own, other punctuation to spaces."""
    c = F.regexp_replace(F.regexp_replace(c, *rules.IN_WORD_APOSTROPHE), *rules.IN_WORD_APOSTROPHE)  # twice: matches overlap
    for letters in range(rules.LONGEST_ACRONYM, 1, -1):
        dotted, joined = r"\.".join([r"(\p{L})"] * letters), "".join(f"${i}" for i in range(1, letters + 1))
        c = F.regexp_replace(c, rf"(?U)\b{dotted}\b\.?", joined)
    return whitespace_stage(F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" & ")), rules.NOT_KEPT, " "))


def simple_norm(c: Column) -> Column:
    """The profiling normaliser: NFKC, lower case, quotes dropped, punctuation to spaces, trimmed; '' stays ''."""
    c = F.regexp_replace(F.lower(nfkc(c)), rules.SIMPLE_QUOTES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, rules.NOT_KEPT, " "), _WHITE, " "))


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


_TLD = "|".join(t.replace(".", r"\.") for t in sorted(rules.TLDS, key=len, reverse=True))
_NAME = rf"{rules.DOMAIN_LABELS}(?:{_TLD})"
DOMAIN = rf"(?U){rules.DOMAIN_PREFIX}({_NAME})\b"
DOMAIN_ONLY = rf"(?U)^{rules.DOMAIN_PREFIX}{_NAME}/?\z"


def domain(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, DOMAIN, 1))


def domain_stem(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"^www\.", ""), rf"\.(?:{_TLD})\z", "")
    return F.regexp_replace(c, r"[.\-]", "")


def numbers(c: Column, strip_zeros: bool = False) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?U)(\d+)"))
    if not strip_zeros:
        return found
    return F.transform(found, lambda x: F.when(F.ltrim(x, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(x, F.lit("0"))))


def postal_code(c: Column, country: Column) -> Column:
    found = reduce(lambda e, kv: e.when(country == kv[0], null_if_empty(F.regexp_extract(c, kv[1], 1))), rules.POSTAL.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return compact(found)


def script_label(c: Column) -> Column:
    """The scripts of a text's letters: Latin, the first other one by precedence, or both; None without letters."""
    kinds = [*((rf"\p{{Is{s}}}", s) for s in rules.SCRIPTS), (rules.NON_LATIN_LETTER, "Other")]
    other = F.coalesce(*(F.when(c.rlike(pattern), F.lit(name)) for pattern, name in kinds))
    found = F.concat_ws("+", F.when(c.rlike(r"\p{IsLatin}"), F.lit("Latin")), other)
    return F.when(found == "", "None").otherwise(found)


def is_upper(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & (c == F.upper(c))


def is_lower(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & (c == F.lower(c))


def encoding_artifact(c: Column) -> Column:
    return c.rlike(rules.ARTIFACT)


def country_clean(c: Column) -> Column:
    key = F.regexp_replace(strip(c), _WHITE, " ")
    return F.coalesce(F.try_element_at(literal_map(rules.COUNTRIES), F.lower(key)), key)


def n_chars(c: Column) -> Column:
    return F.length(c)


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def missing(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) == 0


def text_flags(c: Column) -> dict[str, Column]:
    latin = c.rlike("[A-Za-z]")
    return {
        "has_digit": c.rlike(r"(?U)\d"),
        "has_punct": c.rlike(r"(?U)[^\p{L}\p{M}\p{N}\s]"),
        "has_ampersand": c.contains("&"),
        "url_or_domain": c.rlike(r"(?iuU)https?://|www\.|\.(com|net|org|biz|info|in|co|fr|us)\b"),
        "non_ascii": c.rlike(r"[^\x00-\x7F]"),
        "latin_diacritics": c.rlike(rules.LATIN_DIACRITIC),
        "non_latin_script": c.rlike(rules.NON_LATIN_LETTER),
        "all_upper": latin & (c == F.upper(c)),
        "all_lower": latin & (c == F.lower(c)),
        "repeated_space": c.rlike(r"(?U)\s{2,}"),
        "lead_trail_space": c.rlike(r"(?U)^\s|\s\z"),
        "odd_symbols": c.rlike(r"[#@*_|~^<>{}\[\]\\]"),
        "replacement_char": c.contains("�"),
    }


def top_level_domain(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, r"\.([^.]+(?:\.in)?)\z", 1))


def id_number(c: Column) -> Column:
    return F.try_to_number(F.regexp_extract(c, r"(\d+)\z", 1), F.lit("9" * 18)).cast("long")


__all__ = [n for n in dir() if n[0] != "_"] + ["fold"]
