"""Functions of string arrays."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import literal, literal_map, null_if_empty, punctuation_stage, strip
from .unicode import fold, fold_text


def tokens(c: Column) -> Column:
    return F.split(c, " ")


def is_placeholder(segment: Column) -> Column:
    return segment.rlike(rules.PLACEHOLDER)


def address_segments_norm(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: (x != "") & ~is_placeholder(x))


def placeholder_stage(c: Column) -> Column:
    return null_if_empty(F.array_join(address_segments_norm(c), ", "))


def address_segments_clean(c: Column) -> Column:
    return F.filter(F.transform(address_segments_norm(c), punctuation_stage), lambda x: x.isNotNull())


def folded(array: Column, separator: str) -> Column:
    """An array's elements folded at once: a Python UDF can't stand in a lambda. No element holds the separator."""
    return F.when(F.size(array) > 0, F.split(fold(F.array_join(array, separator)), separator)).otherwise(array)


def is_legal(folded_token: Column) -> Column:
    return F.array_contains(F.expr(f"array({','.join(map(literal, rules.LEGAL))})"), folded_token)


def legal_forms(folded_tokens: Column) -> Column:
    return F.transform(F.filter(folded_tokens, is_legal), lambda t: F.element_at(literal_map(rules.LEGAL), t))


def name_base(token_array: Column, folded_tokens: Column) -> Column:
    both = F.filter(F.arrays_zip(token_array.alias("t"), folded_tokens.alias("f")), lambda x: ~is_legal(x["f"]))
    return null_if_empty(F.btrim(F.array_join(F.transform(both, lambda x: x["t"]), " "), F.lit(" &")))


def canonical(text: str) -> str | None:
    """What norm, punctuation and folding make of a gazetteer's key: the same stages in plain Python."""
    import re
    import unicodedata

    text = unicodedata.normalize("NFKC", text).lower()
    for quote in rules.SINGLE_QUOTES:
        text = text.replace(quote, "'")
    for dash in rules.DASHES:
        text = text.replace(dash, "-")
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    for _ in range(2):
        text = re.sub(r"([^\W\d_])'([^\W\d_])", r"\1\2", text)
    text = re.sub(r"\b([^\W\d_])\.([^\W\d_])\b\.?", r"\1\2", text)
    kept = "".join(c if unicodedata.category(c)[0] in "LMN" or c in "& " else " " for c in text.replace("&", " & "))
    return fold_text(" ".join(kept.split())) or None


@lru_cache(maxsize=1)
def region_maps() -> dict[str, dict[str, dict[str, str]]]:
    return {country: {kind: {canonical(k): v for k, v in keys.items()} for kind, keys in kinds.items()} for country, kinds in rules.GAZETTEER.items()}


def _regions(folded_segments: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return F.array().cast("array<string>")
    lookup = literal_map(mapping)
    return F.array_sort(F.array_distinct(F.filter(F.transform(folded_segments, lambda s: F.try_element_at(lookup, s)), lambda r: r.isNotNull())))


def region_matches(folded_segments: Column, country: Column, kind: str | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("array<string>"))
    for name, maps in region_maps().items():
        out = out.when(country == name, _regions(folded_segments, maps[kind] if kind else maps["code"] | maps["name"]))
    return F.when(folded_segments.isNotNull(), out)


def address_region(folded_segments: Column, country: Column) -> Column:
    """The one region named, or the one that the country's deciding kind of key names, or null."""
    both = region_matches(folded_segments, country)
    out = F.when(F.size(both) == 1, F.element_at(both, 1))
    for name, kind in rules.PRECEDENCE.items():
        if kind:
            one = _regions(folded_segments, region_maps()[name][kind])
            out = out.when((country == name) & (F.size(one) == 1), F.element_at(one, 1))
    return out


def length(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def sorted_key(a: Column) -> Column:
    return F.array_join(F.array_sort(a), " ")


def same_set(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def repeats(a: Column) -> Column:
    return F.size(a) > F.size(F.array_distinct(a))


def trigrams(c: Column) -> Column:
    """All windows of three characters of the text between two spaces."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.when(F.length(padded) >= 3, F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
