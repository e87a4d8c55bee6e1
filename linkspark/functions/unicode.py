"""What Spark has no built-in for: Unicode normal forms, romanisation, string similarities. Arrow batches, never rows."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType

_NON_ASCII = r"[^\x00-\x7F]"


def only_non_ascii(udf, c: Column) -> Column:
    """A UDF that leaves ASCII text alone sees the other rows only."""
    return F.coalesce(udf(F.when(c.rlike(_NON_ASCII), c)), c)


@arrow_udf(StringType())
def _nfkc(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in x.to_pylist()], pa.string())


def fold_text(text: str) -> str:
    """Marks after Latin letters go; those of other scripts stay."""
    out, latin = [], False
    for c in unicodedata.normalize("NFD", text):
        if unicodedata.category(c)[0] == "M":
            if latin:
                continue
        else:
            latin = unicodedata.name(c, "").startswith(("LATIN ", "FULLWIDTH LATIN")) or c in "ªº"
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


@arrow_udf(StringType())
def _fold(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fold_text(t) for t in x.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    return only_non_ascii(_nfkc, c)


def fold(c: Column) -> Column:
    return only_non_ascii(_fold, c)


@lru_cache(maxsize=100_000)
def _letter(c: str) -> tuple[str, str]:
    """Latin letters for a character, by its Unicode name, and its kind: letter, vowel sign, virama or other."""
    name = unicodedata.name(c, "")
    if m := re.fullmatch(r"[A-Z]+ LETTER (?:VOCALIC |ARCHAIC )?([A-Z]+)", name):
        return m[1].lower(), "letter"
    if m := re.fullmatch(r"[A-Z]+ VOWEL SIGN (?:VOCALIC |CANDRA |SHORT )?([A-Z]+)", name):
        return m[1].lower(), "vowel"
    if name.endswith(("SIGN VIRAMA", "SIGN PULLI")):
        return "", "virama"
    if name.endswith(("SIGN ANUSVARA", "SIGN BINDI", "SIGN CANDRABINDU", "TIPPI")):
        return "n", "sign"
    if name.endswith("SIGN VISARGA"):
        return "h", "sign"
    if m := re.fullmatch(r"[A-Z]+ DIGIT ([A-Z]+)", name):
        return str(unicodedata.digit(c, 0)), "other"
    if m := re.fullmatch(r"MALAYALAM LETTER CHILLU ([A-Z]+)", name):
        return m[1].lower(), "virama"
    return "", "sign" if unicodedata.category(c)[0] == "M" else "other"


def romanise_text(text: str) -> str | None:
    """Latin letters, digits, spaces and & alone. Indic consonants lose their inherent a before a sign or virama."""
    out: list[str] = []
    inherent = False
    for c in text:
        if ord(c) < 128:
            # a word's last inherent vowel isn't spoken
            if inherent and out and out[-1].endswith("a") and len(out[-1]) > 1:
                out[-1] = out[-1][:-1]
            out.append(c)
            inherent = False
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if plain.isascii() and plain:
            out.append(plain)
            inherent = False
            continue
        letters, kind = _letter(c)
        if kind in ("vowel", "virama") and inherent and out and out[-1].endswith("a"):
            out[-1] = out[-1][:-1]
        out.append(letters)
        inherent = kind == "letter" and len(letters) > 1 and letters.endswith("a") and letters[0] not in "aeiou"
    if inherent and len(out[-1]) > 1:
        out[-1] = out[-1][:-1]
    found = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 &]", "", "".join(out).lower())).strip()
    return found or None


@arrow_udf(StringType())
def romanise(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else romanise_text(t) for t in x.to_pylist()], pa.string())


def ratio_text(a: str, b: str) -> float:
    """200 x longest common subsequence over both lengths, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def jaro_winkler_text(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _pairwise(f):
    @arrow_udf(DoubleType())
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return udf


ratio, jaro_winkler = _pairwise(ratio_text), _pairwise(jaro_winkler_text)
