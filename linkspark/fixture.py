"""Made records that hold what the test tables lack: regions, postal codes, domains, other scripts, legal forms. Some of
the processed columns are made too, so that channels and reports can be checked by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ("alpha", "bright", "cedar", "delta", "ember", "falcon", "garnet", "harbor", "indigo", "jasper")
TRADES = ("foods", "motors", "textiles", "clinic")
PLACES = {"US": ("US-TX", "US-OH", "US-CA"), "India": ("IN-MH", "IN-KA", "IN-DL")}
TELUGU = ("అల్ఫా", "బ్రైట్", "సెడార్")
SCHEMA = (
    "entity_id string, split string, source string, country_raw string, country_clean string, business_name_raw string, business_address_raw string, name_norm string, name_clean string, name_base string, name_domain string, name_script string, "
    "name_latin string, name_legal_forms array<string>, address_norm string, address_clean string, address_region string, address_segments array<string>, address_numbers array<string>, postal_code_candidate string, "
    "name_has_non_latin boolean, name_is_domain_only boolean, name_legal_at_start boolean, name_has_legal_form boolean, address_missing boolean, address_placeholder_only boolean, address_has_zero_padded_number boolean, address_has_placeholder boolean"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _record(i: int, source: int, name: str, legal: str | None, address: list[str] | None, region: str | None, country: str, **more) -> dict:
    clean = f"{name} {legal}" if legal else name
    joined = ", ".join(address) if address else None
    numbers = [n for part in address or [] for n in part.split() if n.isdigit()]
    row = {
        "entity_id": f"S{source}-{i:03d}", "split": "train" if i % 4 else "test", "source": f"s{source}", "country_raw": country.lower() if i % 2 else country, "country_clean": country, "business_name_raw": clean.title() + ("!" if i % 5 == 0 else ""),
        "business_address_raw": joined and joined.upper(), "name_norm": clean + ("!" if i % 5 == 0 else ""), "name_clean": clean, "name_base": name, "name_domain": None, "name_script": "Latin", "name_latin": None, "name_legal_forms": [legal] if legal else [],
        "address_norm": joined, "address_clean": " ".join(address) if address else None, "address_region": region if address else None, "address_segments": address or [], "address_numbers": [str(int(n)) for n in numbers],
        "postal_code_candidate": next((n for n in numbers if len(n) >= 5), None), "name_has_non_latin": False, "name_is_domain_only": False, "name_legal_at_start": False, "name_has_legal_form": legal is not None, "address_missing": address is None,
        "address_placeholder_only": False, "address_has_zero_padded_number": any(n[0] == "0" for n in numbers) if address else None, "address_has_placeholder": False if address else None,
    }
    return row | more


def made() -> tuple[list[dict], list[tuple[str, str]]]:
    """Records of three sources and the true pairs (s1, q)."""
    rows, pairs = [], []
    for i in range(36):
        country = "US" if i % 2 == 0 else "India"
        region = None if i % 9 == 8 else PLACES[country][(i // 2) % 3]
        words = [WORDS[i % 10], WORDS[(i * 3 + 1) % 10], TRADES[i % 4]]
        name, legal = " ".join(words), ("llc", None, "ltd", "llp")[i % 4]
        street = [f"{'0' * (i % 3 == 1)}{10 + i} {WORDS[(i + 2) % 10]} {('st', 'street', 'road', 'rd')[i % 4]}", f"{WORDS[(i + 5) % 10]} {'null ' if i % 11 == 3 else ''}town", str(75001 + 37 * i)]
        rows.append(_record(i, 1, name if i % 7 != 3 else f"café {name}", legal, street, region, country))
        kind = i % 3
        other = (name if i % 7 != 3 else f"cafe {name}") if kind == 0 else " ".join(reversed(words)) if kind == 1 else " ".join(words[:2])
        rows.append(_record(i, 2, other, legal if i % 2 else None, None if i % 5 == 4 else street[: 2 + i % 2], region, country))
        if i % 6 != 5:
            pairs.append((f"S1-{i:03d}", f"S2-{i:03d}"))
        if i % 4 == 1:  # in another script, romanised
            telugu = f"{TELUGU[i % 3]} {TELUGU[(i + 1) % 3]}"
            rows.append(_record(i, 3, telugu, None, street, region, country, name_script="Telugu", name_latin=f"{words[0]} {words[1][:-1]} {words[2]}", name_has_non_latin=True))
        elif i % 4 == 2:  # a domain
            joined = "".join(words[:2]) + words[2]
            rows.append(_record(i, 3, f"{joined} com", None, street[1:], region, country, name_domain=f"{joined}.com" if i % 8 == 2 else f"{joined}.co.in", name_is_domain_only=True))
        elif i % 4 == 3:
            rows.append(_record(i, 3, f"{name} {words[0]}", legal, [*street[:1], "near temple"], region, country, name_legal_at_start=i % 8 == 3))
        if i % 4:
            pairs.append((f"S1-{i:03d}", f"S3-{i:03d}"))
    for i in range(36, 44):  # the names of others, elsewhere
        j = (i - 36) * 3
        country = "US" if j % 2 == 0 else "India"
        rows.append(_record(i, 2, " ".join([WORDS[j % 10], WORDS[(j * 3 + 1) % 10], TRADES[j % 4]]), ("llc", None, "ltd", "llp")[j % 4], [f"{i} elm lane", "far town"], PLACES[country][(j // 2 + 1) % 3], country))
    return rows, sorted(pairs)


def processed(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in made()[0]], SCHEMA)
    return df.withColumns({"name_tokens": F.split("name_clean", " "), "address_tokens": F.split("address_clean", " "), "name_numbers": F.regexp_extract_all("name_norm", F.lit(r"(\d+)"))})


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(made()[1], "s1 string, q string")


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return f"CAST([{', '.join(map(_sql, value))}] AS VARCHAR[])"
    return "'" + value.replace("'", "''") + "'"


def tables() -> str:
    """The same as SQL: p (processed records), t (true pairs), i and q (index and queries)."""
    rows, pairs = made()
    values = ", ".join("(" + ", ".join(_sql(r[c]) for c in COLUMNS) + ")" for r in rows)
    return (
        f"WITH p AS (SELECT *, string_split(name_clean, ' ') AS name_tokens, string_split(address_clean, ' ') AS address_tokens, regexp_extract_all(name_norm, '\\d+') AS name_numbers FROM (VALUES {values}) v({', '.join(COLUMNS)})), "
        f"t AS (SELECT * FROM (VALUES {', '.join(map(str, pairs))}) v(s1, q)), i AS (SELECT * FROM p WHERE source = 's1'), q AS (SELECT * FROM p WHERE source <> 's1')"
    )


# What the build makes of raw records, stated by hand.
RAW = [
    ("S1-1", "O'Reilly & Sons, L.L.C.", "12 Main St, NULL, <null>, N/A, Ohio", "us"), ("S1-2", "rock'n'roll b&b abc-123", "Null Bazar, Bldg N/A, an, Maharashtra", "India"), ("S1-3", "SA", "001, 000, 10", "US"),
    ("S1-4", "école Có jp morgan & co", "nord, paris", "France"), ("S1-5", None, "  ", "Germany"), ("S1-6", "https://www.Abc-Def.co.in", "x, washington, dc", "US"), ("S1-7", "Southern பவர்", "ga", "India"), ("S1-8", "a.b.c.d.e.f.g # 4", "ga", "US"),
    ("S1-9", "Ａ B", "5 Rue X, 75001, Paris", "fr"), ("S1-10", "x", "pin code 400 001, Mumbai, Maharashtra", "India"), ("S1-11", "x", "1 Main St, 43004-1234, Ohio", "USA"), ("S1-12", "Limited Alpha", "No. â\u0080\u0093 01", "India"),
]
BUILT = "entity_id name_norm name_clean name_base name_legal_forms name_domain name_script country_clean address_region postal_code_candidate address_numbers address_segments name_missing address_missing name_legal_only name_is_domain_only name_legal_at_start address_has_placeholder address_has_zero_padded_number".split()
EXPECTED = [
    ("S1-1", "o'reilly & sons, l.l.c.", "oreilly & sons llc", "oreilly & sons", ["llc"], None, "Latin", "US", "US-OH", None, ["12"], ["12 main st", "ohio"], False, False, False, False, False, True, False),
    ("S1-2", "rock'n'roll b&b abc-123", "rocknroll b & b abc 123", "rocknroll b & b abc 123", [], None, "Latin", "India", "IN-MH", None, [], ["null bazar", "bldg n a", "an", "maharashtra"], False, False, False, False, False, False, False),
    ("S1-3", "sa", "sa", None, ["sa"], None, "Latin", "US", None, None, ["1", "0", "10"], ["001", "000", "10"], False, False, True, False, True, False, True),
    ("S1-4", "école có jp morgan & co", "école có jp morgan & co", "école jp morgan", ["co", "co"], None, "Latin", "France", None, None, [], ["nord", "paris"], False, False, False, False, False, False, False),
    ("S1-5", None, None, None, None, None, "None", "Germany", None, None, None, None, True, True, False, None, None, None, None),
    ("S1-6", "https://www.abc-def.co.in", "https www abc def co in", "https www abc def in", ["co"], "abc-def.co.in", "Latin", "US", "US-DC", None, [], ["x", "washington", "dc"], False, False, False, True, False, False, False),
    ("S1-7", "southern பவர்", "southern பவர்", "southern பவர்", [], None, "Latin+Tamil", "India", "IN-GA", None, [], ["ga"], False, False, False, False, False, False, False),
    ("S1-8", "a.b.c.d.e.f.g # 4", "abcdefg 4", "abcdefg 4", [], None, "Latin", "US", "US-GA", None, [], ["ga"], False, False, False, False, False, False, False),
    ("S1-9", "a b", "a b", "a b", [], None, "Latin", "France", "FR-IDF", "75001", ["5", "75001"], ["5 rue x", "75001", "paris"], False, False, False, False, False, False, False),
    ("S1-10", "x", "x", "x", [], None, "Latin", "India", "IN-MH", "400001", ["400", "1"], ["pin code 400 001", "mumbai", "maharashtra"], False, False, False, False, False, False, True),
    ("S1-11", "x", "x", "x", [], None, "Latin", "US", "US-OH", "43004-1234", ["1", "43004", "1234"], ["1 main st", "43004 1234", "ohio"], False, False, False, False, False, False, False),
    ("S1-12", "limited alpha", "limited alpha", "alpha", ["ltd"], None, "Latin", "India", None, None, ["1"], ["no 01"], False, False, False, False, True, False, True),
]


def built_sql() -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_sql(v) for v in r) + ')' for r in EXPECTED)}) v({', '.join(BUILT)})"
