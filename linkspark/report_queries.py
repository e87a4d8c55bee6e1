"""Queries of channels, evaluation, reports and audits over the made records of `fixture`, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixture as X
from .functions import text as T
from .functions import unicode as U
from .operators import audits as AU
from .operators import channels as CH
from .operators import evaluate as EV
from .operators import profiles as P
from .operators import reports as R
from .operators import study as ST
from .plans.build import build
from .sources.io import RAW
from .sources.staging import staged

QUERIES, SQL = {}, {}
FIX = X.tables()


def query(sql: str | None = None, fix: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (FIX + " " + sql.lstrip()) if fix and not sql.lstrip().startswith(",") else FIX + sql if fix else sql
        return f

    return add


def records(spark):
    return staged(spark, "fixture", lambda: X.processed(spark))


def sides(spark):
    df = records(spark)
    return df.filter("source = 's1'"), df.filter("source <> 's1'")


def gt(spark):
    """Truth a row an S1 record, as processed ground truth has it."""
    ids = sides(spark)[0].select(F.col("entity_id").alias("s1")).join(X.truth(spark), "s1", "left").groupBy(F.col("s1").alias("source1_entity_id")).agg(F.sort_array(F.collect_list("q")).alias("matched_entity_ids"))
    of = lambda p: F.size(F.filter("matched_entity_ids", lambda x: x.startswith(p)))
    return ids.select("*", F.size("matched_entity_ids").alias("n_matches"), of("S2-").alias("n_s2"), of("S3-").alias("n_s3"))


GT = ", gt AS (SELECT entity_id AS source1_entity_id, list(q ORDER BY q) FILTER (q IS NOT NULL) AS ids, count(q) AS n_matches, count(*) FILTER (q LIKE 'S2-%') AS n_s2, count(*) FILTER (q LIKE 'S3-%') AS n_s3 FROM i LEFT JOIN t ON s1 = entity_id GROUP BY 1)"


@query(X.built_sql(), fix=False)
def build_by_hand(spark, d):
    return build(spark.createDataFrame(X.RAW, RAW)).select(*X.BUILT)


# ---------------------------------------------------------------- channels


def _exact(index_keys: list[str], query_keys: list[str]) -> str:
    keys = lambda side, es: " UNION ".join(f"SELECT entity_id, country_clean, {e} AS k FROM {side} WHERE {e} IS NOT NULL AND {e} <> ''" for e in es)
    return f", a AS ({keys('q', query_keys)}), b AS ({keys('i', index_keys)}) SELECT DISTINCT a.entity_id AS q, b.entity_id AS s1, 1.0::DOUBLE AS score, 1 AS rank FROM a JOIN b ON a.country_clean = b.country_clean AND a.k = b.k"


_STEM = r"regexp_replace(regexp_replace(regexp_replace(name_domain, '^www\.', ''), '\.(co\.in|org\.in|net\.in|info|com|net|org|biz|in|co|us|fr|io)$', ''), '[.\-]', '', 'g')"
_COMPACT = "replace(strip_accents(name_base), ' ', '')"


@query(_exact(["name_clean"], ["name_clean"]))
def made_channel_a(spark, d):
    return CH.channel_a(*sides(spark))


@query(_exact(["strip_accents(name_base)"], ["strip_accents(name_base)"]))
def made_channel_b(spark, d):
    return CH.channel_b(*sides(spark))


@query(_exact([_COMPACT, "replace(strip_accents(name_clean), ' ', '')"], [_STEM, _COMPACT]))
def made_channel_c(spark, d):
    return CH.channel_c(*sides(spark))


def _overlap(keys: str, cap: int, k: int = 10) -> str:
    return f""", kk AS (SELECT DISTINCT entity_id, source, country_clean, key FROM (SELECT entity_id, source, country_clean, unnest({keys}) AS key FROM p) WHERE key IS NOT NULL),
df AS (SELECT country_clean, key, count(*) AS df FROM kk WHERE source = 's1' GROUP BY 1, 2 HAVING count(*) <= {cap}), n AS (SELECT country_clean, count(*) AS n FROM i GROUP BY 1),
sc AS (SELECT a.entity_id AS q, b.entity_id AS s1, round(sum(ln(n) - ln(df)), 9) AS score FROM kk a JOIN kk b ON a.source <> 's1' AND b.source = 's1' AND a.country_clean = b.country_clean AND a.key = b.key JOIN df ON df.country_clean = a.country_clean AND df.key = a.key JOIN n ON n.country_clean = a.country_clean GROUP BY 1, 2)
SELECT q, s1, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s1) AS rank FROM sc) WHERE rank <= {k}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(_overlap("string_split(strip_accents(name_clean), ' ')", 6))
def made_channel_d(spark, d):
    return _rounded(CH.channel_d(*sides(spark), cap=6))


@query(_overlap("CASE WHEN address_region IS NOT NULL THEN list_transform(address_numbers, lambda x: address_region || '|' || x) END", 3))
def made_channel_f(spark, d):
    return _rounded(CH.channel_f(*sides(spark), cap=3))


@query(_overlap("CASE WHEN address_region IS NOT NULL THEN list_transform(string_split(strip_accents(address_clean), ' '), lambda x: address_region || '|' || x) END", 4, 3))
def made_channel_g(spark, d):
    return _rounded(CH.channel_g(*sides(spark), cap=4, k=3))


def _trigram(region: bool, share: float, k: int = 5) -> str:
    near = "AND (a.target IS NULL OR a.target = b.address_region)" if region else ""
    return f""", txt AS (SELECT entity_id, source, country_clean, address_region, CASE WHEN source = 's1' THEN strip_accents(name_clean) ELSE coalesce(name_latin, strip_accents(name_clean)) END AS x FROM p),
tf AS (SELECT entity_id, source, country_clean, address_region, tri, count(*) AS tf FROM (SELECT *, unnest(list_transform(range(1, length(x) + 1), lambda j: substr(' ' || x || ' ', j, 3))) AS tri FROM txt) GROUP BY ALL),
n AS (SELECT country_clean, count(*) AS n FROM i GROUP BY 1), df AS (SELECT country_clean, tri, count(*) AS df FROM tf WHERE source = 's1' GROUP BY 1, 2),
idf AS (SELECT country_clean, tri, ln(1 + n) - ln(1 + df) + 1 AS idf FROM df JOIN n USING (country_clean) WHERE df <= greatest(1, floor(n * {share}))),
w AS (SELECT tf.*, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (country_clean, tri)), l AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS v FROM w),
tg AS (SELECT l.*, r.address_region AS target FROM l LEFT JOIN (SELECT DISTINCT country_clean, address_region FROM i WHERE address_region IS NOT NULL) r USING (country_clean, address_region)),
sc AS (SELECT a.entity_id AS q, b.entity_id AS s1, round(sum(a.v * b.v), 9) AS score FROM tg a JOIN l b ON a.source <> 's1' AND b.source = 's1' AND a.country_clean = b.country_clean AND a.tri = b.tri {near} GROUP BY 1, 2)
SELECT q, s1, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s1) AS rank FROM sc WHERE score > 0) WHERE rank <= {k}"""


@query(_trigram(False, 0.5))
def made_channel_e(spark, d):
    return _rounded(CH.channel_e(*sides(spark), share=0.5, k=5))


@query(_trigram(True, 0.5))
def made_channel_e_region(spark, d):
    return _rounded(CH.channel_e_region(*sides(spark), share=0.5, k=5))


def _runs(spark):
    return ST.channel_runs("fixture", *sides(spark), k=30, channels=("A", "B", "C"))


_A, _B, _C = (_exact(*x).split(" SELECT DISTINCT", 1) for x in ((["name_clean"], ["name_clean"]), (["strip_accents(name_base)"], ["strip_accents(name_base)"]), ([_COMPACT, "replace(strip_accents(name_clean), ' ', '')"], [_STEM, _COMPACT])))
_ABC = "".join(f"{ctes.replace('a AS (', f'a{n} AS (', 1).replace('b AS (', f'b{n} AS (', 1)}, c{n} AS (SELECT DISTINCT x.entity_id AS q, y.entity_id AS s1 FROM a{n} x JOIN b{n} y ON x.country_clean = y.country_clean AND x.k = y.k)" for n, (ctes, _) in zip("ABC", (_A, _B, _C), strict=True))
_UNION = _ABC + ", c AS (SELECT * FROM cA UNION SELECT * FROM cB UNION SELECT * FROM cC)"
_RECALL = "SELECT {by}CAST(sum(n) AS BIGINT) AS pairs, round(sum(k) * 100 / sum(n), 3) AS pair_recall, count(*) AS entities, round(avg(CASE WHEN k = n THEN 1 ELSE 0 END) * 100, 3) AS entity_recall FROM (SELECT {by}s1, count(*) AS n, count(hit) AS k FROM ({from_}) GROUP BY {by}s1) {group}"


@query(_UNION + " SELECT q, s1 FROM c")
def made_channel_union(spark, d):
    return CH.union(*sides(spark), channels={"A": 1, "B": 1, "C": 1})


@query(_UNION + " " + _RECALL.format(by="country_clean, ", from_="SELECT t.s1, t.q, i.country_clean, c.q AS hit FROM t JOIN i ON t.s1 = entity_id LEFT JOIN c ON c.s1 = t.s1 AND c.q = t.q", group="GROUP BY country_clean"))
def made_recall_by_country(spark, d):
    pairs = X.truth(spark).join(sides(spark)[0].select(F.col("entity_id").alias("s1"), "country_clean"), "s1")
    return ST.grouped_recall(pairs, ST.joined(_runs(spark), {"A": 1, "B": 1, "C": 1}), ("country_clean",))


def _config(name: str, table: str) -> str:
    recall = _RECALL.format(by="", from_=f"SELECT t.s1, t.q, x.q AS hit FROM t LEFT JOIN {table} x ON x.s1 = t.s1 AND x.q = t.q", group="")
    return f"SELECT r.*, round(avg(coalesce(n, 0)), 4) AS mean, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total, '{name}' AS config FROM ({recall}) r, (SELECT entity_id, n FROM q LEFT JOIN (SELECT q AS qq, count(*) AS n FROM {table} GROUP BY 1) ON qq = entity_id) GROUP BY ALL"


@query(_UNION + ", cBC AS (SELECT * FROM cB UNION SELECT * FROM cC) " + " UNION ALL ".join((_config("A,B,C", "c"), _config("B,C", "cBC"), _config("A", "cA"))))
def made_ablation(spark, d):
    return ST.ablation(X.truth(spark), _runs(spark), sides(spark)[1], {"A,B,C": {"A": 1, "B": 1, "C": 1}, "B,C": {"B": 1, "C": 1}, "A": {"A": 1}})


_D = _overlap("string_split(strip_accents(name_clean), ' ')", 2000, 30)


@query(_D.replace("SELECT q, s1, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM", ", d AS (SELECT q, s1, rank FROM", 1) + "), "
       + ", ".join(f"d{k} AS (SELECT q, s1 FROM d WHERE rank <= {k})" for k in (5, 10)) + " "
       + " UNION ALL ".join(f"SELECT *, 'medium' AS caps, {k} AS k FROM ({_config(f'medium k={k}', f'd{k}')})" for k in (5, 10)))
def made_curve(spark, d):
    runs = ST.channel_runs("fixture", *sides(spark), k=30, channels=("D",))
    return ST.curve(X.truth(spark), runs, sides(spark)[1], "medium", (5, 10))


@query(_UNION + ", m AS (SELECT t.s1, t.q, p.country_clean AS country, p.source FROM t JOIN p ON p.entity_id = t.q LEFT JOIN c ON c.s1 = t.s1 AND c.q = t.q WHERE c.q IS NULL) SELECT country, source, count(*) AS missed FROM m GROUP BY 1, 2")
def made_missed(spark, d):
    index, queries = sides(spark)
    counts, _ = EV.missed(EV.truth_pairs(index, queries, X.truth(spark)), ST.joined(_runs(spark), {"A": 1, "B": 1, "C": 1}))
    return counts.select("country", "source", "missed")


@query(""", s AS (SELECT t.s1, t.q, coalesce(b.name_has_non_latin, false) AS non_latin_name, coalesce(b.name_is_domain_only, false) AS domain_only, b.address_missing AS missing_address,
  list_distinct(string_split(strip_accents(a.name_clean), ' ')) AS x, list_distinct(string_split(strip_accents(b.name_clean), ' ')) AS y FROM t JOIN p a ON a.entity_id = t.s1 JOIN p b ON b.entity_id = t.q)
, f AS (SELECT *, len(list_intersect(x, y)) = 0 AS no_shared_token, list_sort(x) = list_sort(y) AS reordered FROM s)""" + _UNION.replace(" WITH", "") + """,
u AS (UNPIVOT (SELECT s1, q, non_latin_name, domain_only, no_shared_token, missing_address, reordered FROM f) ON non_latin_name, domain_only, no_shared_token, missing_address, reordered INTO NAME slice VALUE inside)
SELECT slice, count(*) AS pairs, round(avg(CASE WHEN c.q IS NULL THEN 0 ELSE 1 END) * 100, 3) AS pair_recall FROM u LEFT JOIN c ON c.s1 = u.s1 AND c.q = u.q WHERE inside GROUP BY 1""")
def made_slices(spark, d):
    index, queries = sides(spark)
    return EV.slice_recall(EV.truth_pairs(index, queries, X.truth(spark)), ST.joined(_runs(spark), {"A": 1, "B": 1, "C": 1}))


@query(_UNION + ", n AS (SELECT entity_id, count(t.q) AS n, count(c.q) AS k FROM i LEFT JOIN t ON t.s1 = entity_id LEFT JOIN c ON c.s1 = t.s1 AND c.q = t.q GROUP BY 1) SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4+' END AS true_matches, count(*) AS records, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(k) AS BIGINT) AS found FROM n GROUP BY 1")
def made_by_matches(spark, d):
    return EV.by_matches(sides(spark)[0], X.truth(spark), ST.joined(_runs(spark), {"A": 1, "B": 1, "C": 1}))


@query(_UNION + ", n AS (SELECT country_clean, entity_id, count(c.q) AS n FROM q LEFT JOIN c ON c.q = entity_id GROUP BY 1, 2) SELECT country_clean, count(*) AS queries, CAST(sum(n) AS BIGINT) AS candidates, round(avg(n), 4) AS mean, max(n) AS max, any_value(x) AS index_records FROM n JOIN (SELECT country_clean, count(*) AS x FROM i GROUP BY 1) USING (country_clean) GROUP BY 1")
def made_unlabelled_counts(spark, d):
    return ST.unlabelled_counts(*sides(spark), ST.joined(_runs(spark), {"A": 1, "B": 1, "C": 1}))


# ---------------------------------------------------------------- measurement

_BY = ["split", "source"]
_FLAGS = [c.split()[0] for c in X.SCHEMA.split(", ") if c.endswith("boolean")]
_PCT = lambda e: f"round(avg(CAST({e} AS INT)) * 100, 3)"
_PCT0 = lambda e: f"round(avg(CAST(coalesce({e}, false) AS INT)) * 100, 3)"


@query("SELECT split, source, count(*) AS records, " + ", ".join(f"{_PCT(f)} AS pct_{f}" for f in _FLAGS) + f", {_PCT('postal_code_candidate IS NOT NULL')} AS pct_postal_code_candidate, {_PCT('len(name_numbers) > 0')} AS pct_name_has_numbers, {_PCT('len(address_numbers) > 0')} AS pct_address_has_numbers, "
       + ", ".join(f"round(avg(len({x}_tokens)), 3) AS {x}_tokens_mean, median(len({x}_tokens)) AS {x}_tokens_median, round(avg(length(business_{x}_raw)), 2) AS {x}_len_raw_mean, round(avg(length({x}_clean)), 2) AS {x}_len_clean_mean" for x in ("name", "address"))
       + ", round(avg(len(address_segments)), 3) AS address_segments_mean FROM p GROUP BY 1, 2")
def source_comparison(spark, d):
    return P.source_comparison(records(spark), _BY)


_NU = {"name_raw": "business_name_raw", "name_norm": "name_norm", "name_clean": "name_clean", "name_base": "name_base", "address_raw": "business_address_raw", "address_norm": "address_norm", "address_clean": "address_clean"}


@query(", u AS (SELECT split, source, count(*) AS records, " + ", ".join(f"count(DISTINCT {c}) + " + (f"max(CAST({c} IS NULL AS INT))" if k.startswith("name") else "0") + f" AS {k}" for k, c in _NU.items())
       + " FROM p GROUP BY 1, 2) SELECT *, round((1 - name_clean / name_raw) * 100, 3) AS name_pct_unique_reduction_raw_to_clean, round((1 - name_base / name_raw) * 100, 3) AS name_pct_unique_reduction_raw_to_base, round((1 - address_clean / address_raw) * 100, 3) AS address_pct_unique_reduction_raw_to_clean FROM u")
def uniqueness_by_source(spark, d):
    return P.uniqueness(records(spark), _BY)


@query("SELECT split, source, country_raw, country_clean, count(*) AS records FROM p GROUP BY ALL")
def country_values(spark, d):
    return P.country_values(records(spark), _BY)


@query("SELECT split, source, count(*) AS records, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {k}" for k, c in {"name_null_raw": "business_name_raw", "address_null_raw": "business_address_raw", "country_null_raw": "country_raw", "name_norm_null": "name_norm", "name_clean_null": "name_clean", "name_base_null": "name_base", "address_norm_null": "address_norm", "address_clean_null": "address_clean", "country_clean_null": "country_clean"}.items())
       + ", count(*) FILTER (address_placeholder_only) AS address_placeholder_only FROM p GROUP BY 1, 2")
def missing_values(spark, d):
    return P.missing_values(records(spark), _BY)


@query("SELECT split, source, country_clean, name_script AS script, count(*) AS records, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY split, source, country_clean), 3) AS pct FROM p GROUP BY 1, 2, 3, 4")
def script_distribution(spark, d):
    return P.scripts(records(spark), [*_BY, "country_clean"], "name_script")


@query(", f AS (SELECT source, country_clean, unnest(name_legal_forms) AS form FROM p) SELECT source, country_clean, form, count(*) AS occurrences, any_value(records) AS records, round(count(*) / any_value(records) * 100, 3) AS per_100_records FROM f JOIN (SELECT source, country_clean, count(*) AS records FROM p GROUP BY 1, 2) USING (source, country_clean) GROUP BY 1, 2, 3")
def legal_form_rates(spark, d):
    return P.legal_forms(records(spark), ["source", "country_clean"])


@query(r"SELECT source, nullif(regexp_extract(name_domain, '\.([^.]+(?:\.in)?)$', 1), '') AS tld, count(*) AS records FROM p WHERE name_domain IS NOT NULL GROUP BY 1, 2")
def domain_tlds(spark, d):
    return P.domain_tlds(records(spark), ["source"])


@query("SELECT source, country_clean, count(*) AS records, count(postal_code_candidate) AS with_candidate, min(postal_code_candidate) AS example FROM p GROUP BY 1, 2")
def postal_candidates(spark, d):
    return P.postal_candidates(records(spark), ["source", "country_clean"])


@query("SELECT source, 'name' AS field, CASE WHEN name_tokens IS NOT NULL THEN least(len(name_tokens), 15) END AS n, count(*) AS records FROM p GROUP BY ALL UNION ALL SELECT source, 'address', CASE WHEN address_tokens IS NOT NULL THEN least(len(address_tokens), 40) END, count(*) FROM p GROUP BY ALL")
def token_count_distribution(spark, d):
    return P.token_counts(records(spark), ["source"])


_STATES = r"\b(?:" + "|".join(k.lower() for k in P.rules.US_CODES) + r")\b"
_NOISE = {
    "name: letter-digit mixed token": r"regexp_matches(name_clean, '\p{L}\d|\d\p{L}')", "name: non-Latin script": "name_has_non_latin", "name: whole name is a domain": "name_is_domain_only", "name: legal form first token": "name_legal_at_start",
    "name: very long token": "len(list_filter(name_tokens, lambda x: length(x) >= 18)) > 0", "name: honorific or prefix": r"regexp_matches(name_clean, '^(?:m s|shri|sri|smt|the|dr|mr|mrs|ms)\b')", "name: repeated token": "len(name_tokens) > len(list_distinct(name_tokens))",
    "name: '&' present": "contains(name_clean, '&')", "name: 'and' present": r"regexp_matches(name_clean, '\band\b')", "address: abbreviated street type": r"regexp_matches(address_clean, '\b(?:st|rd|ave|av|dr|ln|blvd|bd|r)\b')",
    "address: full street type": r"regexp_matches(address_clean, '\b(?:street|road|avenue|drive|lane|boulevard|rue)\b')", "address: non-Latin script": r"regexp_matches(address_clean, '[^\x00-\x7F]')", "address: US state code as a token": f"country_clean = 'US' AND regexp_matches(address_clean, '{_STATES}')",
    "address: zero-padded number": "address_has_zero_padded_number", "address: null token inside a segment": r"regexp_matches(address_clean, '\b(?:null|none|n a)\b')", "address: letter-digit mixed token": r"regexp_matches(address_clean, '\p{L}\d|\d\p{L}')", "address: single segment only": "len(address_segments) = 1",
}


@query(" UNION ALL ".join(f"SELECT split, source, count(*) AS records, '{k.replace(chr(39), chr(39) * 2)}' AS pattern, {_PCT0(e)} AS pct_records FROM p GROUP BY 1, 2" for k, e in _NOISE.items()))
def remaining_noise(spark, d):
    return P.remaining_noise(records(spark), _BY)


_HASH = "CAST('0x' || substr(md5(entity_id), 1, 8) AS BIGINT)"


@query(f""", c AS ({" UNION ALL ".join(f"SELECT *, '{k.replace(chr(39), chr(39) * 2)}' AS kind FROM p WHERE coalesce({e}, false)" for k, e in _NOISE.items())})
SELECT source, kind AS "case", entity_id, name_clean FROM (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY md5(entity_id), entity_id) AS r FROM c WHERE {_HASH} % 2 = 0) WHERE r <= 2""")
def noise_examples(spark, d):
    return P.examples(records(spark), P.noise_patterns(), ["source"], ["entity_id", "name_clean"], 2, 2)


@query("SELECT split, source, count(*) AS records, count(DISTINCT entity_id) AS distinct_ids, count(*) FILTER (business_address_raw IS NULL) AS address_null_raw, count(*) FILTER (address_clean IS NULL) AS address_clean_null, count(*) FILTER (name_clean IS NULL) AS name_clean_null, count(*) FILTER (business_name_raw IS DISTINCT FROM name_clean) AS names_changed FROM p GROUP BY 1, 2")
def preprocessing_summary(spark, d):
    return P.preprocessing_summary(records(spark), _BY)


_STAGES = ["business_name_raw", "name_norm", "name_clean", "name_base"]


@query(" UNION ALL ".join(f"SELECT source, '{b}' AS stage, count(*) AS rows, round(avg(CAST({a} IS DISTINCT FROM {b} AS INT)) * 100, 3) AS pct_changed, count(*) FILTER ({a} IS NOT NULL AND {b} IS NULL) AS became_null, count(DISTINCT {b}) AS distinct_values FROM p GROUP BY 1" for a, b in zip(_STAGES, _STAGES[1:], strict=False)))
def stage_effects_made(spark, d):
    return R.stage_effects(records(spark), _STAGES, ["source"])


_SORTED = lambda c: f"array_to_string(list_sort({c}), ' ')"
_KEYS = {
    "name_raw + address_raw": ("business_name_raw", "business_address_raw"), "name_norm + address_norm": ("name_norm", "address_norm"), "name_clean + address_clean": ("name_clean", "address_clean"), "folded name_clean + folded address_clean": ("strip_accents(name_clean)", "strip_accents(address_clean)"),
    "name_base + address_clean": ("name_base", "address_clean"), "sorted name_tokens + sorted address_tokens": (_SORTED("name_tokens"), _SORTED("address_tokens")), "name_raw only": ("business_name_raw",), "name_clean only": ("name_clean",), "name_base only": ("name_base",), "address_clean only": ("address_clean",),
}
_KEYED = ", k AS (" + " UNION ALL ".join(f"SELECT source, entity_id, '{n}' AS key, {' || chr(1) || '.join(es)} AS v FROM p" for n, es in _KEYS.items()) + "), g AS (SELECT source, key, v, count(*) AS n, list(DISTINCT entity_id ORDER BY entity_id) AS ids, min(entity_id) AS f FROM k WHERE v IS NOT NULL GROUP BY 1, 2, 3)"


@query(_KEYED + " SELECT source, key, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_values, count(*) FILTER (n > 1) AS repeated_values, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_repeated, max(n) AS max_group FROM g GROUP BY 1, 2")
def key_collisions_made(spark, d):
    return R.key_collisions(records(spark), ["source"])


@query(_KEYED + " SELECT source, key, n, ids[1:3] AS examples FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY n DESC, f) AS r FROM g WHERE n > 1) WHERE r <= 2")
def key_collision_examples(spark, d):
    return R.key_collision_examples(records(spark), ["source"])


# ---------------------------------------------------------------- profiling

_WORDS = {k: p for k, p in P.rules.LEGAL_FORMS.items()}
_ANY = "|".join(f"(?:{p})" for p in _WORDS.values())
_RX = lambda c, pattern: f"round(avg(CAST(regexp_matches({c}, '{pattern}') AS INT)) * 100, 2)"


@query("SELECT country_clean, count(*) AS rows, " + ", ".join(f'{_RX("name_clean", p)} AS "{k}"' for k, p in ({"ANY_legal_form": _ANY, "legal_form_at_START": rf"^(?:{_ANY})\b"} | _WORDS).items()) + " FROM p GROUP BY 1")
def legal_words(spark, d):
    return P.legal_words(records(spark), ["country_clean"], F.col("name_clean"))


_ADDR = {k: p.replace(r"\z", "$").replace("'", "''") for k, p in P.rules.ADDRESS_PATTERNS.items()}


@query("SELECT country_clean, source, count(*) AS rows, round(avg(length(regexp_replace(business_address_raw, '[^,]', '', 'g')) + 1), 2) AS mean_comma_segments, " + ", ".join(
    (f"round(avg(CAST(regexp_matches(business_address_raw, '{p}') AND NOT regexp_matches(business_address_raw, '{P.rules.STARTS_WITH_NUMBER}') AS INT)) * 100, 2)" if "later" in k else _RX("business_address_raw", p)) + f' AS "{k}"' for k, p in _ADDR.items()) + " FROM p WHERE business_address_raw IS NOT NULL GROUP BY 1, 2")
def address_structure(spark, d):
    return P.address_structure(records(spark), ["country_clean", "source"], F.col("business_address_raw"))


@query(" UNION ALL ".join(f"SELECT source, '{t}' AS term, '{form}' AS form, {_RX('address_clean', p)} AS pct FROM p WHERE address_clean IS NOT NULL GROUP BY 1" for t, both in P.rules.ADDRESS_TERMS.items() for form, p in zip(("full", "abbr"), both, strict=True)))
def address_terms(spark, d):
    return P.address_terms(records(spark), ["source"], F.col("address_clean"))


@query(", u AS (SELECT source, " + ", ".join(f"count(DISTINCT {e}) AS {k}" for k, e in {"name_raw": "coalesce(business_name_raw, '')", "name_normalised": "coalesce(name_clean, '')", "address_raw": "coalesce(business_address_raw, '')", "address_normalised": "coalesce(address_clean, '')", "both_raw": "coalesce(business_name_raw, '') || chr(1) || coalesce(business_address_raw, '')", "both_normalised": "coalesce(name_clean, '') || chr(1) || coalesce(address_clean, '')"}.items())
       + " FROM p GROUP BY 1) SELECT *, " + ", ".join(f"round((1 - {k}_normalised / {k}_raw) * 100, 3) AS {k}_pct_merged" for k in ("name", "address", "both")) + " FROM u")
def uniqueness_normalised(spark, d):
    df = records(spark).withColumnsRenamed({"business_name_raw": "business_name", "business_address_raw": "business_address"})
    return P.uniqueness_raw_and_normalised(df, ["source"], F.col("name_clean"), F.col("address_clean"))


@query(r"SELECT source, count(*) AS rows, count(DISTINCT entity_id) AS distinct_ids, count(*) FILTER (NOT regexp_matches(entity_id, '^S[123]-\d+$')) AS bad_ids, 0::BIGINT AS null_names, count(*) FILTER (business_address_raw IS NULL) AS null_addresses FROM p GROUP BY 1")
def file_overview(spark, d):
    df = records(spark).withColumnsRenamed({"business_name_raw": "business_name", "business_address_raw": "business_address"})
    return P.file_overview(df, ["source"], F.concat(F.upper("source"), F.lit("-")))


_SUMMARY = {
    "S1 entities": "count(*)", "total matched records (pairs)": "sum(n_matches)", "pairs to S2": "sum(n_s2)", "pairs to S3": "sum(n_s3)", "singletons (0 matches)": "count(*) FILTER (n_matches = 0)", "exactly 1 match": "count(*) FILTER (n_matches = 1)", ">=2 matches": "count(*) FILTER (n_matches >= 2)",
    "mean matches / S1": "round(avg(n_matches), 3)", "median matches / S1": "median(n_matches)", "max matches / S1": "max(n_matches)", "duplicate ids inside a list": "sum(coalesce(len(ids) - len(list_distinct(ids)), 0))",
}


@query(GT + " " + " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({e} AS DOUBLE) AS value FROM gt" for k, e in _SUMMARY.items()))
def truth_summary(spark, d):
    return P.truth_summary(gt(spark))


@query(GT + " SELECT CAST(n_matches AS INT) AS n_matches, count(*) AS s1_entities, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM gt GROUP BY 1")
def match_counts(spark, d):
    return P.match_counts(gt(spark))


@query(GT + " SELECT CAST(n_s2 AS INT) AS n_s2, CAST(n_s3 AS INT) AS n_s3, count(*) AS s1_entities FROM gt GROUP BY 1, 2")
def match_crosstab(spark, d):
    return P.match_crosstab(gt(spark))


@query("SELECT source, count(*) AS records, count(x) AS matched, round(count(x) / count(*) * 100, 2) AS pct_matched FROM q LEFT JOIN (SELECT DISTINCT q AS x FROM t) ON x = entity_id GROUP BY 1")
def match_coverage(spark, d):
    return P.coverage(X.truth(spark), sides(spark)[1])


@query("SELECT a.country_clean AS s1_country, b.country_clean AS m_country, count(*) AS pairs FROM t JOIN p a ON a.entity_id = s1 JOIN p b ON b.entity_id = t.q GROUP BY 1, 2")
def country_agreement(spark, d):
    return P.country_agreement(X.truth(spark), records(spark))


@query(GT + " SELECT country_clean, count(*) AS s1_entities, round(avg(CAST(n_matches = 0 AS INT)) * 100, 2) AS pct_singleton, round(avg(n_matches), 2) AS mean_matches, round(avg(n_s2), 2) AS mean_s2, round(avg(n_s3), 2) AS mean_s3 FROM gt JOIN p ON entity_id = source1_entity_id GROUP BY 1")
def singleton_rates(spark, d):
    return P.singletons(gt(spark), records(spark))


_J = lambda x, y: f"(CASE WHEN len({x}) + len({y}) = 0 THEN NULL ELSE len(list_intersect({x}, {y})) / (len(list_distinct({x})) + len(list_distinct({y})) - len(list_intersect({x}, {y}))) END)"
_ALIKE = (
    ", al AS (SELECT t.s1, t.q, b.source, a.name_clean = b.name_clean AS name_equal, a.address_clean = b.address_clean AS address_equal, list_sort(a.name_tokens) = list_sort(b.name_tokens) AS name_same_tokens, "
    + _J("a.name_tokens", "b.name_tokens") + " AS name_jaccard, " + _J("string_split(coalesce(a.address_clean, ''), ' ')", "string_split(coalesce(b.address_clean, ''), ' ')") + " AS address_jaccard, b.address_missing AS match_address_missing, "
    + "a.name_script IN ('Latin', 'None') AND b.name_script NOT IN ('Latin', 'None') AS match_non_latin FROM t JOIN p a ON a.entity_id = t.s1 JOIN p b ON b.entity_id = t.q)"
)


def _alike(spark):
    return P.similarity(X.truth(spark), records(spark))


@query(_ALIKE + " SELECT source, count(*) AS pairs, round(avg(CAST(name_equal AS INT)) * 100, 2) AS pct_name_equal, round(avg(CAST(address_equal AS INT)) * 100, 2) AS pct_address_equal, round(avg(CAST(name_same_tokens AS INT)) * 100, 2) AS pct_name_same_tokens, round(avg(name_jaccard), 4) AS name_jaccard_mean, round(avg(address_jaccard), 4) AS address_jaccard_mean FROM al GROUP BY 1")
def pair_similarity(spark, d):
    return P.similarity_profile(_alike(spark), ["source"])


_HARD = {"no shared name token": "name_jaccard = 0", "match name in non-Latin script": "match_non_latin", "same tokens, different order": "name_same_tokens AND NOT name_equal", "match address missing": "match_address_missing", "low address overlap (<0.2) despite equal name": "name_equal AND address_jaccard < 0.2"}


@query(_ALIKE + " " + " UNION ALL ".join(f"SELECT '{k}' AS \"case\", round(avg(CAST({e} AS INT)) * 100, 2) AS pct_of_pairs FROM al" for k, e in _HARD.items()))
def hard_pairs(spark, d):
    return P.hard_rates(_alike(spark))


@query(_ALIKE + " SELECT CAST(least(floor(name_jaccard * 20), 19) AS INT) AS bin, count(*) AS pairs, round(count(*) * 100 / sum(count(*)) OVER (), 3) AS pct FROM al WHERE name_jaccard IS NOT NULL GROUP BY 1")
def similarity_histogram(spark, d):
    return P.similarity_histogram(_alike(spark), "name_jaccard")


@query("SELECT entity_id, source, CAST(row_number() OVER (ORDER BY entity_id <> 'S1-007', entity_id) AS INT) AS place FROM p WHERE entity_id = 'S1-007' OR entity_id IN (SELECT q FROM t WHERE s1 = 'S1-007')")
def show_group(spark, d):
    return P.show_group("S1-007", X.truth(spark), records(spark).select("entity_id", "source"))


@query(""", m AS (SELECT a.entity_id AS s1, b.entity_id AS q FROM i a JOIN q b ON a.name_clean = b.name_clean), h AS (SELECT m.s1, count(*) AS same, count(t.q) AS tr FROM m LEFT JOIN t ON t.s1 = m.s1 AND t.q = m.q GROUP BY 1),
r AS (SELECT country_clean AS country, coalesce(n, 0) AS n, coalesce(same, 0) AS same, coalesce(tr, 0) AS tr, coalesce(same, 0) - coalesce(tr, 0) AS decoys FROM i LEFT JOIN (SELECT s1, count(*) AS n FROM t GROUP BY 1) x ON x.s1 = entity_id LEFT JOIN h ON h.s1 = entity_id)
SELECT country, n = 0 AS singleton, count(*) AS s1_entities, round(avg(CAST(same > 0 AS INT)) * 100, 2) AS pct_with_same_name_record, round(avg(CAST(decoys > 0 AS INT)) * 100, 2) AS pct_with_decoy, median(decoys) FILTER (decoys > 0) AS median_decoys_when_any,
  round(sum(tr) / nullif(sum(same), 0), 3) AS exact_name_precision, round(sum(tr) / nullif(sum(n), 0), 3) AS exact_name_recall FROM r GROUP BY 1, 2""")
def name_decoys(spark, d):
    return P.decoys(X.truth(spark), records(spark))


@query("SELECT count(DISTINCT name_clean) FILTER (split = 'train') AS left_values, count(DISTINCT name_clean) FILTER (split = 'test') AS right_values, (SELECT count(*) FROM (SELECT name_clean FROM p WHERE split = 'train' INTERSECT SELECT name_clean FROM p WHERE split = 'test')) AS shared_values FROM p")
def split_overlap(spark, d):
    return P.overlap_between(records(spark), "name_clean", "split", "train", "test")


# ---------------------------------------------------------------- audits

_POS = ", pos AS (SELECT entity_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(entity_id), entity_id) - 1 AS row, (row_number() OVER (PARTITION BY source ORDER BY md5(entity_id), entity_id) - 1) / count(*) OVER (PARTITION BY source) AS part, CAST(regexp_extract(entity_id, '([0-9]+)$', 1) AS BIGINT) AS id FROM p)"
_RANK = lambda c, by: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"


def _positions(spark):
    return AU.positions(records(spark).select("entity_id", "source").withColumn("m", F.md5("entity_id")), ["source"], ["m", "entity_id"])


@query(_POS + f""", m AS (SELECT b.source, a.row AS ar, a.part AS ap, a.id AS ai, b.row AS br, b.part AS bp, b.id AS bi FROM t JOIN pos a ON a.entity_id = s1 JOIN pos b ON b.entity_id = t.q),
r AS (SELECT *, {_RANK("ar", "source")} AS x, {_RANK("br", "source")} AS y, {_RANK("ai", "source")} AS v, {_RANK("bi", "source")} AS w FROM m)
SELECT source, 'true pairs' AS pairing, count(*) AS pairs, round(avg(abs(ap - bp)), 5) AS mean_abs_position_gap, round(avg(CAST(abs(ap - bp) < 0.001 AS INT)) * 100, 4) AS pct_within_0_1pct_of_file, round(avg(CAST(abs(ap - bp) < 0.01 AS INT)) * 100, 4) AS pct_within_1pct_of_file,
  round(round(corr(x, y), 6), 5) AS spearman_row_position, round(round(corr(v, w), 6), 5) AS spearman_numeric_id FROM r GROUP BY 1""")
def row_order(spark, d):
    return AU.row_order(X.truth(spark), _positions(spark)).filter("pairing = 'true pairs'")


@query(_POS + """, e AS (SELECT left(s1, 4) AS s1, source, row FROM t JOIN pos b ON b.entity_id = t.q), g AS (SELECT source, row - lag(row) OVER (PARTITION BY s1, source ORDER BY row) AS gap FROM e)
SELECT source, 'same entity' AS pairing, count(*) AS consecutive_same_entity_pairs, median(gap) AS median_row_gap, round(avg(CAST(gap <= 1 AS INT)) * 100, 4) AS pct_gap_le_1, round(avg(CAST(gap <= 100 AS INT)) * 100, 4) AS pct_gap_le_100 FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def same_entity_gaps(spark, d):
    """Entities by the first digit of their id's number: several records of a source each."""
    return AU.same_entity_gaps(X.truth(spark).withColumn("s1", F.substring("s1", 1, 4)), _positions(spark)).filter("pairing = 'same entity'")


@query(_POS + f""", m AS (SELECT s1, source, part, id FROM t JOIN pos b ON b.entity_id = t.q), x AS (SELECT a.part AS v2, b.part AS v3, a.id AS i2, b.id AS i3, 1 AS one FROM m a JOIN m b ON a.s1 = b.s1 AND a.source = 's2' AND b.source = 's3'),
r AS (SELECT {_RANK("v2", "one")} AS a, {_RANK("v3", "one")} AS b, {_RANK("i2", "one")} AS c, {_RANK("i3", "one")} AS d FROM x)
SELECT 'S2 vs S3 records of the same entity' AS comparison, count(*) AS pairs, round(round(corr(a, b), 6), 5) AS spearman_row_position, round(round(corr(c, d), 6), 5) AS spearman_numeric_id FROM r""")
def cross_source_order(spark, d):
    return AU.cross_source_order(X.truth(spark), _positions(spark))


@query("SELECT source, country_clean, count(*) AS records, round(avg(CAST(address_region IS NOT NULL AS INT)) * 100, 2) AS pct_found, round(avg(CAST(address_region IS NOT NULL AS INT)) FILTER (NOT address_missing) * 100, 2) AS pct_found_nonmissing_address, CASE country_clean WHEN 'US' THEN 90.0::DOUBLE WHEN 'India' THEN 85.0::DOUBLE END AS pass_bar, round(avg(CAST(address_region IS NOT NULL AS INT)) * 100, 2) >= CASE country_clean WHEN 'US' THEN 90 WHEN 'India' THEN 85 END AS passed FROM p GROUP BY 1, 2")
def region_coverage(spark, d):
    return AU.region_coverage(records(spark), ["source"])


@query(""", b AS (SELECT a.country_clean AS country, c.source AS match_source, a.address_region AS x, c.address_region AS y FROM t JOIN p a ON a.entity_id = t.s1 JOIN p c ON c.entity_id = t.q), f AS (SELECT round(avg(CAST(x IS NOT NULL AND y IS NOT NULL AS INT)) * 100, 2) AS pct_pairs_both_found FROM b)
SELECT country, match_source, count(*) AS pairs, round(avg(CAST(x = y AS INT)) * 100, 3) AS pct_agree, 97.0::DOUBLE AS pass_bar, round(avg(CAST(x = y AS INT)) * 100, 3) >= 97 AS passed, any_value(pct_pairs_both_found) AS pct_pairs_both_found FROM b, f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY GROUPING SETS ((country, match_source), ())""")
def region_agreement(spark, d):
    return AU.region_agreement(X.truth(spark), records(spark))


@query("SELECT a.country_clean AS country, CASE WHEN t.q IS NOT NULL THEN 'same-name TRUE pair' ELSE 'same-name DECOY' END AS kind, count(*) AS pairs, round(avg(CAST(a.address_region <> b.address_region AS INT)) * 100, 2) AS pct_region_disagree FROM i a JOIN q b ON a.name_clean = b.name_clean LEFT JOIN t ON t.s1 = a.entity_id AND t.q = b.entity_id WHERE a.address_region IS NOT NULL AND b.address_region IS NOT NULL GROUP BY 1, 2")
def region_decoys(spark, d):
    return AU.region_decoys(X.truth(spark), records(spark))


@query(", g AS (SELECT split, count(*) AS n, name_clean, address_clean FROM i GROUP BY ALL), h AS (SELECT split, count(*) AS n FROM i GROUP BY split, name_clean, address_clean, address_region) SELECT split, count(*) FILTER (n > 1) AS groups_by_name_and_address, any_value(w) AS groups_with_region, greatest(0, any_value(w) - count(*) FILTER (n > 1)) AS new_merges FROM g JOIN (SELECT split, count(*) FILTER (n > 1) AS w FROM h GROUP BY 1) USING (split) GROUP BY 1")
def region_identity(spark, d):
    return AU.region_identity(records(spark), ["split"])


@query(", m AS (SELECT regexp_replace(name_script, '^Latin\\+', '') AS script, * FROM p) SELECT script, count(*) AS records, round(avg(CAST(len(name_legal_forms) > 0 AS INT)) * 100, 2) AS pct_has_legal_form, round(avg(CAST(list_contains(name_legal_forms, 'llp') AS INT)) * 100, 2) AS pct_has_llp FROM m GROUP BY 1")
def legal_coverage(spark, d):
    return AU.legal_coverage(records(spark))


@query(", k AS (SELECT name_script AS script, unnest(name_tokens) AS token FROM p WHERE name_script NOT IN ('Latin', 'None')) SELECT script, token, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY script ORDER BY n DESC, token) AS r FROM (SELECT script, token, count(*) AS n FROM k WHERE regexp_matches(token, '[^\\x00-\\x7F]') GROUP BY 1, 2)) WHERE r <= 12")
def legal_gaps(spark, d):
    return AU.legal_gaps(records(spark)).drop("romanised")


@query(", b AS (SELECT s.name_clean AS a, m.name_clean AS c, m.name_latin AS l, m.name_script AS script FROM t JOIN p s ON s.entity_id = t.s1 JOIN p m ON m.entity_id = t.q WHERE m.name_script NOT IN ('Latin', 'None')), e AS (SELECT script, 'raw' AS method, a, c AS n FROM b UNION ALL SELECT script, 'romanised', a, l FROM b) SELECT method, x.script, count(*) AS pairs FROM (SELECT method, script FROM e UNION ALL SELECT method, 'ALL' FROM e) x GROUP BY 1, 2")
def romanisation(spark, d):
    """The similarities have no SQL; tests hold them against brute force."""
    return AU.romanisation(X.truth(spark), records(spark)).select("method", "script", "pairs")


# ---------------------------------------------------------------- comparison of stages

_NUMS = lambda c: f"nullif(array_to_string(list_sort(list_distinct({c})), ','), '')"
_PLACEHOLDER = r"nullif(array_to_string(list_filter(list_transform(string_split(address_norm, ','), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:<\s*null\s*>|null|n/a)$')), ', '), '')"
_REPS = {}
for _x in ("name", "address"):
    _REPS |= {f"{_x}: raw": f"business_{_x}_raw", f"{_x}: unicode": f"business_{_x}_raw", f"{_x}: lowercase": f"lower(business_{_x}_raw)", f"{_x}: norm": f"{_x}_norm", f"{_x}: clean": f"{_x}_clean", f"{_x}: fold": f"strip_accents({_x}_clean)"}
_REPS |= {"name: base": "name_base", "name: base+fold": "strip_accents(name_base)", "address: placeholder": _PLACEHOLDER, "numbers as written (set)": _NUMS(r"regexp_extract_all(address_norm, '\d+')"), "numbers zero-stripped (set)": _NUMS("address_numbers")}
_AT = {k: f"r{i}" for i, k in enumerate(_REPS)}
_EQ = ", r AS (SELECT entity_id, country_clean, source, " + ", ".join(f"{e} AS {_AT[k]}" for k, e in _REPS.items()) + " FROM p), e AS (SELECT a.country_clean AS country, b.source AS match_source, " + ", ".join(f"coalesce(a.{c} = b.{c}, false) AS {c}" for c in _AT.values()) + " FROM t JOIN r a ON a.entity_id = t.s1 JOIN r b ON b.entity_id = t.q)"


@query(_EQ + " " + " UNION ALL ".join(f"SELECT country, match_source, count(*) AS pairs, '{k}' AS representation, {_PCT(c)} AS pct_exactly_equal FROM e GROUP BY 1, 2" for k, c in _AT.items()))
def stage_agreement(spark, d):
    return AU.agreement(X.truth(spark), records(spark))


_STEPS = [(f"name: {a}", f"name: {b}") for a, b in AU.NAME_STEPS] + [(f"address: {a}", f"address: {b}") for a, b in AU.ADDRESS_STEPS] + [("numbers as written (set)", "numbers zero-stripped (set)")]


@query(_EQ + " " + " UNION ALL ".join(f"SELECT '{a}' AS \"from\", '{b}' AS \"to\", count(*) FILTER ({_AT[a]}) AS equal_before, count(*) FILTER ({_AT[b]}) AS equal_after, count(*) FILTER (NOT {_AT[a]} AND {_AT[b]}) AS gained, count(*) FILTER ({_AT[a]} AND NOT {_AT[b]}) AS lost, round(count(*) FILTER (NOT {_AT[a]} AND {_AT[b]}) * 100 / count(*), 3) AS gain_pct_of_pairs FROM e" for a, b in _STEPS))
def stage_gains(spark, d):
    return AU.gains(X.truth(spark), records(spark))


_FIELDS = {"name": ["business_name_raw", "name_norm", "name_clean", "name_base"], "address": ["business_address_raw", "address_norm", "address_clean"]}


@query(" UNION ALL ".join(f"SELECT source, '{f}' AS field, '{s}' AS stage, count(*) AS records, count(*) FILTER ({s} IS NULL) AS missing, round(avg(length({s})), 3) AS mean_length, CAST(max(length({s})) AS INT) AS max_length FROM p GROUP BY 1" for f, own in _FIELDS.items() for s in own))
def stage_lengths(spark, d):
    return AU.changes(records(spark), ["source"], _FIELDS)


_SYM = {f"name '{k}'": f"regexp_matches(name_norm, '{p}')" for k, p in P.rules.SYMBOLS.items()} | {f"addr '{k}'": f"regexp_matches(address_norm, '{p}')" for k, p in P.rules.SYMBOLS.items() if k in "#/&"} | {"addr slash-number": r"regexp_matches(address_norm, '\b\d+/\d+\b')"}


@query("SELECT source, count(*) AS records, " + ", ".join(f'{_PCT0(e)} AS "{k}"' for k, e in _SYM.items()) + " FROM p GROUP BY 1")
def symbols_dropped(spark, d):
    return AU.symbols(records(spark), ["source"])


@query("SELECT name_clean, count(DISTINCT name_norm) AS spellings, count(*) AS rows, max(CAST(regexp_matches(name_norm, '[+@%$#]') AS INT)) = 1 AS by_symbol FROM p WHERE name_clean IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name_norm) > 1")
def punctuation_merges(spark, d):
    return AU.punctuation_merges(records(spark))


@query(r"SELECT source, count(*) AS records, " + _PCT0(r"array_to_string(regexp_extract_all(address_norm, '\d+'), ',') <> array_to_string(address_numbers, ',')") + " AS pct_numbers_changed_by_zero_strip FROM p GROUP BY 1")
def zero_strip_effect(spark, d):
    return AU.zero_strip_effect(records(spark), ["source"])


@query("SELECT source, count(*) FILTER (name_script = 'None') AS names_without_letters, min(name_clean) FILTER (name_script = 'None') AS example FROM p GROUP BY 1")
def letterless_names(spark, d):
    return AU.letterless(records(spark), ["source"])


@query(", c AS (SELECT name_base, count(DISTINCT name_clean) AS distinct_before, count(*) AS rows FROM q GROUP BY 1 HAVING count(DISTINCT name_clean) > 1), g AS (SELECT name_base, count(DISTINCT t.s1) + max(CAST(t.s1 IS NULL AS INT)) > 1 AS mixed FROM q LEFT JOIN t ON t.q = entity_id GROUP BY 1 HAVING count(*) > 1) SELECT c.*, mixed FROM c JOIN g USING (name_base)")
def harmful_collisions(spark, d):
    queries = sides(spark)[1]
    known = X.truth(spark).select(F.col("q").alias("entity_id"), "s1")
    groups = queries.join(known, "entity_id", "left").groupBy("name_base").agg(F.count("*").alias("n"), (F.count_distinct("s1") + F.max(F.col("s1").isNull().cast("int")) > 1).alias("mixed")).filter("n > 1").drop("n")
    return AU.harmful(R.collisions(queries, "name_clean", "name_base"), groups, "name_base")


# ---------------------------------------------------------------- single operators


@query("SELECT entity_id, split || ' S1-' || source AS label, regexp_matches(entity_id, '^S1-\\d+$') AS s1_form FROM p")
def formatted_labels(spark, d):
    return records(spark).select("entity_id", F.format_string("%s S1-%s", "split", "source").alias("label"), P.id_form(F.col("entity_id"), "S1").alias("s1_form"))


@query("SELECT source, arg_min(name_clean, entity_id) AS first_name FROM p GROUP BY 1")
def first_of_group(spark, d):
    return records(spark).groupBy("source").agg(F.min_by("name_clean", "entity_id").alias("first_name"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents", fix=False)
def row_index(spark, d):
    """Numbered in the order of a range partitioning, which no single task sorts."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return AU.indexed(docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id"))


@query(r"""SELECT page_id, domain, regexp_replace(regexp_replace(regexp_replace(domain, '^www\.', ''), '\.(co\.in|org\.in|net\.in|info|com|net|org|biz|in|co|us|fr|io)$', ''), '[.\-]', '', 'g') AS stem, nullif(regexp_extract(domain, '\.([^.]+(?:\.in)?)$', 1), '') AS tld
FROM (SELECT page_id, nullif(regexp_extract(lower(url), '(?:https?://)?(?:www\.)?((?:[\p{L}\p{N}][\p{L}\p{N}-]*\.)+(?:co\.in|org\.in|net\.in|info|com|net|org|biz|in|co|us|fr|io))\b', 1), '') AS domain FROM pages)""", fix=False)
def text_domains(spark, d):
    found = T.domain(F.lower("url"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", found.alias("domain"), T.domain_stem(found).alias("stem"), T.top_level_domain(found).alias("tld"))


_AGREED = ["name_norm", "name_clean", "name_base", "address_norm", "address_clean", "address_region"]


@query(" UNION ALL ".join(f"SELECT count(*) AS pairs, '{c}' AS representation, round(avg(CAST(a.{c} = b.{c} AS INT)) * 100, 3) AS pct_equal FROM t JOIN p a ON a.entity_id = t.s1 JOIN p b ON b.entity_id = t.q" for c in _AGREED))
def pair_agreement(spark, d):
    index, queries = sides(spark)
    return R.agreement(X.truth(spark), index, queries, _AGREED)


@query("SELECT a.p_name AS a, b.p_name AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS jaro_winkler FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name AND a.p_name[1:4] = b.p_name[1:4]", fix=False)
def name_similarity(spark, d):
    df = spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct().withColumn("k", F.substring("p_name", 1, 4))
    both = df.withColumnRenamed("p_name", "a").join(df.withColumnRenamed("p_name", "b"), "k").filter("a < b")
    return both.select("a", "b", F.round(U.jaro_winkler("a", "b"), 6).alias("jaro_winkler"))
