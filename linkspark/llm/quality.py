"""Host-level quality rules (op1).

Each document is tested by four rules (too few words, too many of them in repeated five-word windows, too many symbols,
too many repeated lines), the first two of which it must pass by itself. The failures of every rule are counted by
host, and each host's rate is shrunk towards the rate of all documents by a beta prior: its mean is that rate, its
strength m(1-m)/v - 1 with the variance v between hosts, which is what the spread of the hosts' rates has beyond the
binomial spread of as many documents (none: the hosts are taken as alike, by the greatest strength). From the beta
posterior, in the normal approximation, a host gets two verdicts for each rule:

- rejected, if its rate is above ``REJECT_RATE`` with a chance of 0.99: all its documents go;
- watched, if its rate is above the mean of all with a chance of 0.999 and 1.5 times that mean or more: its documents
  are held to twice as strict a limit of that rule.

Hosts whose rates differ by chance alone are neither. Verdicts are joined back to the documents.

Defined results: a null or empty text has no words and fails. Documents without a host form one host. Repeated rows
count each time. An empty table gives an empty result. Columns of any other name are left alone by
``filter_documents``, whatever they are called, and don't appear in ``score_documents``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from .common import _SPACE, cut, fresh, mix, per_text, pieces, read, repeated, salted_join, span_hashes, table, trim, utf8, words

MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
MAX_SYMBOLS = 10  # per cent of the words
MAX_LINES = 5  # repeated lines, per cent of the words
WINDOW = 5
REJECT_RATE = 0.5
#: Standard normal quantiles of 0.99 and 0.999, and how much a watched host's rate is above the mean.
REJECT_Z, WATCH_Z, WATCH_RATIO = 2.326, 3.09, 1.5
#: The least and the greatest strength of a prior, in documents.
STRENGTHS = (1.0, 1e6)
#: So many hosts at most are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 100_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text: over whole texts, by vector operations on their bytes."""
    data, at = utf8(texts)
    n = len(at) - 1
    start, end, text = words(data, at)
    out = {
        "n_words": np.bincount(text, minlength=n).astype(np.int64),
        "word_chars": per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": per_text(_SYMBOL[data], at),
    }
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))

    feeds = np.flatnonzero(data == 10)
    line = np.unique(np.concatenate([at[:-1], feeds + 1]))
    line = line[line < len(data)]
    stop = np.minimum(np.append(line[1:], len(data)), len(data))
    owner = np.searchsorted(at, line, "right") - 1
    ends_fed = data[stop - 1] == 10 if len(line) else np.zeros(0, bool)
    worded = np.searchsorted(start, stop) > np.searchsorted(start, line)  # a word has no line feed
    keys = span_hashes(data, line, stop - ends_fed) + salt[owner]
    _, later = repeated(keys[worded])
    out["n_dup_lines"] = np.bincount(owner[worded][later], minlength=n).astype(np.int64)

    hashes = span_hashes(data, start, end)
    count = len(start) - WINDOW + 1
    covered = np.zeros(len(start) + 1, np.int64)
    if count > 0:
        window = salt[text[:count]].copy()
        for k in range(WINDOW):
            window = mix(window * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count])
        whole = np.flatnonzero(text[:count] == text[WINDOW - 1 :])
        twice, _ = repeated(window[whole])
        np.add.at(covered, whole[twice], 1)
        np.subtract.at(covered, whole[twice] + WINDOW, 1)
    out["n_repeat_words"] = np.bincount(text[np.cumsum(covered[:-1]) > 0], minlength=n).astype(np.int64)
    return out



@arrow_udf(StructType([StructField(c, LongType()) for c in _COUNTS]))
def counts(texts: pa.Array) -> pa.Array:
    found = [measure(part.column(0)) for part in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
    trim()
    return pa.StructArray.from_arrays([pa.array(np.concatenate([x[c] for x in found]) if found else [], pa.int64()) for c in _COUNTS], list(_COUNTS))


def failures(c: dict[str, Column], strict: int = 1) -> dict[str, Column]:
    """Whether a document with the counts ``c`` fails each rule, or its limit made ``strict`` times as strict."""
    return {
        "few_words": c["n_words"] < MIN_WORDS * strict,
        "repeated_words": 100 * strict * c["n_repeat_words"] > MAX_REPEATED * c["n_words"],
        "symbols": 100 * strict * c["n_symbols"] > MAX_SYMBOLS * c["n_words"],
        "repeated_lines": 100 * strict * c["n_dup_lines"] > MAX_LINES * c["n_words"],
    }


RULES = ("few_words", "repeated_words", "symbols", "repeated_lines")


def _base_failed(c: dict[str, Column]) -> Column:
    found = failures(c)
    return found["few_words"] | found["repeated_words"]


def host_verdicts(rows: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """From rows (host, and a boolean for each rule): host, host_rate (the greatest of its shrunk rates), rejected and
    watched (the rules by which it is). The driver gets the prior alone, two numbers a rule."""
    hosts = cut(rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES)))
    n = F.col("n").cast("double")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"), *(F.sum(r).alias(r) for r in RULES)).first()
    if not total["n"]:
        return hosts.select("host", F.lit(0.0).alias("host_rate"), *(F.array().cast("array<string>").alias(x) for x in ("rejected", "watched")))
    mean = {r: total[r] / total["n"] for r in RULES}
    spread = hosts.agg(*(F.sum(n * (F.col(r) / n - mean[r]) * (F.col(r) / n - mean[r])).alias(r) for r in RULES)).first()
    rates, rejected, watched = [], [], []
    for r in RULES:
        m, free = mean[r], total["n"] - total["nn"] / total["n"]
        v = (spread[r] - (total["hosts"] - 1) * m * (1 - m)) / free if free > 0 else 0.0
        strength = min(STRENGTHS[1], max(STRENGTHS[0], m * (1 - m) / v - 1)) if v > 0 else STRENGTHS[1]
        shrunk = (F.col(r) + m * strength) / (n + strength)
        deviation = F.sqrt(shrunk * (1 - shrunk) / (n + strength + 1))
        rates.append(shrunk)
        rejected.append(F.when(shrunk - REJECT_Z * deviation > reject_rate, F.lit(r)))
        watched.append(F.when((shrunk - WATCH_Z * deviation > m) & (shrunk >= WATCH_RATIO * m), F.lit(r)))
    return hosts.select("host", F.greatest(*rates).alias("host_rate"), F.array_compact(F.array(*rejected)).alias("rejected"), F.array_compact(F.array(*watched)).alias("watched"))


def _kept(c: dict[str, Column], rejected: Column, watched: Column) -> Column:
    strict = failures(c, 2)
    fails = reduce(Column.__or__, (F.coalesce(F.array_contains(watched, r), F.lit(False)) & strict[r] for r in RULES))
    return ~_base_failed(c) & (F.coalesce(F.size(rejected), F.lit(0)) == 0) & ~fails


def _with_verdicts(rows: DataFrame, verdicts: DataFrame, salt_by: list[str]) -> DataFrame:
    """``rows`` with the verdicts of their ``host``: broadcast if the hosts are few, which is counted, else salted."""
    verdicts = cut(verdicts)
    if verdicts.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(verdicts), "host", "left")
    return salted_join(rows, verdicts, ["host"], "left", salt_by)


def _host(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def score_documents(docs: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the host's greatest shrunk rate, and the rules by which it is rejected or
    watched."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(F.col("source")).alias("host"), counts("text").alias("c")).select("doc_id", "host", "c.*")
    rows = cut(rows)
    c = {k: F.col(k) for k in _COUNTS}
    verdicts = host_verdicts(rows.select("host", *(e.alias(r) for r, e in failures(c).items())), reject_rate)
    joined = _with_verdicts(rows, verdicts, ["doc_id", "n_words", "word_chars"])
    lists = (F.array_join(x, ",").alias(f"host_{x}") for x in ("rejected", "watched"))
    return joined.select("doc_id", *_COUNTS, _base_failed(c).alias("base_failed"), _kept(c, F.col("rejected"), F.col("watched")).alias("kept"), F.round("host_rate", 6).alias("host_rate"), *lists)


def filter_documents(docs: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """The documents that ``score_documents`` keeps, with their own columns. The counts are written beside the texts
    once; texts are neither measured twice nor shuffled, as few hosts have a verdict (more are joined by shuffle)."""
    (held,) = fresh(docs, "_counts")
    measured = table(docs.withColumn(held, counts("text")))
    c = {k: F.col(held)[k] for k in _COUNTS}
    verdicts = host_verdicts(measured.select(_host(F.col("source")).alias("host"), *(e.alias(r) for r, e in failures(c).items())), reject_rate)
    found = cut(verdicts.filter((F.size("rejected") > 0) | (F.size("watched") > 0)).select("host", "rejected", "watched"))
    many, passed = found.count(), measured.filter(~_base_failed(c))
    if not many:
        return passed.drop(held)
    host, rejected, watched = fresh(measured, "_host", "_rejected", "_watched")
    found = found.select(F.col("host").alias(host), F.col("rejected").alias(rejected), F.col("watched").alias(watched))
    passed = passed.withColumn(host, _host(F.col("source")))
    if many <= BROADCAST_HOSTS:
        joined = passed.join(F.broadcast(found), host, "left")
    else:
        joined = salted_join(passed, found, [host], "left", [held + ".n_words", held + ".word_chars"])
    return joined.filter(_kept(c, F.col(rejected), F.col(watched))).drop(host, rejected, watched, held)


def op1_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
dup AS (SELECT r, sum(n - 1) AS n_dup_lines FROM lines GROUP BY r),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
base AS (
  SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
failed AS (SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeated_words, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 5 * n_words AS repeated_lines FROM base),
long AS (SELECT host, rule, fails FROM (UNPIVOT failed ON few_words, repeated_words, symbols, repeated_lines INTO NAME rule VALUE fails)),
hosts AS (SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, sum(CAST(fails AS INT)) AS f FROM long GROUP BY host, rule),
means AS (SELECT rule, sum(f) / sum(n) AS m, count(*) AS h, sum(n) AS total, sum(n * n) AS nn FROM hosts GROUP BY rule),
priors AS (SELECT rule, m, CASE WHEN total - nn / total > 0 THEN (s - (h - 1) * m * (1 - m)) / (total - nn / total) ELSE 0 END AS v
  FROM means JOIN (SELECT rule, sum(n * (f / n - m) * (f / n - m)) AS s FROM hosts JOIN means USING (rule) GROUP BY rule) USING (rule)),
strengths AS (SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM priors),
shrunk AS (SELECT host, rule, m, (f + m * s) / (n + s) AS p, n + s + 1 AS d FROM hosts JOIN strengths USING (rule)),
marks AS (SELECT host, rule, p, p - 2.326 * sqrt(p * (1 - p) / d) > 0.5 AS rejected, p - 3.09 * sqrt(p * (1 - p) / d) > m AND p >= 1.5 * m AS watched FROM shrunk),
place AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 3), ('repeated_lines', 4)) t(rule, i)),
verdicts AS (SELECT host, max(p) AS host_rate, coalesce(string_agg(rule, ',' ORDER BY i) FILTER (rejected), '') AS host_rejected, coalesce(string_agg(rule, ',' ORDER BY i) FILTER (watched), '') AS host_watched FROM marks JOIN place USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeated_words AS base_failed,
  NOT few_words AND NOT repeated_words AND host_rejected = '' AND NOT (contains(host_watched, 'few_words') AND n_words < 20) AND NOT (contains(host_watched, 'repeated_words') AND 200 * n_repeat_words > 20 * n_words)
  AND NOT (contains(host_watched, 'symbols') AND 200 * n_symbols > 10 * n_words) AND NOT (contains(host_watched, 'repeated_lines') AND 200 * n_dup_lines > 5 * n_words) AS kept,
  round(host_rate, 6) AS host_rate, host_rejected, host_watched
FROM failed JOIN verdicts USING (host)
"""
