"""URL filters over dated lists (op5), by DataFrame operations alone.

A list has entries (value, action, at): from ``at`` on, `add` puts a value on the list and `remove` takes it off. An
entry's state holds up to the next of its value, so that the adds become validity intervals, disjoint for a value. A
value is a host, which also covers its subdomains, or a host and a path that ends in a slash, which covers the URLs
under it. A capture has one key for each such value that would cover it; the as-of join finds, for every key, the
entry in force when the capture was fetched.

Of the list, the values that are a key of some capture count alone. They are found from the captures' distinct keys,
so that a bare top-level domain, which is a key of most captures, is a row a task there; then they are counted, and
broadcast if they are few, which leaves the captures where they are. Else the keys are joined by shuffle, the list
repeated for a number of salts, so that a host with a third of all captures is dealt to many tasks. What was matched
comes back to the captures in the same two ways.

Defined results: a null or hostless URL, and a null fetch time, match nothing and aren't blocked. Of entries of one
value and time, `remove` holds; null values, times and actions are no entries. Repeated captures are one row each. An
empty list blocks nothing; empty captures give an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, salted_join

#: So many rows (a value's intervals, a URL's match) at most are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: A value with more intervals than this isn't broadcast either.
BROADCAST_SPANS = 1000


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """The values that cover a URL: its host and the domains above it, and its host with each beginning of its path."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path(url), "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host(url), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    paths = F.when(F.size(parts) > 1, paths).otherwise(F.array().cast("array<string>"))
    return F.when(url.isNotNull() & (host(url) != ""), F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """value, valid_from, valid_to (null: still on the list)."""
    order = Window.partitionBy("value").orderBy("at")
    states = entries.filter("value is not null and at is not null and action is not null").groupBy("value", "at").agg(F.max("action").alias("action"))  # 'remove' is the greater
    return states.withColumn("valid_to", F.lead("at").over(order)).filter("action = 'add'").select("value", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, n_active, matched (the longest active value, the least of equally long), blocked."""
    rows = captures.select("page_id", "url", "fetched")
    whole = F.col("url").isNotNull() & F.col("fetched").isNotNull()
    keyed = rows.filter(whole).select("url", "fetched", F.explode(keys(F.col("url"))).alias("value"))
    listed = cut(_listed(entries).join(keyed.select("value").distinct(), "value", "left_semi"))
    n, most = listed.agg(F.count("*"), F.coalesce(F.max(F.size("_spans")), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and most <= BROADCAST_SPANS
    found = keyed.join(F.broadcast(listed), "value") if small else salted_join(keyed, listed, ["value"], "inner", ["url", "fetched"])
    # exploded and not tested by a lambda over _spans, for which Spark on a cluster couldn't find `fetched`
    spans = found.select("url", "fetched", "value", F.explode("_spans").alias("_span"))
    active = (F.col("_span.valid_from") <= F.col("fetched")) & (F.col("_span.valid_to").isNull() | (F.col("fetched") < F.col("_span.valid_to")))
    hits = spans.filter(active).select("url", "fetched", "value").distinct()
    best = F.min(F.struct((-F.length("value")).alias("l"), F.col("value").alias("v")))
    matches = cut(hits.groupBy("url", "fetched").agg(F.count("*").alias("n"), best.alias("_best")).select("url", "fetched", "n", F.col("_best.v").alias("matched")))
    few = matches.count() <= BROADCAST_ROWS
    joined = rows.filter(whole).join(F.broadcast(matches) if few else matches, ["url", "fetched"], "left")
    out = joined.unionByName(rows.filter(~whole), allowMissingColumns=True)
    n_active = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("page_id", "url", "fetched", n_active.alias("n_active"), "matched", (n_active > 0).alias("blocked"))


def _listed(entries: DataFrame) -> DataFrame:
    """A value's intervals in one row: as many as the list has of it."""
    return intervals(entries).groupBy("value").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("_spans"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def _day(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + n * 86400)


def page_captures(pages: DataFrame) -> DataFrame:
    """`pages` has no fetch times: page n is taken as fetched 7919 n mod 525600 minutes into 2024."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7919 % 525600 * 60).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """`pages` has no list: by the number m of its host's MD5, a fifth of the hosts is added on day m mod 300, half of
    these removed 60 days later and a quarter added again after 30 more; every seventh host has its `/en/` listed."""
    hosts = pages.select(host(F.col("url")).alias("h")).filter("h <> ''").distinct().withColumn("m", _number(F.col("h")))
    day, listed = F.col("m") % 300, F.col("m") % 5 == 0
    kinds = [
        (listed, F.col("h"), "add", day), (listed & (F.col("m") % 2 == 0), F.col("h"), "remove", day + 60), (listed & (F.col("m") % 4 == 0), F.col("h"), "add", day + 90),
        (F.col("m") % 7 == 1, F.concat("h", F.lit("/en/")), "add", day),
    ]
    entries = F.array(*(F.when(when, F.struct(value.alias("value"), F.lit(action).alias("action"), _day(at).alias("at"))) for when, value, action, at in kinds))
    return hosts.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*")


def op5_url_list_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return evaluate(page_captures(pages), page_entries(pages)).drop("url")


OP5_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS h,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7919 % 525600 AS BIGINT)) AS fetched FROM pages),
hosts AS (SELECT h, CAST('0x' || substr(md5(h), 1, 6) AS BIGINT) AS m FROM (SELECT DISTINCT h FROM p WHERE h <> '')),
e AS (
  SELECT h AS value, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(CAST(m % 300 AS INT)) AS ts FROM hosts WHERE m % 5 = 0
  UNION ALL SELECT h, 'remove', TIMESTAMP '2024-01-01' + to_days(CAST(m % 300 + 60 AS INT)) FROM hosts WHERE m % 10 = 0
  UNION ALL SELECT h, 'add', TIMESTAMP '2024-01-01' + to_days(CAST(m % 300 + 90 AS INT)) FROM hosts WHERE m % 20 = 0
  UNION ALL SELECT h || '/en/', 'add', TIMESTAMP '2024-01-01' + to_days(CAST(m % 300 AS INT)) FROM hosts WHERE m % 7 = 1),
spans AS (SELECT * FROM (SELECT value, action, ts AS a, lead(ts) OVER (PARTITION BY value ORDER BY ts) AS b FROM e) WHERE action = 'add'),
l AS (SELECT *, string_split(h, '.') AS labels, string_split(path, '/') AS parts FROM p WHERE h <> ''),
k AS (
  SELECT DISTINCT r, fetched, value FROM (
    SELECT r, fetched, array_to_string(labels[i:], '.') AS value FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM l)
    UNION ALL SELECT r, fetched, h || array_to_string(parts[1:i], '/') || '/' FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM l))),
hit AS (SELECT r, value FROM k JOIN spans USING (value) WHERE a <= fetched AND (b IS NULL OR fetched < b)),
best AS (SELECT r, count(*) AS n, min((-length(value), value)) AS m FROM hit GROUP BY r)
SELECT page_id, fetched, CAST(coalesce(n, 0) AS BIGINT) AS n_active, m[2] AS matched, coalesce(n, 0) > 0 AS blocked FROM p LEFT JOIN best USING (r)
"""
