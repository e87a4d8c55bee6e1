import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkspark import queries as core
from linkspark.operators import audits as AU
from linkspark.operators import channels as CH
from linkspark.operators import evaluate as EV
from linkspark.sources import staging

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark, tmp_path):
    """A few documents whose names recur: half of them S1 records."""
    texts = ["acme llc\nx, y", "acme llc\nz", "Acmé LLC", "b & b", "l'eau a.b.c inc", "", None]
    rows = [(i, texts[i % 7], ("en", "fr", "de")[i % 3], f"src{(0, 1, 3, 5)[i // 7 % 4]}", 0) for i in range(84)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def built_addresses(spark, d):
    return (spark.sparkContext.applicationId, f"records {d}") in staging._STAGED


def key_rows(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, country_clean string, a string, b string")


def test_exact_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(CH, "TILE", 3)
    sides = [[(f"{p}{i}", "US" if i % 5 else "IN", ("x", "y", None, "")[i * m % 4], ("y", "x", "z", None, "x")[i % 5]) for i in range(40)] for p, m in (("s", 1), ("q", 3))]
    sides[0].append(("s1", "IN", "y", "x"))  # an id in two blocks
    index, queries = (key_rows(spark, x) for x in sides)
    found = CH.exact(index, queries, [F.col("a"), F.col("b")], [F.col("a"), F.col("b")]).collect()
    keys = [[(r[0], {(r[1], k) for k in r[2:] if k}) for r in x] for x in sides]
    want = {(q, s) for s, a in keys[0] for q, b in keys[1] if a & b}
    assert len(found) == len(want) and {(r.q, r.s1) for r in found} == want


def test_channel_a_clean_builds_names_alone(spark, documents):
    found = core.channel_a_clean(spark, documents).count()
    assert not built_addresses(spark, documents)
    assert found == CH.channel_a(*core.sides(spark, documents)).count() > 0


def test_rows_numbered_in_one_dealing(spark):
    """Each run of a range partitioning draws its own sample, so bounds differ between runs."""
    df = spark.range(0, 60000, 1, 6).withColumn("k", F.xxhash64("id")).repartitionByRange(8, "k").sortWithinPartitions("k")
    rows = AU.indexed(df).orderBy("k").select("row").toPandas()["row"].tolist()
    assert rows == list(range(60000))


def test_channel_a_builds_names_alone(spark, documents):
    found = core.channel_a(spark, documents).count()
    assert not built_addresses(spark, documents)
    assert found == CH.exact(*core.sides(spark, documents), [F.col("name_norm")], [F.col("name_norm")]).count() > 0


def test_channel_b_builds_names_alone(spark, documents):
    found = core.channel_b(spark, documents).count()
    assert not built_addresses(spark, documents)
    assert found == CH.channel_b(*core.sides(spark, documents)).count() > 0


def test_channel_c_builds_names_alone(spark, documents):
    found = core.channel_c(spark, documents).count()
    assert not built_addresses(spark, documents)
    assert found == CH.channel_c(*core.sides(spark, documents)).count() > 0


def test_recall_exact_makes_no_other_pairs(spark, documents):
    found = core.recall_exact(spark, documents)
    assert "explode(s1" not in found._jdf.queryExecution().toString() and not built_addresses(spark, documents)
    assert found.collect() == EV.recall(core.truth(spark, documents), core.channel_a(spark, documents)).collect()


def test_exact_among(spark):
    index = key_rows(spark, [("s1", "US", "x", "y"), ("s2", "US", "z", None), ("s3", "IN", "x", "y")])
    queries = key_rows(spark, [("q1", "US", "y", "x"), ("q2", "US", "", "z")])
    pairs = spark.createDataFrame([(q, s) for q in ("q1", "q2", "q3") for s in ("s1", "s2", "s3")], "q string, s1 string")
    found = CH.exact_among(pairs, index, queries, [F.col("a"), F.col("b")], [F.col("a"), F.col("b")])
    assert sorted((r.q, r.s1) for r in found.collect()) == [("q1", "s1"), ("q2", "s2")]


def test_candidate_sizes_builds_names_alone(spark, documents):
    found = core.candidate_sizes(spark, documents).collect()
    assert not built_addresses(spark, documents)
    assert found == EV.sizes(core.sides(spark, documents)[1], core.channel_a(spark, documents)).collect()


def test_exact_sizes(spark):
    index = key_rows(spark, [("s1", "US", "x", "y"), ("s2", "US", "x", None), ("s3", "IN", "x", "y"), ("s4", "US", "y", None)])
    queries = key_rows(spark, [("q1", "US", "y", "x"), ("q2", "US", "", "x"), ("q3", "US", None, None)])
    both = [F.col("a"), F.col("b")]
    assert {r.q: r.n for r in CH.exact_sizes(index, queries, both, both).collect()} == {"q1": 3, "q2": 2, "q3": 0}


def test_overlap_by_classes(spark, monkeypatch):
    """Copies, a key above the cap, one that all records have, and ids that tie, against brute force."""
    monkeypatch.setattr(CH, "ROWS", 4)
    monkeypatch.setattr(CH, "BUNDLE", 3)
    names = ["a b", "b a", "a c", "c d", "d e f", "a", None, "f", "c c d"]
    sides = [[(f"{p}{i:02}", "US" if i % 4 else "IN", names[i * m % 9], None) for i in range(45)] for p, m in (("s", 1), ("q", 2))]
    sides[0] += [("t1", "FR", "g h", None), ("t2", "FR", "g", None)]
    sides[1] += [("u1", "FR", "g", None)]
    index, queries = (key_rows(spark, x) for x in sides)
    for cap, k in ((1000, 3), (9, 4)):
        found = CH.overlap(index, queries, lambda _: F.split("a", " "), cap, k).collect()
        posted, n, want = {}, {}, set()
        for i, c, t, _ in sides[0]:
            n[c] = n.get(c, 0) + 1
            for w in set((t or "").split()):
                posted.setdefault((c, w), []).append(i)
        for q, c, t, _ in sides[1]:
            scores = {}
            for w in set((t or "").split()):
                own = posted.get((c, w), [])
                for i in own if len(own) <= cap else []:
                    scores[i] = scores.get(i, 0) + math.log(n[c]) - math.log(len(own))
            best = sorted((-round(x, 9), i) for i, x in scores.items())[:k]
            want |= {(q, i, round(-x, 6) + 0.0, r) for r, (x, i) in enumerate(best, 1)}
        assert len(found) == len(want) and {(r.q, r.s1, round(r.score, 6), r["rank"]) for r in found} == want


def test_overlap_tokens_builds_names_alone(spark, documents):
    assert core.overlap_tokens(spark, documents).count() > 0 and not built_addresses(spark, documents)


def test_channel_d_shuffles_no_pairs(spark, documents):
    """Blocks and bundles meet as wholes: no join by key makes a row for every key that two records share."""
    found = core.channel_d(spark, documents)
    plan = found._jdf.queryExecution().toString()
    assert "mapInArrow" in plan.replace("MapInArrow", "mapInArrow") and "sum(idf" not in plan and not built_addresses(spark, documents)
    assert found.count() > 0


def test_six_digits_as_the_sql_rounds(spark):
    row = spark.createDataFrame([(32.5256645,), (0.25,)], "score double").select(core._six().alias("s")).collect()
    assert [r.s for r in row] == [32.525664, 0.25]


def test_channel_e_deals_blocks_evenly(spark, documents):
    found = core.channel_e(spark, documents)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() or "RepartitionByExpression" in found._jdf.queryExecution().toString() or "Repartition " in found._jdf.queryExecution().toString()
    assert not built_addresses(spark, documents)


def test_trigrams_of_classes(spark, monkeypatch):
    """Copies, short names and names of other scripts, against brute force."""
    monkeypatch.setattr(CH, "ROWS", 4)
    monkeypatch.setattr(CH, "BUNDLE", 3)
    names = ["acme corp", "acme corp", "acme co", "b", "bb", "पवन", None, "corp acme", "aaaa aaaa", "zeta"]
    rows = [(f"{p}{i:02}", "US" if i % 3 else "IN", names[i * m % 10]) for p, m in (("s", 1), ("q", 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "entity_id string, country_clean string, name_clean string").withColumns({"name_clean_folded": F.col("name_clean"), "name_latin": F.lit(None).cast("string"), "address_region": F.lit(None).cast("string")})
    found = CH.channel_e(df.filter("entity_id like 's%'"), df.filter("entity_id like 'q%'"), 0.5, 4).collect()
    tf = {i: Counter(f" {t} "[j : j + 3] for j in range(len(t))) if t else {} for i, _, t in rows}
    of = {i: c for i, c, _ in rows}
    n = Counter(c for i, c, _ in rows if i[0] == "s")
    df = Counter((of[i], g) for i in tf if i[0] == "s" for g in tf[i])
    idf = {(c, g): math.log(1 + n[c]) - math.log(1 + x) + 1 for (c, g), x in df.items() if x <= max(1, n[c] // 2)}
    w = {i: {g: (1 + math.log(x)) * idf[of[i], g] for g, x in tf[i].items() if (of[i], g) in idf} for i in tf}
    w = {i: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for i, v in w.items()}
    want = set()
    for q in (i for i in w if i[0] == "q"):
        scores = sorted((-round(sum(x * w[s].get(g, 0) for g, x in w[q].items()), 9), s) for s in w if s[0] == "s" and of[s] == of[q])
        want |= {(q, s, round(-x, 6), r) for r, (x, s) in enumerate([p for p in scores if p[0] < 0][:4], 1)}
    assert len(found) == len(want) and {(r.q, r.s1, round(r.score, 6), r["rank"]) for r in found} == want
