import pytest
from pyspark.sql import functions as F

from linkspark.functions import text as T
from linkspark.functions import unicode as U
from linkspark.operators import channels as CH
from linkspark.operators import checks as CK
from linkspark.operators import evaluate as EV
from linkspark.plans.build import ORDER, build, conforms
from linkspark.sources.io import RAW, ground_truth, scan_tsv


def built(spark, *rows):
    return build(spark.createDataFrame([(f"S1-{i}", *r) for i, r in enumerate(rows)], RAW)).orderBy("entity_id").collect()


def test_names_and_addresses(spark):
    rows = built(
        spark,
        ("O'Reilly & Sons, L.L.C.", "12 Main St, NULL, <null>, N/A, Ohio", "us"), ("rock'n'roll b&b abc-123", "Null Bazar, Bldg N/A, an, Maharashtra", "India"), ("SA", "001, 000, 10", "US"),
        ("école Có jp morgan & co", "nord, paris", "France"), (None, "  ", "Germany"), ("https://www.Abc-Def.co.in", "x, washington, dc", "US"), ("Southern பவர்", "ga", "India"), ("a.b.c.d.e.f.g # 4", "ga", "US"),
    )
    assert conforms(spark.createDataFrame([], ", ".join(f"{c} string" for c in ORDER))) == []
    a, b, c, d, e, f, g, h = rows
    assert (a.name_norm, a.name_clean, a.name_base, a.name_legal_forms) == ("o'reilly & sons, l.l.c.", "oreilly & sons llc", "oreilly & sons", ["llc"])
    assert (a.address_segments, a.address_region, a.address_has_placeholder) == (["12 main st", "ohio"], "US-OH", True)
    assert (b.name_clean, b.address_region, b.address_segments[:2]) == ("rocknroll b & b abc 123", "IN-MH", ["null bazar", "bldg n a"])
    assert (c.name_base, c.name_legal_only, c.address_numbers) == (None, True, ["1", "0", "10"])
    assert (d.name_base, d.address_region) == ("école jp morgan", None)
    assert (e.name_norm, e.name_missing, e.address_missing, e.country_clean, e.address_region) == (None, True, True, "Germany", None)
    assert (f.name_domain, f.name_is_domain_only, f.address_region) == ("abc-def.co.in", True, "US-DC")
    assert (g.name_script, g.address_region, h.address_region) == ("Latin+Tamil", "IN-GA", "US-GA")
    assert g.name_latin.startswith("southern p") and h.name_clean.startswith("abcdefg")


def test_unicode(spark):
    row = spark.createDataFrame([("No. â\x80\x93 01", "Ａ B", "école लिमिटेड", "é")], "a string, b string, c string, d string").select(T.norm(F.col("a")), T.norm(F.col("b")), U.fold(F.col("c")), T.norm(F.col("d"))).first()
    assert list(row) == ["no. - 01", "a b", "ecole लिमिटेड", "é"]
    assert U.ratio_text("abcd", "abed") == 75.0 and round(U.jaro_winkler_text("martha", "marhta"), 4) == 0.9611


def test_channels_rank_ties_by_id(spark):
    rows = [(f"S1-{i}", f"alpha beta {i}", "x", "US") for i in range(6)] + [("S2-9", "alpha beta", "y", "US")]
    df = build(spark.createDataFrame(rows, RAW))
    index, queries = df.filter("entity_id like 'S1%'"), df.filter("entity_id like 'S2%'")
    got = CH.channel_d(index, queries, 1000, 3).orderBy("rank").collect()
    assert [(r.s1, r["rank"]) for r in got] == [("S1-0", 1), ("S1-1", 2), ("S1-2", 3)]
    assert CH.channel_e(index, queries, 1.0, 2).count() == 2


def test_f_half_and_truth(spark):
    t = spark.createDataFrame([("a", ["x", "y"])], "s1 string, ids array<string>")
    assert round(EV.f_half(t, spark.createDataFrame([("a", ["x", "y", "z"])], t.schema)).first().f_half, 3) == 0.714
    single = spark.createDataFrame([("a", []), ("b", [])], t.schema)
    assert EV.f_half(single, spark.createDataFrame([("a", ["x"])], t.schema)).first().f_half == 0.5
    gt = ground_truth(spark.createDataFrame([("S1-1", "S2-1, S3-2"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string")).orderBy("source1_entity_id").collect()
    assert [(r.n_matches, r.n_s2, r.n_s3) for r in gt] == [(2, 1, 1), (0, 0, 0)]


@pytest.mark.parametrize(("text", "rule"), [
    ("", "empty file"), ("a,b\n", "commas instead of tabs"), ("x\ty\n", "unexpected header"), ("s\tm\nS1-1\n", "malformed row"), ("s\tm\nS1-1\t\nS1-1\t\n", "duplicate row"), ("s\tm\nS1-1\tS2-1,S2-1\n", "repeated id in a list"),
    ("s\tm\nS1-1\tS1-2\n", "self match"), ("s\tm\nS1-1\tQ-2\n", "wrong prefix"), ("s\tm\n", "missing S1"), ("s\tm\nS1-1\t\nS1-7\t\n", "unexpected S1"),
])
def test_submission(spark, tmp_path, text, rule):
    path = tmp_path / "out.tsv"
    path.write_text(text)
    required = spark.createDataFrame([("S1-1",)], "s1 string")
    assert rule in {r.rule for r in CK.check_submission(spark, str(path), ["s", "m"], required).collect()}


def test_tsv(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta "b" \\ c\t\tUS\n')
    row = scan_tsv(spark, str(path)).first()
    assert (row.business_name, row.business_address) == ('a "b" \\ c', None)
