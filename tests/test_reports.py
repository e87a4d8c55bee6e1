import json

import pytest
from pyspark.sql import functions as F

from linkspark import check_results, fixture, report_queries
from linkspark.functions import arrays as A
from linkspark.functions import unicode as U
from linkspark.operators import audits as AU
from linkspark.operators import channels as CH
from linkspark.operators import evaluate as EV
from linkspark.operators import profiles as P
from linkspark.operators import reports as R
from linkspark.operators import study as ST
from linkspark.plans.build import build, conforms, dictionary, with_folded
from linkspark.rules import GAZETTEER
from linkspark.sources import io
from linkspark.sources.staging import forget, staged
from linkspark.streaming.probe import probe


@pytest.fixture(scope="module")
def records(spark):
    return fixture.processed(spark).cache()


def test_gazetteer_keys_as_the_columns_make_them(spark):
    keys = sorted({k for kinds in GAZETTEER.values() for names in kinds.values() for k in names})
    from linkspark.functions import text as T

    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in df.select("k", U.fold(T.punctuation_stage(T.norm(F.col("k")))).alias("c")).collect():
        assert A.canonical(r.k) == r.c


def test_build_types(spark):
    df = build(spark.createDataFrame(fixture.RAW, io.RAW))
    assert conforms(df, types=True) == [] and conforms(df.withColumn("name_tokens", F.lit("x")), types=True) != []
    assert dictionary().count("\n") == 59


def test_staged_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    assert staged(spark, "t", make).count() == staged(spark, "t", make).count() == 5 and len(made) == 1
    forget(spark, "t")
    assert staged(spark, "t", make).count() == 5 and len(made) == 2


def test_rows_in_order(spark):
    df = spark.range(0, 1000, 1, 7)
    assert [r.row for r in AU.indexed(df).orderBy("id").collect()] == list(range(1000))
    assert AU.same_frame(df, df.repartition(3)) and AU.same_frame(df, df, ordered=True) and not AU.same_frame(df, df.orderBy(F.desc("id")), ordered=True)


def test_trigram_blocks(spark, records, monkeypatch):
    index, queries = records.filter("source = 's1'"), records.filter("source <> 's1'")
    whole = CH.channel_e_region(index, queries, 0.5, 5).collect()
    monkeypatch.setattr(CH, "ROWS", 5)
    monkeypatch.setattr(CH, "BUNDLE", 4)
    assert sorted(CH.channel_e_region(index, queries, 0.5, 5).collect()) == sorted(whole)


def test_romanised_names(spark, records):
    rows = {(r.method, r.script): r for r in AU.romanisation(fixture.truth(spark), records).collect()}
    pairs = [(a["name_clean"], b) for s1, q in fixture.made()[1] for a in fixture.made()[0] if a["entity_id"] == s1 for b in fixture.made()[0] if b["entity_id"] == q and b["name_script"] == "Telugu"]
    for method, column in (("raw", "name_clean"), ("romanised", "name_latin")):
        ratios = sorted(U.ratio_text(a, b[column]) for a, b in pairs)
        median = (ratios[(len(ratios) - 1) // 2] + ratios[len(ratios) // 2]) / 2
        assert abs(rows[method, "ALL"].median_ratio - median) < 0.06 and rows[method, "ALL"].pairs == len(pairs)
    assert rows["romanised", "ALL"].median_ratio_lift > 50
    assert AU.romanisation_examples(fixture.truth(spark), records, 2).count() == 2


def test_study(spark, records, tmp_path):
    index, queries = records.filter("source = 's1'"), records.filter("source <> 's1'")
    meter = ST.Meter()
    runs = ST.channel_runs("study", index, queries, k=10, channels=("A", "B", "C", "D", "F", "G"), meter=meter)
    configs = {k: v for k, v in CH.ABLATIONS.items() if "E'" not in v}
    assert len(configs) == 1 and len(CH.ABLATIONS) == 12
    rows = ST.channel_summary(fixture.truth(spark), runs, queries).collect()
    assert len(rows) == 7 and max(rows, key=lambda r: r.pair_recall).config == "union of all"
    assert meter.report(spark).count() == 6
    assert json.loads(ST.write_manifest(f"{tmp_path}/m.json", meter, {"k": 10}))["config"] == {"k": 10}


def test_evaluation_helpers(spark, records):
    index, queries, truth = records.filter("source = 's1'"), records.filter("source <> 's1'"), fixture.truth(spark)
    picked, some = EV.sample_block(index, queries, truth, 50)
    ids = {r.entity_id for r in picked.collect()}
    assert 0 < len(ids) < index.count()
    assert {q for s1, q in fixture.made()[1] if s1 in ids} <= {r.entity_id for r in some.collect()}
    ordered = R.order_domain(spark.createDataFrame([("test",), ("s1",), ("ALL",), ("train",), (None,)], "k string"), ["k"]).collect()
    assert [r.k for r in ordered] == ["ALL", "train", "test", None, "s1"]
    values = spark.createDataFrame([(i,) for i in range(11)], "v int")
    assert values.agg(R.nearest_quantile(F.col("v"), 0.95).alias("q"), R.n_unique(F.when(F.col("v") > 2, F.col("v"))).alias("n")).first()[:] == (10, 9)
    rates = R.group_rates(records, ["source"], {"latin": F.col("name_script") == "Latin"}).collect()
    assert {r.source for r in rates} == {"s1", "s2", "s3"}
    assert P.representation_examples(records.withColumns({c: F.lit(False) for c in ("name_has_special_chars", "address_has_encoding_artifact", "name_has_latin_diacritics")}), one_of=1).count() > 0
    assert records.filter(A.same_set(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a")))).count() == records.count()


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tn\nS1-1\t5\nS1-2\t6\n")
    import hashlib

    row = io.checksums(spark, f"{tmp_path}/a.tsv").first()
    assert (row.length, row.sha256) == (19, hashlib.sha256((tmp_path / "a.tsv").read_bytes()).hexdigest())
    assert io.sniff(spark, f"{tmp_path}/a.tsv") == {"id": "string", "n": "int"}
    assert {r.id for r in io.id_set(spark, f"{tmp_path}/a.tsv").collect()} == {"S1-1", "S1-2"}
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    assert [(r.n_matches, r.n_s2) for r in io.scan_truth(spark, f"{tmp_path}/t.tsv").orderBy("source1_entity_id").collect()] == [(2, 1), (0, 0)]
    df = with_folded(build(spark.createDataFrame(fixture.RAW, io.RAW)))
    io.write_processed(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == len(fixture.RAW)
    io.write_report(spark.createDataFrame([("x", 1)], "k string, n int"), f"{tmp_path}/r")
    assert [tuple(r) for r in io.read_report(spark, f"{tmp_path}/r").collect()] == [("x", 1)]


def test_result_files(spark, tmp_path):
    for n, ids in ((1, ["S1-1", "S1-2"]), (2, ["S2-1"]), (3, ["S3-1"])):
        (tmp_path / f"test_source{n}.tsv").write_text("entity_id\tbusiness_name\n" + "".join(f"{i}\tx\n" for i in ids))
    good, bad, wide = (tmp_path / f"{k}.tsv" for k in ("good", "bad", "wide"))
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-9\n")
    wide.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-1\nS1-2\t\n")
    assert check_results.run(spark, str(good), str(tmp_path)) == (0, [])
    code, said = check_results.run(spark, str(bad), str(tmp_path))
    assert code == 1 and any("unknown id" in x for x in said) and any("missing S1" in x for x in said)
    assert check_results.run(spark, str(good), str(tmp_path), str(wide)) == (0, ["1 matched pairs aren't among the candidates"])
    (tmp_path / "test_source3.tsv").unlink()
    assert "aren't checked" in check_results.run(spark, str(good), str(tmp_path))[1][0]
    assert check_results.run(spark, str(good), f"{tmp_path}/none")[0] == 2


def test_stream_of_new_records(spark, tmp_path):
    index = build(spark.createDataFrame([("S1-1", "alpha beta llc", "x", "US"), ("S1-2", "gamma delta", "x", "US")], io.RAW))
    spark.createDataFrame([("S2-1", "Alpha Beta", "y", "US"), ("S2-2", "nothing", "y", "US")], io.RAW).write.parquet(f"{tmp_path}/in")
    probe(spark, f"{tmp_path}/in", index, f"{tmp_path}/out", f"{tmp_path}/check", {"B": 1}).awaitTermination()
    assert [(r.q, r.s1) for r in spark.read.parquet(f"{tmp_path}/out").select("q", "s1").collect()] == [("S2-1", "S1-1")]


def test_every_report_has_rows(spark):
    for name in ("made_channel_c", "made_channel_f", "stage_gains", "name_decoys", "region_decoys"):
        assert report_queries.QUERIES[name](spark, "").count() > 0
