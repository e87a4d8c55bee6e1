"""Names that clash, rules that act, brute force, and sizes that cross the limits of blocks."""

import itertools
import math
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linkspark.llm import common, html, jaccard, langid, mixing, quality, tokens, topk, warc
from linkspark.llm.common import scratch

from .test_operators import passage

CLASHES = "_text _counts _host _rejected _watched _scored _lang _null _id _key _place _row _digest _base _more _copies _copy _source _failed _words host node label key n size word place head".split()


def test_columns_of_any_name_stay(spark):
    rows = [(i, passage(60 + i % 7, 60), "en", f"s{i % 2}") for i in range(8)] + [(None, passage(70, 50), "en", None), (None, None, None, None), (9, "few words", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHES})
    for f in (quality.filter_documents, langid.filter_documents, jaccard.distinct_documents, mixing.mixed):
        got = f(docs)
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[c] == f"{c}:{r.text or ''}{'' if r.doc_id is None else r.doc_id}" for c in CLASHES), f.__name__
    upper = docs.select("doc_id", "text", "lang", "source", F.lit("kept").alias("_COUNTS"), F.lit("kept").alias("_Scored"), F.lit("kept").alias("_KEY"))
    assert all(r[4:] == ("kept",) * 3 for f in (quality.filter_documents, langid.filter_documents, jaccard.distinct_documents) for r in f(upper).collect())


def test_hosts_get_verdicts(spark):
    junk, clean = "spam spam spam spam spam " * 12, lambda i: passage(1000 + i, 40)
    rows = [(i, clean(i) if i % 10 else junk, f"h{i % 12}") for i in range(12 * 60)]  # alike
    rows += [(10_000 + i, clean(i) if i % 10 == 0 else junk, "bad") for i in range(200)]
    # a host where two documents of five have too many symbols, and two have over half as many
    rows += [(20_000 + i, clean(i) + (" #" * 6 if i % 5 < 2 else " #" * 3 if i % 5 < 4 else ""), "odd") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.score_documents(docs).collect()}
    bad = [r for i, r in got.items() if 10_000 <= i < 20_000]
    assert all(not r.kept and "repeated_words" in r.host_rejected for r in bad) and any(not r.base_failed for r in bad)
    odd = {i - 20_000: r for i, r in got.items() if i >= 20_000}
    assert all(r.host_watched == "symbols" and r.host_rejected == "" and not r.base_failed and r.kept == (i % 5 == 4) for i, r in odd.items())
    alike = [r for i, r in got.items() if i < 10_000]
    assert all(r.kept == (not r.base_failed) and r.host_rejected == r.host_watched == "" for r in alike)
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == {i for i, r in got.items() if r.kept}
    # rates that differ by chance alone
    rng = np.random.default_rng(3)
    even = spark.createDataFrame([(i, junk if rng.random() < 0.1 else clean(i), f"h{i % 20}") for i in range(1000)], "doc_id long, text string, source string")
    assert quality.score_documents(even).filter("not base_failed and not kept").count() == 0


def test_spans_in_windows():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 255, 5000).astype(np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 60))
    start, end = cuts[:-1], cuts[1:] - (rng.random(len(cuts) - 1) < 0.5)
    whole = common.Spans(data).hash(start, end)
    for step in (7, 64, 700):
        assert (common.span_hashes(data, start, end, step) == whole).all()


def plain_kneser_ney(texts, text):
    """Cross-entropy a symbol of interpolated Kneser-Ney models, by dictionaries."""
    symbols = lambda t: "\0" + re.sub(r"\0+", "\0", "".join(c.lower() if c.isalpha() else "\0" for c in t)).lstrip("\0")
    grams = lambda t: [("\0\0\0" + symbols(t))[i : i + 4] for i in range(1, len(symbols(t)))]
    seen = {}
    for language, own in texts.items():
        tables = {4: {}}
        for g in itertools.chain.from_iterable(map(grams, own)):
            tables[4][g] = tables[4].get(g, 0) + 1
        for k in (3, 2, 1):
            tables[k] = {}
            for g in tables[k + 1]:
                tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
        seen[language] = tables
    alphabet = len({g for t in seen.values() for g in t[1]})

    def p(tables, gram):
        if not gram:
            return 1 / alphabet
        table = tables[len(gram)]
        values = list(table.values())
        ones, twos = values.count(1), values.count(2)
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
        same = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        lower = p(tables, gram[1:])
        return (max(table.get(gram, 0) - discount, 0) + discount * len(same) * lower) / sum(same) if same else lower

    found = grams(text)
    return {x: -sum(math.log(p(t, g)) for g in found) / len(found) for x, t in seen.items()}


def test_kneser_ney_by_dictionaries(monkeypatch):
    texts = {"a": ["the cat sat on the mat", "the dog ate the cat. Then it sat"], "b": ["der hund und die katze", "die katze sitzt auf der matte"]}
    counts = {}
    for language, own in texts.items():
        symbols, at, _ = langid._symbols(own)
        counts[language] = np.unique(np.delete(langid._grams(symbols, at), at[:-1]), return_counts=True)
    model = langid.Model(counts)
    for probe in ("the cat and the hund", "die matte sat", "  1 katze, 2 cats!"):
        want = plain_kneser_ney(texts, probe)
        got = model.entropies([probe])[0][0]
        assert np.allclose(got, [want[x] for x in model.languages], rtol=1e-5)
    long = ["the cat " * 50, "", "die katze 1 " * 40, "x"]
    whole = model.entropies(long)
    monkeypatch.setattr(langid, "STEP", 37)
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(whole, model.entropies(long), strict=True))


def test_an_unlearned_language_is_rejected(spark):
    rng = np.random.default_rng(6)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))
    rows = [(i, make("abcdeaeae" if i % 2 else "fghijfjfj", int(rng.integers(20, 80))), "x" if i % 2 else "y") for i in range(1500)]
    rows += [(5000 + i, make("opqrstuv", 50), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, max_docs=50).collect()}
    assert all(got[5000 + i].rejected for i in range(20))
    assert sum(r.rejected for i, r in got.items() if i < 5000) <= 0.01 * 1500
    assert {r.doc_id for r in langid.filter_documents(docs, max_docs=50).collect()} == {i for i, r in got.items() if not r.rejected}


def test_top_k_of_any_size(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 9000)] + rng.normal(size=(9000, 16)) * 0.05
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 900 == 0, 7).collect()
    q = np.floor(256 * v)
    for i in range(0, 9000, 900):
        s = q @ q[i]
        s[i] = -np.inf
        want = np.lexsort((np.arange(9000), -s))[:7]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want.tolist()
    assert max(r.scored for r in got) < 9000
    huge = [(0, [2.0**60, 1.0]), (50, [2.0**54, -3.0]), (1, [-(2.0**70), 2.0]), (2, [1.0, 1.0]), (3, [1e300, 5.0])]
    got = topk.search(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    limit = 2**63 - 1
    assert [(r.vec_id, r.score) for r in got] == [(3, limit), (50, limit), (2, limit), (1, -limit - 1)]


def brute_components(texts, size, similarity):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


@pytest.mark.parametrize("missed", [jaccard.MISSED, None])
def test_long_lists_are_split(spark, monkeypatch, missed):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "BUNDLE", 3)
    shared, big = passage(301, 30), passage(302, 400).split()
    texts = [f"{shared} {passage(400 + i, 6)}" for i in range(12)]  # one passage, mostly apart
    texts += [" ".join(big[: 100 + i] + [f"x{i}"] + big[100 + i :]) for i in range(24)]  # one cluster
    texts += [" ".join(big[:200] + passage(500 + i, 150).split()) for i in range(6)]  # share its lists, but aren't near
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(df, 3, 90, missed).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 3, 90)


def test_the_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, passage(700 + i, 120), "en", "s1", 0) for i in range(14)]
    rows += [(20, rows[3][1] + " end", "en", "s1", 0), (21, rows[3][1], "en", "s1", 0), (None, rows[4][1], "en", "s1", 0), (None, passage(800, 80), "en", "s1", 0), (30, "too short", "en", "s1", 0), (31, None, None, "s1", 0), (32, "spam " * 90, "en", "s1", 0), (33, "12 34 " * 60, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lettered = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    sound = [r for r in lettered if len(r[1].split()) >= 10 and "spam" not in r[1]]
    label = brute_components([r[1] for r in sound], 5, 80)
    heads = [min((r for r, c in zip(sound, label, strict=True) if c == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(label)]
    enc = corpus_pipeline.bpe.encoding(public_tokenizers.path(corpus_pipeline.bpe.RANKS))
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted((r[0] or -1, tuple(enc.encode_ordinary(r[1]))) for r in heads)  # one source: each once


def test_mix_again_and_targets():
    sizes = np.array([10.0, 100.0, 1000.0])
    weights = np.array([5.0, 2.0, 1.0])
    got = mixing.fill(weights, sizes, sizes.sum())
    # the first two stop at three times their size; the third gets what is left
    assert np.allclose(got, [30, 300, 780])
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.subset(lengths, counts, budget)
        best = max(s for s in (sum(x * y for x, y in zip(lengths, t, strict=True)) for t in np.ndindex(*(counts + 1))) if s <= budget)
        assert (take <= counts).all() and best - lengths.max() <= (take * lengths).sum() <= budget


def test_mix_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), ["a", "b", None][i % 3 if i < 60 else 0]) for i in range(300)]
    runs = [mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(k)).toPandas().sort_values("doc_id").reset_index(drop=True) for k in (1, 5)]
    assert runs[0].equals(runs[1])


def test_warc_headers(spark):
    path = scratch(spark, "w")
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, "http://a/3", "y"), (3, "http://a/3", "y"), (4, None, "y")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    heads = [warc._parse(bytes(r.data).split(b"\r\n\r\n")[0]) for r in spark.read.parquet(path).collect()]
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in heads)
    ids = {h["WARC-Record-ID"] for h in heads}
    assert len(ids) == 5 and all(re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", x) for x in ids)
    by = {h["X-Page-ID"]: h for h in heads}
    assert by["2"]["WARC-Refers-To"] == by["1"]["WARC-Record-ID"] and by["2"]["WARC-Refers-To-Target-URI"] == "http://a/1"
    assert "WARC-Refers-To" not in by["4"] and by["4"]["X-Refers-To-Page-ID"] == "3"  # two records could be meant
    broken = spark.read.parquet(path).withColumn("running", F.sha1("record"))
    broken.write.parquet(path + "-broken")
    with pytest.raises(Exception, match="running digest"):
        warc.read_archives(spark, path + "-broken").collect()


def test_warc_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    path = scratch(spark, "w")
    warc.write_archives(spark.createDataFrame([(i, "u", f"x{i % 3}") for i in range(30)], "page_id long, url string, html string"), path)
    assert {(r.page_id, r.refers_to) for r in warc.read_archives(spark, path).collect()} == {(i, i % 3 if i > 2 else None) for i in range(30)}


def test_html_markup():
    read = lambda x: [t for _, t, _ in html.blocks(x)]
    assert read("<p alt=Bob's>one</p><p>two's</p>") == ["one", "two's"]
    assert read("<div>a<svg><text>b</text></div><p>c") == ["a", "c"]
    assert "2 + y" in read("<p>x</p><math>2 + y</math><canvas>d</canvas>")
    assert read("<form><select><option>no</select>label</form>") == ["label"]
    assert read('<p title="a > b">text</p><script>if (a < b) "</p>"</script>') == ["text"]


def test_html_layouts_that_were_not_trained_on():
    held = ("neutral", "table")
    model = html.train(500, 14, 5, tuple(x for x in html.LAYOUTS if x not in held))
    pages = html.made(120, 31, held)
    found = [(a, b) for a, (_, b) in zip(model.label([x for x, _ in pages]), pages, strict=True)]
    tp, fp, fn = (sum(int(f(a, b).sum()) for a, b in found) for f in (lambda a, b: a & b, lambda a, b: a & ~b, lambda a, b: ~a & b))
    assert 2 * tp / (2 * tp + fp + fn) > 0.7


def test_small_tables_have_a_dictionary(spark):
    path = scratch(spark, "t")
    tokens.write_shards(spark.createDataFrame([(i, f"some words {i}") for i in range(5)], "doc_id long, text string"), path)
    assert len(spark.read.parquet(f"{path}/dictionary").first()[0]) > 0 and tokens.read_shards(spark, path).count() == 5
