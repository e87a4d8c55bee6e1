import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.llm import bpe, html, jaccard, langid, mixing, quality, tokens, topk, urls, warc
from linkspark.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string, size long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(50)) for i in rng.integers(0, len(WORDS), n))


def texts():
    base = passage(1, 300)
    return [None, "", " \t\n ", "one", "One", "two words", "<|endoftext|> x  y \n z ", base, base, base.upper(), base + " end", base.replace("alpha", "ALPHA"), passage(2, 40), passage(3, 5) * 400, "日本語" * 3000, "a" * 9000, " " * 5000 + "b", "é́ x\r\n\ty"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, [None, "s1", "s2"][i % 3], 0, "k", "n", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[7], (None, "null id text here", "en", None, 0, "k", "n", 1)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert [quality.score_documents(empty).count(), langid.identify(empty).count(), bpe.encode_documents(empty).count(), mixing.mix_documents(empty).count(), jaccard.link_documents(empty).count(), html.extract(pages, html.Labeller()).count()] == [0] * 6
    for f in (quality.filter_documents, langid.filter_documents, jaccard.distinct_documents, mixing.mixed):
        assert f(empty).columns == empty.columns and f(empty).count() == 0
    path = scratch(spark, "t")
    tokens.write_shards(empty, path)
    assert tokens.read_shards(spark, path).count() == 0
    path = scratch(spark, "w")
    warc.write_archives(pages, path)
    assert warc.read_archives(spark, path).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert urls.evaluate(urls.page_captures(pages), urls.page_entries(pages)).count() == 0


def test_quality(docs):
    got = {r.doc_id: r for r in quality.score_documents(docs).collect()}
    assert (got[0].n_words, got[0].base_failed, got[5].n_words, got[8].n_words) == (0, True, 2, 300)
    a = quality.measure(pa.array(["a b c d e a b c d e x", "x\ny\nx\n \n \nx", "é# w"]))
    assert [x.tolist() for x in a.values()] == [[11, 4, 2], [11, 4, 3], [0, 0, 1], [0, 2, 0], [10, 0, 0]]
    assert quality.filter_documents(docs).columns == docs.columns


def test_language(spark):
    rows = [(i, " ".join(("der die und schlange" if i % 2 else "the and of snake").split()[(i * k) % 4] for k in range(1, 30)), "de" if i % 2 else "en") for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 %", "de"), (None, "the and of", "en")], "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    known = {i: x for i, _, x in rows}
    assert all(r.lang_pred == known[r.doc_id] for r in got if r.doc_id in known) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901)} == {900: "und", 901: "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_bpe(docs):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    got = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    for i, t in enumerate(texts()):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    rng = np.random.default_rng(0)
    for _ in range(300):
        t = "".join(rng.choice(list("ab'sre \n\t1,é日"), rng.integers(1, 60)))
        assert bpe.encode(t, enc.encode_ordinary, size=2) == enc.encode_ordinary(t)


def test_token_shards(spark, docs):
    from tokenizers import Tokenizer

    path = scratch(spark, "t")
    tokens.write_shards(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), path)
    got = tokens.read_shards(spark, path, ids=True).orderBy("doc_id").collect()
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))  # as the contract calls it: special tokens too
    assert 50256 in plain.encode("x <|endoftext|> y", add_special_tokens=False).ids
    start = 0
    for r, t in zip(got, texts(), strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rng = np.random.default_rng(1)
    odd = [None, "a. b., c,., .", "x 1. é, 日. _., q", "x <|endoftext|> y", "x<|endoftext|>y. a<|endoftext|>, <|endoftext|>", "x  <|endoftext|>  \n<|endoftext|>", " \n a b", "a  b", *("".join(rng.choice(list("ab's.,re \n\t1,é日 "), rng.integers(0, 40))) for _ in range(500))]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    encoder = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    assert encoder.encode(pa.array(["cut off", *odd]).slice(1)) == want == encoder.encode(pa.array(odd))
    many = [np.random.default_rng(i).integers(0, 300, 2000).astype("<u4").tobytes() for i in range(200)]
    assert tokens.train(many) and tokens.train(many[:3]) == b""


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), ["a", "b", None][i % 3 if i < 60 else 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(df).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == 300
    by = got.merge(df.select("doc_id", "source").toPandas()).fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by["taken"] - by["target"]) <= 1.5).all() and abs(by["target"].sum() - by["size"].sum()) < 1e-6
    assert got.sort_values("doc_id").equals(got.sort_values("doc_id")) and mixing.mixed(df).count() == int((got["taken"] / got["size"].clip(lower=1)).sum())
    for lengths, counts, budget in ((np.array([3, 5]), np.array([2, 1]), 7), (np.array([4, 6, 9]), np.array([3, 2, 2]), 23)):
        best = max(s for s in (sum(x * y for x, y in zip(lengths, t, strict=True)) for t in np.ndindex(*(counts + 1))) if s <= budget)
        assert int((mixing.knapsack(lengths, counts, budget) * lengths).sum()) == best


def test_jaccard(spark, docs):
    near = passage(9, 200).split()
    more = [(100 + i, " ".join(near[:50 + i] + ["new"] * (i % 3) + near[50 + i:]), None, None, 0, "", "", 0) for i in range(30)]
    df = docs.filter("doc_id is not null").unionByName(spark.createDataFrame(more, DOCS))
    rows = {r.doc_id: (r.text or "") for r in df.collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = jaccard.link_documents(df).collect()
    assert len(got) == df.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), label[i]) for i in sets}
    assert {r.doc_id for r in jaccard.distinct_documents(df).collect()} == set(label.values())


def test_parities():
    rng = np.random.default_rng(8)
    sets = []
    for n in (1, 30, 400, 1000, 1100, 3000, 8000, 9000):
        first = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        sets += [first, first[: -(len(first) // 40) or None], np.unique(np.append(first[len(first) // 30 :], rng.integers(0, 1 << 63, n // 60).astype(np.uint64))), np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))]
    i, j = np.triu_indices(len(sets), 1)
    ok = set(jaccard._compatible(i, j, np.array([len(s) for s in sets]), jaccard._levels([jaccard._parities(s) for s in sets])).tolist())
    links = {k for k in range(len(i)) if 100 * len(np.intersect1d(sets[i[k]], sets[j[k]])) >= 90 * len(np.union1d(sets[i[k]], sets[j[k]]))}
    assert len(links) > 15 and links <= ok and len(ok) < len(links) + 8


def test_trie():
    rng = np.random.default_rng(3)
    pool = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(40)]
    pool += [p[:-1] for p in pool[:10]]
    for p in pool[:10]:
        want = {i for i, s in enumerate(pool) if 100 * len(np.intersect1d(p, s)) >= 90 * len(np.union1d(p, s))}
        assert set(jaccard.walk(p, pool)) == want


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 8)).round(1)
    v[50:100] = v[50]
    rows = [(i, v[i].tolist()) for i in range(150)] + [(200, None), (201, [float("nan")] * 8), (202, [None] * 8), (None, [1.0] * 8), (50, v[50].tolist())]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    q = np.floor(256 * v).astype(int)
    for i in (0, 50, 100):
        want = sorted((-(q[i] @ q[j]), j) for j in range(150) if j != i)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == [(j, -s) for s, j in want]
    m = rng.integers(-9, 9, (500, 4))
    rows, scores, met = topk.threshold(m[0], m, np.argsort(-m.T, axis=1, kind="stable"), 3)
    assert met < 500 and sorted(scores)[-3:] == sorted(m @ m[0])[-3:]


def test_urls(spark):
    at = lambda d: F.timestamp_seconds(F.lit(d * 86400))
    entries = spark.createDataFrame([("bad.com", "add", 1), ("bad.com", "remove", 5), ("x.org/a/", "add", 2)], "value string, action string, d int").select("value", "action", at(F.col("d")).alias("at"))
    rows = [(1, "http://www.bad.com/p", 3), (2, "http://bad.com", 5), (3, "http://x.org/a/b?q", 9), (4, "http://x.org/ab", 9), (5, None, 3), (6, "nothing", 3), (7, "http://notbad.com/", 3), (8, "http://bad.com", None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, d int").select("page_id", "url", at(F.col("d")).alias("fetched"))
    got = {r.page_id: (r.blocked, r.matched) for r in urls.evaluate(captures, entries).collect()}
    assert got == {1: (True, "bad.com"), 2: (False, None), 3: (True, "x.org/a/"), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None), 8: (False, None)}


def test_warc(spark):
    big = "é" * 1_500_000
    rows = [(1, "u", "x"), (2, "u\r\nv", "x"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (1, "u", "x"), (None, "u", "x")]
    path = scratch(spark, "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert spark.read.parquet(path).filter("chunk > 0").count() > 0
    got = sorted(((r.page_id is None, r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "x", None), (1, "x", None), (2, "x", 1), (3, "", None), (4, "", 3), (5, big, None), (6, big, 5), (None, "x", 1)]
    assert got == [((i is None, i), len(t.encode()), sha(t), "response" if to is None else "revisit", to) for i, t, to in want]


def test_html():
    model = html.train(300, 12)
    made = html.made(100, 77)
    right = np.concatenate([a == b for a, (_, b) in zip(model.label([x for x, _ in made]), made, strict=True)])
    assert right.mean() > 0.97
    leaves = html.blocks("<head><title>t</title></head><body><p>a &amp;<br>b\n <b>c</b><p>d<script>x</script><!-- y --><ul><li>e<li>f</ul>g < h")
    assert [t for _, t, _ in leaves] == ["a & b c", "d", "e", "f", "g < h"]
    assert html.blocks("") == [] and html.texts(["", "<p"], model) == ["", ""]


def test_near_duplicates_of_the_pipeline(spark):
    whole = passage(21, 400).split()
    edited = [f"edit{k}" if k % 48 == 20 else w for k, w in enumerate(whole)]
    rows = [" ".join(whole), " ".join(edited), " ".join(whole + passage(22, 60).split()), passage(23, 400)]
    for k, low, high in ((1, 80, 90), (2, 80, 90), (3, 0, 1)):
        a, b = (set(jaccard.shingle_sets(pa.array([rows[i]]), 5)[0].tolist()) for i in (0, k))
        assert low <= 100 * len(a & b) / len(a | b) < high
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in jaccard.distinct_documents(df).collect()} == {0, 3}
    assert {r.component_id for r in jaccard.link_documents(df, 3, 90).collect()} == {0, 1, 2, 3}
    assert (jaccard.postings_enough(90), jaccard.postings_enough(80), jaccard.postings_enough(40)) == (32, 57, None)
    rng, sketch = np.random.default_rng(5), np.zeros(jaccard.SKETCH, np.uint32)
    for n in (1, 4, 50, 270, 280, 700, 3000):
        first = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        second = np.unique(np.append(first[np.arange(len(first)) % 10 != 9], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)))
        linked = 100 * len(np.intersect1d(first, second)) >= 80 * len(np.union1d(first, second))
        assert linked and len(np.intersect1d(jaccard.prefix(first, sketch, 80), jaccard.prefix(second, sketch, 80)))
        assert list(jaccard.walk(first, [second], 80)) == [0]


def test_null_ids_in_the_pipeline(spark):
    import corpus_pipeline

    made = [passage(40 + i, 60) for i in range(9)]
    rows = [(None, made[0], "s1"), (None, made[0], "s1"), (None, made[0] + " end", "s1"), (None, made[1], None), (None, made[2], "s1"), (7, made[3], "s1"), (7, made[4], "s1"), (8, made[5], "s2"), (None, made[5], "s2"), (9, made[6], None)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = lambda d: sorted((r.doc_id or -1, r.text) for r in d.collect())
    got = pairs(jaccard.distinct_documents(df))
    first = [t for i, t in got if t.startswith(made[0])]
    assert len(first) == 1 and got == sorted([(-1, first[0]), (-1, made[1]), (-1, made[2]), (7, made[3]), (7, made[4]), (8, made[5]), (9, made[6])])
    empty = spark.createDataFrame([(None, None), (None, " "), (None, " "), (3, ""), (3, ""), (3, " "), (4, "")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text or "") for r in jaccard.distinct_documents(empty).collect()) == [(-1, ""), (-1, " "), (-1, " "), (3, ""), (3, " "), (4, "")]
    one = df.withColumn("source", F.lit("s"))
    assert pairs(mixing.mixed(one)) == sorted((i or -1, t) for i, t, _ in rows)  # one source: each row once
    taken = {r.size: r.n for r in mixing.mix_documents(df).groupBy("size").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("n")).collect()}
    assert taken == {r.size: r.n for r in mixing.mixed(df).groupBy(F.size(F.split("text", " ")).alias("size")).agg(F.count("*").alias("n")).collect()}
    docs = one
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").checkpoint()
    assert sorted(r.doc_id or -1 for r in docs.collect()) == [-1, -1, -1, 7, 7, 8, 9]


def test_token_ids_of_the_pipeline(spark, docs):
    import corpus_pipeline

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    assert all(got[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts()))
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.encode_documents(docs, decoded=True).collect() if r.doc_id is not None} == {i: t or "" for i, t in enumerate(texts())}


@pytest.mark.parametrize("shards", [1, 3, 80])
def test_null_ids_in_token_shards(spark, monkeypatch, shards):
    rows = [(i if i % 10 else None, f"w{i} " * (i % 7)) for i in range(240)]
    monkeypatch.setattr(tokens, "SHARD", 240 // shards)
    path = scratch(spark, "t")
    tokens.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert (spark.read.parquet(f"{path}/images").select("shard").distinct().count() > shards // 2) and len(got := sorted(tokens.read_shards(spark, path).collect(), key=lambda r: r.start)) == 240
    ids = [r.doc_id for r in got]
    assert ids[:216] == sorted(i for i, _ in rows if i is not None) and ids[216:] == [None] * 24
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(240)]
