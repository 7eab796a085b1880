"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns whose names clash with its own."""

from __future__ import annotations

import base64
import gzip
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.llm import classifier, curriculum, decontaminate, link_graph, ngram_join, quality_rules, suffix_array, token_counts, toxicity, warc_zip
from siltbed.llm.scratch import Scratch
from siltbed.llm.text import word_list, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, position string, start int, token string, bucket int, size int"
WORDS = [a + b for a in "ka lo mi ru te sa po vi ne du".split() for b in "ran tel mos pik sun bar fel gor".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(out))


def rows(texts):
    """Rows of SCHEMA; an item is a text, or (id, text)."""
    made = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        made.append((i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"s{k % 3}", len(t) if t else None, 1.0, "x", 1, "t", 2, 3))
    return made


ODD = [None, "", "   ", "a", (None, "null id here"), (None, None), prose(1, 9000), prose(2, 40), (2, prose(2, 40)), (7, prose(2, 40)), "\U0001f600 émoji İstanbul ẞ", "x" * 70_000, "\n\n", "of " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + [prose(k, 60 + k) for k in range(20, 60)]
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 != 0), int(k % 4 == 0)) for k in range(14, 54)] + [(20, 0, 1), (None, 1, 1), (21, None, None)], "doc_id long, quality int, toxic int")


def test_words_match_their_spelling():
    texts = [t if not isinstance(t, tuple) else t[1] for t in ODD]
    w = words(texts)
    for k, t in enumerate(texts):
        lo, hi = w.offsets[k], w.offsets[k + 1]
        assert hi - lo == len(word_list(t))
        if hi > lo:
            assert word_list(t[w.begin[lo] : w.end[lo]]) == word_list(t)[:1]
    one = words(["Hello world", "hello", "WORLD"])
    assert one.hashes[0] == one.hashes[2] and one.hashes[1] == one.hashes[3]


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_binomial_tail_is_exact():
    from math import comb

    assert quality_rules.binomial_tail(3, 20, 0.1) == pytest.approx(sum(comb(20, k) * 0.1**k * 0.9 ** (20 - k) for k in range(4)))
    assert quality_rules.binomial_tail(5, 5, 0.3) == 1.0


def test_order_statistics_against_sorting(spark):
    r = np.random.default_rng(4)
    values = {("en", "a"): r.normal(0, 1, 5000), ("en", "b"): np.zeros(700), ("?", "a"): r.integers(0, 4, 900) / 4.0}
    d = spark.createDataFrame([(*k, float(v)) for k, own in values.items() for v in own], "stratum string, signal string, v double")
    got = defaultdict(dict)
    for x in quality_rules.order_statistics(d).collect():
        assert x.n == len(values[x.stratum, x.signal])
        got[x.stratum, x.signal] |= {rank: x.v for rank in range(x.before + 1, x.upto + 1)}
    for k, own in values.items():
        assert [got[k][n] for n in range(1, len(own) + 1)] == sorted(own)


def test_quality_rules(spark, docs, empty, labels):
    assert quality_rules.accepted(docs, labels).count() == docs.count()  # too few labels certify nothing
    assert quality_rules.accepted(empty, labels).count() == 0
    texts = [prose(k, 50) if k % 4 else "%%% ### !!! " * 40 for k in range(1600)]
    d = spark.createDataFrame(rows(texts), SCHEMA).withColumn("lang", F.lit("en"))
    lab = d.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in quality_rules.accepted(d, lab).collect()}
    good = {k for k in range(1600) if k % 4}
    assert len(kept & good) >= 0.95 * len(good) and not kept - good


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_encoding_whole_texts(spark, docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in docs.collect()] + ["a b  c\x1cd  \n e", "it's   we'll\t\tx"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(d).collect()}
    assert got == {k: len(whole.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}
    counted = token_counts.token_counts(docs).collect()
    assert len(counted) == docs.count() and sum(r.doc_id is None for r in counted) == 2
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_of_a_token_that_every_document_holds(spark):
    n = 5000
    d = spark.createDataFrame([(k, f"the the {k}") for k in range(n)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_pre_tokens) for r in token_counts.token_counts(d.repartition(3)).collect()}
    assert len(got) == n and all(got[k][1] == 3 for k in got)
    assert all(got[k][0] == 2 + len(token_counts.encoder(token_counts.VOCABULARY).encode_ordinary(f" {k}")) for k in range(0, n, 50))
    many = np.array([1, 8, 9, 5000, 5000])
    places = {tuple(token_counts.salts(c, many)) for c in range(4000)}
    assert len({p[0] for p in places}) == len({p[1] for p in places}) == 1 and len({p[2] for p in places}) == 2 and len({p[3] for p in places}) > 500


# --- 3, 4 ----------------------------------------------------------------------------------------------------------


def test_classifier_learns_and_handles_odd_rows(spark, docs, empty, labels):
    junk = lambda k: (WORDS[k % 80].upper() + "!! ") * 60
    texts = [prose(k, 80) if k % 3 else junk(k) for k in range(300)]
    d = spark.createDataFrame(rows(texts), SCHEMA)
    lab = d.where("doc_id < 150").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in classifier.good_documents(d, lab).collect()}
    held = range(150, 300)
    assert sum((k in kept) == bool(k % 3) for k in held) >= 0.97 * len(held)
    assert {r.doc_id for r in classifier.scored(d, lab).collect()} == kept
    out = classifier.good_documents(docs, labels)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert classifier.good_documents(empty, labels).count() == 0
    assert classifier.good_documents(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_finds_sentences(spark, docs, empty, labels):
    bad = ["vilx", "grusk", "morb"]

    def text(k):
        s = [prose(1000 * k + j, 12) for j in range(6)]
        if k % 3 == 0:
            s[k % 6] = f"{prose(k, 4)} {bad[k % 3]} {bad[(k // 3) % 3]} {prose(k + 1, 3)}"
        return ". ".join(s) + "."

    d = spark.createDataFrame(rows([text(k) for k in range(400)]), SCHEMA)
    lab = d.where("doc_id < 200").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = {r.doc_id: r for r in toxicity.toxic_documents(d, lab).collect()}
    held = range(200, 400)
    assert sum((k in got) == (k % 3 == 0) for k in held) >= 0.97 * len(held)
    hits = [any(w in s.text for s in got[k].sentences for w in bad) for k in held if k in got and k % 3 == 0]
    assert np.mean(hits) > 0.95
    full = text(201)
    assert all(text(k)[s.start : s.end] == s.text for k in list(got)[:20] for s in got[k].sentences) and full
    assert toxicity.toxic_documents(empty, labels).count() == 0
    assert toxicity.toxic_documents(docs, labels.limit(0)).count() == 0
    toxicity.toxic_documents(docs, labels).collect()


def _bags(texts, labels):
    out = []
    for t, y in zip(texts, labels):
        b = toxicity.Bags([t])
        out.append((b.features, np.cumsum(np.isin(np.arange(len(b.owner)), b.first)) - 1, y))
    return out


def test_toxicity_gradient_by_finite_differences():
    texts = [prose(k, 25) for k in range(6)] + ["", "one."]
    data = toxicity.Sample(_bags(texts, [0, 1, 0, 1, 1, 0, 0, 1]))
    r = np.random.default_rng(0)
    w, b = r.normal(0, 0.3, len(data.used)), -1.0
    gw, gb = data.gradient(w, b)
    for k in r.choice(len(w), 12, replace=False):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert gw[k] == pytest.approx((data.loss(w + step, b) - data.loss(w - step, b)) / 2e-5, abs=1e-7)
    assert gb == pytest.approx((data.loss(w, b + 1e-5) - data.loss(w, b - 1e-5)) / 2e-5, abs=1e-7)


def test_toxicity_scores_against_a_loop():
    texts = [prose(k, 40) for k in range(5)] + [None, "", "...", "a! b? c"]
    r = np.random.default_rng(1)
    weights = r.normal(0, 1, 1 << toxicity.BITS)
    p, whole = toxicity.Bags(texts).score(weights, -2.0)
    at = 0
    for k, t in enumerate(texts):
        none = 1.0
        for sentence in (x for x in re.split(r"[.!?\n\r…。！？]", t or "") if word_list(x)):
            features = toxicity.Bags([sentence]).features
            one = 1 / (1 + np.exp(2.0 - weights[features].sum()))
            assert p[at] == pytest.approx(one)
            none *= 1 - one
            at += 1
        assert whole[k] == pytest.approx(1 - none)
    assert at == len(p)


def _held_out(spark, column, table="sf0.1"):
    """(documents, labels that train, truth of the others by id)."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    lab = spark.read.parquet(f"/root/testdata/{table}/labels.parquet").where(f"doc_id is not null and {column} is not null")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    return docs.join(lab.select("doc_id"), "doc_id", "left_semi"), lab.where(half), {r.doc_id: r[column] for r in lab.where(~half).collect()}


def test_toxicity_finds_held_out_documents(spark):
    docs, lab, truth = _held_out(spark, "toxic")
    got = {r.doc_id for r in toxicity.toxic_documents(docs, lab).select("doc_id").collect()}
    toxic, clean = {k for k, y in truth.items() if y == 1}, {k for k, y in truth.items() if y == 0}
    assert len(got & toxic) >= 0.8 * len(toxic) and len(got & clean) <= 0.04 * len(clean)


def test_classifier_is_trained_on_all_labels(spark, monkeypatch):
    """Over 1,000 of each label: all are in the shards, and what few shards know is learned by all."""
    kinds = [lambda k: prose(k, 30), lambda k: (WORDS[k % 80].upper() + "!! ") * 20, lambda k: "%# " * 30 + prose(k, 8)]
    d = spark.createDataFrame(rows([kinds[0](k) if k % 2 else kinds[1 + (k % 12 == 0)](k) for k in range(2400)]), SCHEMA)
    lab = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(classifier, "SHARD", 300)
    shards = classifier.labelled(d, lab, Scratch(spark, "t")).collect()
    assert sum(r.good for r in shards) == sum(r.bad for r in shards) == 1200 and {r.shard for r in shards} == set(range(8))
    kept = {r.doc_id for r in classifier.scored(d, lab).collect()}
    assert sum((k in kept) == bool(k % 2) for k in range(2400)) >= 0.98 * 2400


def test_classifier_gradient_by_finite_differences():
    r = np.random.default_rng(0)
    bag, y = np.repeat(np.arange(6), [1, 2, 3, 1, 4, 2]), np.array([0, 1, 0, 1, 1, 0], float)
    x = r.normal(0, 1, (len(bag), 7))
    m = {"W": r.normal(0, 0.5, (7, 4)), "b": r.normal(0, 0.5, 4), "V": r.normal(0, 0.5, (4, 3)), "U": r.normal(0, 0.5, (4, 3)), "w": r.normal(0, 0.5, 3), "c": r.normal(0, 0.5, 4), "c0": np.zeros(1), "mean": 0.0, "scale": 1.0}
    balance = np.full(6, 1 / 6)

    def loss(m):
        s = classifier.forward(m, x, bag, 6)["score"]
        return -(balance * np.where(y == 1, np.log(s), np.log(1 - s))).sum()

    for name, g in classifier.gradients(m, x, bag, y, balance).items():
        for at in list(np.ndindex(m[name].shape))[:10]:
            up, down = ({**m, name: m[name].copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_classifier_scores_against_a_loop():
    texts = [prose(k, 150) for k in range(4)] + [None, "", "x" * 2000]
    r = np.random.default_rng(2)
    n = classifier.SIZE
    m = {"W": r.normal(0, 0.1, (n, 4)), "b": r.normal(0, 0.5, 4), "V": r.normal(0, 0.5, (4, 3)), "U": r.normal(0, 0.5, (4, 3)), "w": r.normal(0, 0.5, 3), "c": r.normal(0, 0.5, 4), "c0": np.zeros(1), "mean": np.zeros(n), "scale": np.ones(n)}
    got = classifier._scores(m, texts)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for k, t in enumerate(texts):
        x, _ = classifier.encode([t])
        assert len(x) == max(1, -(-len(t or "") // classifier.PASSAGE))
        h = [np.tanh(row @ m["W"] + m["b"]) for row in x]
        e = np.array([(np.tanh(v @ m["V"]) * sig(v @ m["U"])) @ m["w"] for v in h])
        a = np.exp(e) / np.exp(e).sum()
        assert got[k] == pytest.approx(sig(sum(p * v for p, v in zip(a, h)) @ m["c"] + m["c0"][0]), abs=1e-5)


def test_classifier_accepts_held_out_documents(spark):
    docs, lab, truth = _held_out(spark, "quality")
    kept = {r.doc_id for r in classifier.scored(docs, lab).collect()}
    good, bad = {k for k, y in truth.items() if y == 1}, {k for k, y in truth.items() if y == 0}
    assert len(kept & good) >= 0.97 * len(good) and len(kept & bad) <= 0.3 * len(bad)


# --- 5 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("index", [False, True])
def test_warc_round_trip(spark, tmp_path, zip64, index):
    data = [(1, "http://a/é?x=1#y %41 b", "<p>\r\n\r\nWARC/1.1</p>"), (2, None, "x"), (None, "http://b/", None), (4, "", ""), (4, "", ""), (5, "http://c/", "long " * 200_000), (2**60 + 1, "http://d\n/", "é \U0001f600")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("path", F.lit(1))
    made = warc_zip.write_packages(pages.repartition(2), f"file://{tmp_path}", zip64, index)
    paths = [(r.path,) for r in made.collect()]
    for (p,) in paths:
        with zipfile.ZipFile(p.removeprefix("file://")) as z:  # another reader agrees on the format
            assert z.testzip() is None and "archive/data.warc.gz" in z.namelist()
            assert gzip.decompress(z.read("archive/data.warc.gz")).startswith(b"WARC/1.1")
    got = warc_zip.read_packages(spark.createDataFrame(paths, "path string")).collect()
    assert Counter(map(tuple, got)) == Counter(data)


def _warc(kind, url, block, mime, **more):
    head = [b"WARC/1.0", b"warc-type: " + kind, b"content-LENGTH: %d" % len(block)] + ([b"WARC-Target-URI: " + url] if url else []) + [b"Content-Type: " + mime]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")


@pytest.mark.parametrize("listed", [0, 2, 5])
def test_warc_packages_of_other_tools(spark, tmp_path, listed):
    """Two archives of one base name, an index that lists some records, and records that hold no page."""
    body = "<p>é</p>".encode("latin-1")
    chunked = b"%x\r\n%s\r\n3;x=1\r\nabc\r\n0\r\n\r\n" % (len(body), body)
    records = [
        _warc(b"warcinfo", b"", b"software: x", b"application/warc-fields"),
        _warc(b"request", b"http://a/", b"GET / HTTP/1.1\r\n\r\n", b"application/http; msgtype=request"),
        _warc(b"response", b"http://a/%20x", b"HTTP/1.1 200 OK\r\nCONTENT-type: text/html; charset=iso-8859-1\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, b"application/http; msgtype=response"),
        _warc(b"response", b"<http://b/>", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress("ü".encode()), b"application/http"),
        _warc(b"resource", b"http://c/", b"\xff plain", b"text/plain"),
    ]
    lines, at = [], 0
    for k, r in enumerate(records):
        if k >= len(records) - listed:
            lines.append(f"x 2020 {{\"offset\": \"{at}\", \"length\": \"{len(r)}\", \"filename\": \"a/data.warc.gz\"}}\n")
        at += len(r)
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        for folder in "ab":
            z.writestr(f"archive/{folder}/data.warc.gz", b"".join(records))
        z.writestr("indexes/index.cdx.gz", gzip.compress("".join(lines).encode()))
    got = warc_zip.read_packages(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")).collect()
    want = [(None, "http://a/%20x", "<p>é</p>abc"), (None, "http://b/", "ü"), (None, "http://c/", "\ufffd plain")]
    assert Counter(map(tuple, got)) == Counter(want * 2)


def test_warc_empty_and_compressed(spark, tmp_path):
    assert warc_zip.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 1000)
    with pytest.raises(Exception, match="compressed"):
        warc_zip.read_packages(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")).collect()


# --- 6 -------------------------------------------------------------------------------------------------------------


def test_curriculum_follows_its_schedule(spark, docs, empty):
    texts = [prose(k, 30) for k in range(900)]
    d = spark.createDataFrame(rows(texts), SCHEMA)
    plan = [("s0", 0.0, 1.0), ("s1", 0.0, 0.0), ("s0", 0.5, 0.5), ("s1", 0.5, 0.5), ("s0", 1.0, 0.0), ("s1", 1.0, 1.0)]
    out = curriculum.curriculum(d, spark.createDataFrame(plan, "source string, t double, weight double"), budget_tokens=9000.0)
    got = out.collect()
    assert out.columns == [c for c in SCHEMA_NAMES if c != "position"] + ["n_tokens", "epoch", "position"]
    assert {r.source for r in got} == {"s0", "s1"} and all(0 <= r.position < 1 for r in got)
    early = Counter(r.source for r in got if r.position < 0.25)
    assert early["s0"] / sum(early.values()) == pytest.approx(0.875, abs=0.05)
    assert sum(r.n_tokens for r in got) == pytest.approx(9000, rel=0.02)
    parts = out.withColumn("_p", F.spark_partition_id()).groupBy("_p").agg(F.min("position").alias("a"), F.max("position").alias("b")).orderBy("_p").collect()
    assert all(x.b <= y.a for x, y in zip(parts, parts[1:]))
    odd = curriculum.curriculum(docs).collect()
    assert Counter(r.epoch for r in odd)[0] > 0
    assert curriculum.curriculum(empty).count() == 0


def test_curriculum_meets_the_demand_of_small_sources(spark):
    texts = [(k, prose(k, 50), f"s{k % 20}") for k in range(400)] + [(400, "two tokens", None)]
    d = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = curriculum.curriculum(d).collect()
    small = sorted((r.epoch, r.position) for r in got if r.source is None)
    assert [e for e, _ in small] == list(range(12))  # 0.01 % of the tokens wants 11.7 epochs
    assert [p for _, p in small] == sorted(p for _, p in small) and small[-1][1] > 0.9
    assert sum(r.n_tokens for r in got) == pytest.approx(20_002, abs=20 * 50)
    plan = spark.createDataFrame([(None, 0.0, 1.0), (None, 1.0, 1.0)], "source string, t double, weight double")
    for budget in (20_000.0, 2.0 * curriculum.EPOCHS):
        rows = curriculum.curriculum(d, plan, budget_tokens=budget).collect()
        assert sorted(r.epoch for r in rows) == list(range(int(budget) // 2)) and {r.source for r in rows} == {None}
    assert max(r.epoch for r in curriculum.curriculum(d, plan, max_epochs=3).collect()) == 2


def test_curriculum_takes_knots_of_each_source(spark):
    d = spark.createDataFrame([(k, prose(k, 20), "abc"[k % 3]) for k in range(600)], "doc_id long, text string, source string")

    def shares(plan):
        out = curriculum.curriculum(d, spark.createDataFrame(plan, "source string, t double, weight double"), budget_tokens=12_000.0).collect()
        n = Counter()
        for r in out:
            n[r.source] += r.n_tokens
        return {k: v / 12_000 for k, v in n.items()}

    b = [("b", 0.0, 0.0), ("b", 0.5, 1.0), ("b", 1.0, 1.0)]
    assert shares([("a", 0.0, 1.0), ("a", 1.0, 1.0), *b]) == pytest.approx({"a": 0.625, "b": 0.375}, abs=0.01)
    assert shares([("a", 0.0, 0.5), ("a", 1.0, 0.5), ("b", 0.0, 0.0), ("b", 0.25, 0.5), ("b", 1.0, 0.5), ("c", 0.25, 1.0)]) == pytest.approx({"a": 0.25 * (1 / 3 + 1 / 4) / 2 + 0.75 / 4, "b": 0.25 * (1 / 4) / 2 + 0.75 / 4, "c": 0.25 * (2 / 3 + 1 / 2) / 2 + 0.75 / 2}, abs=0.01)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


# --- 7 -------------------------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, docs, empty):
    items = [(k, prose(5000 + k, 8 + 4 * k)) for k in range(12)] + [(50, None), (51, ""), (52, "a"), (None, "null item text of some words"), (60, prose(5003, 20))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    texts = {}
    for k in range(80):
        t = prose(7000 + k, 50)
        if k % 4 == 0:
            leak = word_list(items[k % 12][1])
            leak = leak[: max(5, len(leak) * (k % 3 + 1) // 3)]
            t = t[:60] + "! " + ",  ".join(w.upper() for w in leak) + "\n" + t[60:]
        texts[k] = t
    d = spark.createDataFrame(rows(list(texts.values())), SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_passages(d, bench).collect()}
    want = set()
    for i, t in items:
        w = word_list(t)
        if w:
            grams = {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
            for k, text in texts.items():
                x = word_list(text)
                if any(tuple(x[j : j + len(g)]) == g for g in grams for j in range(len(x))):
                    want.add((k, i))
    assert got == want and want
    for r in decontaminate.contaminated_passages(d, bench).collect():
        assert texts[r.doc_id][r.start : r.end] == r.passage
    clean = decontaminate.clean_documents(d, bench, min_words=5)
    assert {r.doc_id for r in clean.collect()} == set(texts) - {k for k, _ in want} and clean.columns == d.columns
    assert decontaminate.clean_documents(docs, bench, min_words=5).count() == docs.count()
    assert decontaminate.clean_documents(docs, bench.limit(0), min_words=1).count() == docs.count()
    assert decontaminate.clean_documents(empty, bench, min_words=5).count() == 0


def test_stages_find_the_text_whatever_its_name_or_type(spark):
    d = spark.createDataFrame([(1, "x", 12345), (2, "y", None)], "doc_id long, TEXT string, N_Chars int").select("doc_id", F.col("N_Chars").alias("Text"), F.col("TEXT").alias("other"))
    bench = spark.createDataFrame([(1, "12345")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.doc_id for r in decontaminate.clean_documents(d, bench, min_words=1).collect()] == [2]
    assert classifier.good_documents(d, none).schema == d.schema and classifier.good_documents(d, none).count() == 2
    assert {(r.doc_id, r.Text) for r in suffix_array.without_repeats(d, 2).collect()} == {(1, 12345), (2, None)}


def test_decontamination_takes_items_without_an_id(spark):
    items = [(None, prose(1, 20)), (None, prose(2, 7)), (1, prose(3, 20)), (2, prose(1, 20)), (None, None), (None, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(k + 50, 20) + " " + x for k, x in enumerate((prose(1, 20), prose(2, 7), prose(3, 20), "a", ""))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated_passages(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, None), (0, 2), (1, None), (2, 1), (3, None)}
    assert all(texts[r.doc_id][r.start : r.end] == r.passage for r in got)
    assert {r.doc_id for r in decontaminate.clean_documents(d, bench, min_words=5).collect()} == {3, 4}
    assert {r.doc_id for r in decontaminate.clean_documents(d, bench, min_words=1).collect()} == {4}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_passages(d, bench, min_words=5).collect()} == {(0, None), (0, 2), (1, None), (2, 1)}


# --- 8 -------------------------------------------------------------------------------------------------------------


def near_texts():
    out = {}
    for k in range(60):
        base = prose(k // 4, 40 + k // 4).split()
        r = random.Random(k)
        for _ in range(k % 4 * 2):
            base[r.randrange(len(base))] = r.choice(WORDS)
        out[k] = " ".join(base)
    return out | {100: "", 101: None, 102: "one", 103: "One!", 104: "two words", 105: prose(3, 43), 106: prose(3, 43)}


def brute_near(texts, n=3, t=0.6):
    sets = {}
    for i, x in texts.items():
        w = word_list(x)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(i for i in sets if sets[i])
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_near_copies_against_brute_force(spark, docs, empty):
    texts = near_texts()
    d = spark.createDataFrame(rows(list(texts.items()) + [(5, texts[5]), (None, texts[5])]), SCHEMA)
    pairs = ngram_join.near_copies(d).collect()
    got = {(r.doc_id, r.other_id): r.jaccard for r in pairs}
    assert len(got) == len(pairs)
    want = brute_near(texts)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    left = ngram_join.without_near_copies(d)
    assert Counter(r.doc_id for r in left.collect()) == Counter([i for i in texts if find(i) == i] + [5] * (find(5) == 5))
    assert left.columns == d.columns
    assert ngram_join.near_copies(empty).count() == 0 and ngram_join.without_near_copies(empty).count() == 0
    ngram_join.near_copies(docs).collect()


@pytest.mark.parametrize("cell", [3, 100_000])
def test_near_copies_of_large_clusters(spark, monkeypatch, cell):
    """A cluster that is a grid of cells gives what one that is compared in one place gives."""
    monkeypatch.setattr(ngram_join, "CELL_POSTINGS", cell)
    base, texts = prose(5, 60).split(), {}
    for k in range(90):
        r, t = random.Random(k // 2), list(base)
        for _ in range(k % 9):
            t[r.randrange(len(t))] = r.choice(WORDS)
        texts[k] = " ".join(t)
    d = spark.createDataFrame(rows(list(texts.items())), SCHEMA)
    assert {(r.doc_id, r.other_id): pytest.approx(r.jaccard) for r in ngram_join.near_copies(d).collect()} == brute_near(texts)


def brute_links(pairs):
    """(class, number of links) of each id that a pair has."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(near):
        if i not in out:
            reached, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - reached
                reached |= new
                todo += new
            out |= {x: (i, len(near[x])) for x in reached}
    return out


@pytest.mark.parametrize("cell", [3, 100_000])
def test_links_are_counted_without_a_row_for_each_pair(spark, monkeypatch, cell):
    """Rows are as many as documents, however large the cluster; every link between different texts counts once."""
    monkeypatch.setattr(ngram_join, "CELL_POSTINGS", cell)
    monkeypatch.setattr(ngram_join, "EXPAND", 50 if cell == 3 else 1_000_000)
    base, texts = prose(5, 60).split(), near_texts()
    for k in range(200, 290):
        r, t = random.Random(k // 2), list(base)
        for _ in range(k % 9):
            t[r.randrange(len(t))] = r.choice(WORDS)
        texts[k] = " ".join(t)
    d = spark.createDataFrame(rows([*texts.items(), (5, texts[5]), (None, texts[5])]), SCHEMA)
    want = brute_near(texts)
    got = ngram_join.linked_documents(d).collect()
    assert len(got) == len({r.doc_id for r in got}) < len(want)
    assert {r.doc_id: (r.class_id, r.links) for r in got} == brute_links(want)


def test_links_of_ids_with_several_texts(spark, empty):
    texts = [prose(k, 40) for k in range(6)]
    some = [(1, 0), (1, 1), (2, 1), (2, 0), (3, 1), (4, 2), (4, 3), (5, 3), (6, 2), (6, 3), (7, 4), (7, 4), (8, 5), (None, 4)]
    d = spark.createDataFrame(rows([(i, texts[k]) for i, k in some] + [(1, texts[0] + " more"), (9, texts[5] + " more"), (9, texts[5] + " less"), (10, texts[5])]), SCHEMA)
    pairs = {(r.doc_id, r.other_id) for r in ngram_join.near_copies(d).collect()}
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.linked_documents(d).collect()} == brute_links(pairs)
    assert {(1, 2), (4, 6), (8, 9), (9, 10)} < pairs
    assert ngram_join.linked_documents(empty).count() == 0


def test_near_copies_among_rows_that_share_an_id(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    d = spark.createDataFrame(rows([(1, a), (1, b), (2, b), (3, c), (3, c), (None, a), (None, prose(4, 40)), (None, None)]), SCHEMA)
    assert [tuple(r) for r in ngram_join.near_copies(d).collect()] == [(1, 2, 1.0)]
    left = Counter((r.doc_id, r.text) for r in ngram_join.without_near_copies(d).collect())
    assert left == Counter([(1, a), (1, b), (3, c), (3, c), (None, prose(4, 40)), (None, None)])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(edges, Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# --- 9 -------------------------------------------------------------------------------------------------------------


def repeating_texts():
    shared = [prose(900 + k, 55 + 5 * k) for k in range(4)]
    out = {k: prose(k, 30) + " " + shared[k % 4] + " " + prose(k + 300, 25) for k in range(10)}
    out |= {20: prose(20, 200), 21: prose(901, 30), 22: None, 23: "", 24: "of " * 130, 25: out[3], 26: shared[0].upper(), 27: prose(77, 60) + " " + prose(77, 60)}
    return out


def brute_repeats(texts, n=50):
    lists = {i: word_list(t) for i, t in texts.items()}
    count = Counter(tuple(w[k : k + n]) for w in lists.values() for k in range(len(w) - n + 1))
    out = {}
    for i, w in lists.items():
        mask = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                mask[k : k + n] = True
        if mask.any():
            out[i] = mask
    return out


@pytest.mark.parametrize("filtered", [True, False])
def test_repeated_passages_against_brute_force(spark, docs, empty, filtered):
    texts = repeating_texts()
    d = spark.createDataFrame(rows(list(texts.items())), SCHEMA)
    got = defaultdict(lambda: None)
    spans = suffix_array.repeated_passages(d, filtered=filtered).collect()
    for r in spans:
        w = words([texts[r.doc_id]])
        mask = got[r.doc_id] if got[r.doc_id] is not None else np.zeros(len(w.begin), bool)
        mask[(w.begin >= r.start) & (w.end <= r.end)] = True
        got[r.doc_id] = mask
    want = brute_repeats(texts)
    assert got.keys() == want.keys()
    assert all((got[k] == want[k]).all() for k in want)
    assert {r.is_copy for r in spans} == {True, False}
    if not filtered:
        return
    left = suffix_array.without_repeats(d)
    kept = {r.doc_id: r for r in left.collect()}
    assert left.columns == d.columns and kept[20].text == texts[20] and kept[22].text is None
    after = Counter(tuple(w[k : k + 50]) for w in (word_list(r.text) for r in kept.values()) for k in range(len(w) - 49))
    before = {g for t in texts.values() for w in [word_list(t)] for g in (tuple(w[k : k + 50]) for k in range(len(w) - 49))}
    assert max(after.values()) == 1 and len(before & set(after)) > 0
    assert all(r.n_chars == len(r.text) for r in kept.values() if r.text)
    assert suffix_array.repeated_passages(empty).count() == 0 and suffix_array.without_repeats(empty).count() == 0
    again = suffix_array.without_repeats(docs)
    assert {r.doc_id for r in again.where("text is null").collect()} >= {0}


def test_sorts_have_parts_by_what_is_sorted(spark, monkeypatch):
    """The rows that a sort sends don't follow the session's partitions, and are the rows of a few batches."""
    made = Counter()
    assert suffix_array.sort_parts(40, 51, 6) == 20 and suffix_array.sort_parts(480, 600, 6) == 240
    assert suffix_array.sort_parts(1, 4, 6) == 8 and suffix_array.sort_parts(10_000, 600, 6) == 1200
    at, block = np.arange(60), np.repeat(np.arange(6), 10)
    for batch in suffix_array._named(3, block, at, at, 60):
        made["batches"] += 1
        made["rows"] += batch.num_rows
    assert made == {"batches": 1, "rows": 7}
    parts, texts = [], repeating_texts()
    init = suffix_array.Sorter.__init__
    monkeypatch.setattr(suffix_array.Sorter, "__init__", lambda self, scratch, n: (init(self, scratch, n), parts.append(self.parts))[0])
    monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        found = suffix_array.repeated_passages(spark.createDataFrame(rows(list(texts.items())), SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id for r in found} == brute_repeats(texts).keys() and max(parts) <= 20


def test_a_common_pair_of_words_is_cut_into_parts(spark):
    """What begins with a common pair of words, as a share of any text does, isn't one part's; a batch has few blocks."""
    r = np.random.default_rng(1)
    toks = np.stack([np.full(4000, 1), np.full(4000, 2), r.integers(10, 10_000, 4000)], 1).astype(np.uint64).ravel()
    row = {"block": 0, "toks": suffix_array.pack(np.append(toks, np.uint64(1 << 63))), "ends": suffix_array.pack(np.array([len(toks) + 1]), True)}
    blocks = spark.createDataFrame([tuple(row.values())], "block long, toks binary, ends binary")
    cuts = suffix_array.Sorter(Scratch(spark, "cuts"), 20).splitters(blocks, suffix_array._lead, suffix_array.LEAD_WORDS)
    _, keys = suffix_array._lead(row)
    sizes = np.diff([0, *suffix_array._split(keys, cuts), len(keys[0])])
    assert sizes.sum() == len(toks) + 1 and sizes.max() < 0.1 * len(toks)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with suffix_array.few_rows(spark):
        assert int(spark.conf.get(name)) == suffix_array.BATCH_BLOCKS
    assert spark.conf.get(name) == before


def test_merge_orders_all_suffixes():
    r = np.random.default_rng(0)
    for _ in range(200):
        toks, ends, n = [], [], 0
        for s in range(r.integers(1, 4)):
            part = r.integers(1, 3, r.integers(1, 14)).astype(np.uint64)
            toks += [part, np.array([1000 + s], np.uint64)]
            n += len(part) + 1
            ends.append(n)
        lay = suffix_array.Layout(np.concatenate(toks), np.array(ends))
        truth = sorted(range(n), key=lambda i: list(lay.toks[i : i + lay.left[i]]))  # noqa: B023
        rank = np.empty(n, np.int64)
        rank[truth] = np.arange(n)
        at = lay.sampled()
        ranks = np.zeros(n, np.uint64)
        ranks[at[np.argsort(rank[at])]] = np.arange(1, len(at) + 1)
        order, keys = suffix_array._merge_keys({"toks": suffix_array.pack(lay.toks), "ends": suffix_array.pack(lay.ends, True), "ranks": suffix_array.pack(ranks)}, None)
        assert list(order[suffix_array._merge_order(keys)]) == truth


# --- 10 ------------------------------------------------------------------------------------------------------------


def test_link_graph_against_power_iteration(spark):
    r = random.Random(3)
    hosts = [f"h{k}.example" for k in range(12)]
    pages = []
    for k in range(60):
        src = hosts[k % 9]
        links = " ".join(f"<a href='http://{r.choice(hosts)}/x'>" for _ in range(r.randrange(4)))
        pages.append((k, f"http://{src}/{k}", f"<a href=\"/rel\">{links}<a href=//{hosts[11]}/>" if k == 5 else links))
    odd = [(100, None, None), (101, "", ""), (102, "not a url", "<a href='http://h1.example/'>"), (0, pages[0][1], pages[0][2])]
    d = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("trust", F.lit(2))
    seeds = lambda *names: link_graph.seed_table(spark, names)
    got = link_graph.judged_pages(d, seeds("h0.example"), seeds("h8.example", "h8.example")).collect()
    assert len(got) == len(pages) + len(odd) and all(x.keep for x in got if x.host is None)
    weight = defaultdict(set)
    for _, url, html in pages:
        src = re.search("//([^/]+)", url)[1]
        for q in re.findall(r"href=['\"]?(?:http:)?//([^/'\"> ]+)", html):
            if q != src:
                weight[src, q].add(url)
    names = sorted({re.search("//([^/]+)", p[1])[1] for p in pages} | {b for _, b in weight})
    ix = {h: k for k, h in enumerate(names)}

    def rank(seed, flip):
        m = np.zeros((len(names), len(names)))
        for (a, b), urls in weight.items():
            m[(ix[b], ix[a]) if flip else (ix[a], ix[b])] = len(urls)
        s = np.zeros(len(names))
        s[ix[seed]] = 1
        out, x = m.sum(1), s.copy()
        for _ in range(300):
            x = 0.15 * s + 0.85 * ((x[out > 0] / out[out > 0]) @ m[out > 0] + x[out == 0].sum() * s)
        return x

    trust, distrust = rank("h0.example", False), rank("h8.example", True)
    for x in got:
        if x.host is not None:
            k = ix[x.host]
            assert x.trust == pytest.approx(trust[k], abs=1e-8) and x.distrust == pytest.approx(distrust[k], abs=1e-8)
            refuse = x.host == "h8.example" or (x.host != "h0.example" and distrust[k] * len(names) >= 1 and distrust[k] > trust[k])
            assert x.keep == (not refuse)
    assert link_graph.judged_pages(d.limit(0), seeds("a"), seeds("b")).count() == 0
    assert all(x.keep and x.trust == x.distrust == 0 for x in link_graph.judged_pages(d, seeds(), seeds()).collect() if x.host)
    many = link_graph.judged_pages(d, seeds(), seeds("example", *(f"x{k}.example.org" for k in range(5000)))).collect()
    assert all(x.keep == (x.host is None) for x in many)  # a domain covers all hosts below it, among thousands of seeds


def test_link_table_counts_as_links(spark):
    pages = [(k, f"http://h{k}.example/", None) for k in range(4)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = spark.createDataFrame([("http://h0.example/", "//h1.example/a"), ("http://h0.example/", "http://h1.example/b"), ("http://h1.example/", "http://H2.example"), (None, "http://h3.example/"), ("x", None)], "url string, target string")
    got = {r.host: r for r in link_graph.judged_pages(d, link_graph.seed_table(spark, ["h0.example"]), link_graph.seed_table(spark, ["none.example"]), links).collect()}
    y = [1, 0.85, 0.85**2, 0]
    assert [got[f"h{k}.example"].trust for k in range(4)] == pytest.approx([v / sum(y) for v in y], abs=1e-8)


@pytest.mark.parametrize("edges", [500_000, 10])
def test_link_graph_runs_to_the_solution(spark, monkeypatch, edges):
    """A chain of 31 hosts whose end is blocked, among 1,000, in one block or in three."""
    monkeypatch.setattr(link_graph, "BLOCK_EDGES", edges)
    chain = 31
    hosts = [f"c{k:02d}.example" for k in range(chain)]
    pages = [(k, f"http://{a}/", f"<a href='http://{b}/'>") for k, (a, b) in enumerate(zip(hosts, hosts[1:]))] + [(chain + k, f"http://n{k}.example/", "") for k in range(1000 - chain)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r for r in link_graph.judged_pages(d, link_graph.seed_table(spark, []), link_graph.seed_table(spark, hosts[-1:]), tolerance=1e-9 if edges == 10 else None).collect()}
    assert len(got) == 999  # the blocked host has no page of its own
    m = np.zeros((chain, chain))  # distrust moves from a host to the one that links to it, and from the first back to the seed
    m[np.arange(1, chain), np.arange(chain - 1)] = 1
    m[0, chain - 1] = 1
    want = np.linalg.solve(np.eye(chain) - 0.85 * m.T, 0.15 * np.eye(chain)[chain - 1])
    for k, h in enumerate(hosts[:-1]):
        assert got[h].distrust == pytest.approx(want[k], abs=2e-9) and got[h].keep == (want[k] * 1000 < 1)
    assert sum(not r.keep for r in got.values()) == sum(want[:-1] * 1000 >= 1) > 12
    assert all(r.trust == 0 for r in got.values())

