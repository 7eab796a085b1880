from __future__ import annotations

import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltbed.llm.text import word_list

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def out(spark):
    return corpus_pipeline.run(spark, SF).cache()


def test_stages_keep_the_schema_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert 0 < docs.count() <= n, name
        n = docs.count()


def test_stages_against_brute_force(spark):
    """Of the raw documents: which near copies stay, that no 50 words stay twice, and which documents hold an item."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: word_list(r.text) for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for i, w in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i in sets if find(i) == i} and len(kept) < len(sets)

    cut = {r.doc_id: word_list(r.text) for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    grams = Counter(tuple(w[k : k + 50]) for w in cut.values() for k in range(len(w) - 49))
    before = Counter(tuple(w[k : k + 50]) for w in texts.values() for k in range(len(w) - 49))
    assert max(grams.values()) == 1 and max(before.values()) > 1
    repeated = {g for g, n in before.items() if n > 1}
    for i, w in texts.items():
        if not any(tuple(w[k : k + 50]) in repeated for k in range(len(w) - 49)):
            assert cut[i] == w  # clean documents are left alone

    items = [word_list(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    looked = {tuple(w[k : k + 13]) for w in items if len(w) >= 5 for k in range(max(1, len(w) - 12))}
    sizes = {len(g) for g in looked}
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    assert clean == {i for i, w in texts.items() if not any(tuple(w[k : k + n]) in looked for n in sizes for k in range(len(w) - n + 1))}


def test_pipeline_rows(spark, out):
    rows = out.collect()
    known = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and all(r.doc_id in known for r in rows)
    bench = [word_list(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for w in bench for k in range(max(1, len(w) - 12))}
    texts = {r.doc_id: word_list(r.text) for r in rows}
    assert not any(tuple(w[k : k + 13]) in grams for w in texts.values() for k in range(len(w)))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in texts.items()}
    ids = sorted(sets)
    assert not any(len(sets[a] & sets[b]) > 0.8 * len(sets[a] | sets[b]) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a])


def test_pipeline_on_empty_documents(spark, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
