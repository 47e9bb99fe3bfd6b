from collections import Counter

import corpus_pipeline
import duckdb
from cases import make_docs

from plumbline.llm import bpe, jaccard, mixing, quality


def test_stages(spark, tmp_path):
    rows = make_docs(60, 2, 60)
    rows = [(i, (t or "") + f" tail {i} words of it are new" if t and i > 12 else t) for i, t in rows] + [(200 + k, "one two three four five six seven eight nine ten eleven twelve " + f"more {k // 5} token = abcdefgh{k}") for k in range(10)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, "").persist()
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    passed = {r.doc_id for r in quality.measured(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == passed
    single = corpus_pipeline.near_duplicates(spark, kept, "").persist()
    want = {i for i, (_, c) in jaccard.brute([(i, t) for i, t in rows if i in passed], 5, 80).items() if i == c}
    assert {r.doc_id for r in single.collect()} == want
    clean = corpus_pipeline.secret_scan(spark, single, "").persist()
    assert clean.columns == docs.columns and not any("abcdefgh" in r.text for r in clean.collect())
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= want and out.count()
    documents = clean.toPandas()  # noqa: F841
    taken = duckdb.connect().execute(f"SELECT doc_id, (taken // size)::INT FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall()
    assert Counter(r.doc_id for r in out.collect()) == dict(taken) and len(taken) > 5
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decoded(out).collect()}.items() <= texts.items()


def test_the_row_that_stays_is_stated(spark):
    t = " ".join(map(str, range(30)))
    rows = [(1, t, "b", 2), (1, t, "a", 3), (1, t, None, 9), (2, t, "a", 1), (3, "another text", "z", 1), (3, "another text", "z", 0)]
    for dealt in (1, 3, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(dealt)
        got = sorted((r.doc_id, r.source, r.n) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        assert got == [(1, None, 9), (3, "z", 0)]
    maps = spark.createDataFrame([(1, "x", {"k": 2}), (1, "x", {"k": 1})], "doc_id long, text string, m map<string,int>")
    assert [r.m for r in corpus_pipeline.near_duplicates(spark, maps, "").collect()] == [{"k": 1}]
