import pytest
from cases import make_docs

from plumbline.llm import anchors, rlz, suffix_index

SCHEMA = "doc_id long, text string, h long, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("window", [5, 20])
def test_words(spark, window):
    rows = make_docs(seed=window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.digest(frame(spark, rows), window).collect()}
    assert got == rlz.brute(rows, window)
    assert sum(x[1] for x in got.values()) > 100


@pytest.mark.parametrize("window", [12, 40])
def test_bytes(spark, window):
    rows = make_docs(seed=window)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.digest(frame(spark, rows), window).collect()}
    assert got == suffix_index.brute(rows, window)
    assert sum(x[1] for x in got.values()) > 100


def test_production_windows(spark):
    """400 bytes and 20 words on the driver's own documents, where they are there, and on long texts made here."""
    import os
    import random

    r = random.Random(5)
    rows = [(i, " ".join(r.choice("the of and to in is was for on with as by at".split()) + str(r.randrange(40)) for _ in range(r.randint(50, 400)))) for i in range(40)]
    part = rows[3][1][100:900]
    rows += [(100 + i, f"{r.random()} {part[: 380 + 10 * i]} {r.random()}") for i in range(6)] + [(200, rows[7][1]), (201, rows[7][1]), (202, rows[8][1] + "x")]
    folder = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(folder):
        rows += [(1000 + x.doc_id, x.text) for x in spark.read.parquet(folder).select("doc_id", "text").collect() if len(x.text or "") < 20_000]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_index.digest(frame(spark, rows), 400).collect()}
    assert got == suffix_index.brute(rows, 400) and sum(x[1] > 0 for x in got.values()) > 8
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in rlz.digest(frame(spark, rows), 20).collect()}
    assert got == rlz.brute(rows, 20)


def test_heavy_anchors_take_a_second_one(spark, monkeypatch):
    monkeypatch.setattr(anchors, "HEAVY", 1)
    rows = make_docs(seed=3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.digest(frame(spark, rows), 6).collect()}
    assert got == rlz.brute(rows, 6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.digest(frame(spark, rows), 20).collect()}
    assert got == suffix_index.brute(rows, 20)


def test_family_in_batches():
    rows = [t.encode() for _, t in make_docs(seed=4) if t]
    for w in (12, 30):
        family = suffix_index.IndexFamily(w)
        for k in range(0, len(rows), 3):
            family.add(rows[k : k + 3], list(range(k, min(k + 3, len(rows)))))
        assert len(family.levels) <= 6
        got = {(o, x) for o, at in family.matches() for x in at.tolist()}
        seen = {}
        for o, t in enumerate(rows):
            for x in range(len(t) - w + 1):
                seen.setdefault(t[x : x + w], []).append((o, x))
        assert got == {p for v in seen.values() if len(v) > 1 for p in v}


def test_empty_nulls_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rlz.digest(none).collect() == [] and suffix_index.digest(none).collect() == []
    long = "w%d " * 30 % tuple(range(30)) * 1
    rows = [(None, long), (None, None), (3, long), (3, long), (4, "")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rlz.digest(frame(spark, rows)).collect())
    assert got == [(-1, 0, 0), (-1, 30, 0), (3, 30, 30), (3, 30, 30), (4, 0, 0)]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_index.digest(frame(spark, rows), 40).collect())
    n = len(long)
    assert got == [(-1, 0, 0), (-1, n, n), (3, n, n), (3, n, n), (4, 0, 0)]


@pytest.mark.parametrize("heavy", [4096, 1])
def test_repeated_row_in_two_partitions(spark, monkeypatch, heavy):
    """Rows alike in doc_id and text are one document, also if they lie in two partitions beside a near copy."""
    monkeypatch.setattr(anchors, "HEAVY", heavy)
    w = [f"w{k}" for k in range(80)]
    near = " ".join([*w[:28], "other", *w[29:50], "words", *w[51:]])
    rows = [(1, " ".join(w)), (2, near), *((i, t) for i, t in make_docs(20, 6) if i > 2)]
    parts = [spark.sparkContext.parallelize([(i, t, 1, "x") for i, t in some], 1) for some in (rows, rows[:1], rows[:2])]
    docs = spark.createDataFrame(spark.sparkContext.union(parts), SCHEMA)
    assert docs.rdd.getNumPartitions() == 3
    got = rlz.digest(docs, 20).collect()
    assert len(got) == len(rows) + 3
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *x) for i, x in rlz.brute(rows, 20).items()}
    got = suffix_index.digest(docs, 60).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {(i, *x) for i, x in suffix_index.brute(rows, 60).items()}
