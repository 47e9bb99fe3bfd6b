import random

import pytest
from cases import make_docs

from plumbline.llm import jaccard


def near_copies(seed, n=120):
    r = random.Random(seed)
    rows = [(i, t) for i, t in make_docs(n, seed, 60)]
    base = [f"w{k}" for k in range(60)]
    for i in range(n, n + 60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"v{r.randrange(9)}"
        if i % 4 == 0:
            w = [x.upper() for x in w]
        rows.append((i, " ".join(w[: r.randint(50, 60)])))
    return rows


@pytest.mark.parametrize("cap", [1 << 22, 500])
def test_against_all_pairs(spark, monkeypatch, cap):
    monkeypatch.setattr(jaccard, "CAP", cap)
    rows = near_copies(cap % 7)
    docs = spark.createDataFrame([(i, t, 2) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, 4, 85).collect()}
    assert got == jaccard.brute(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 30


def test_five_words_and_four_fifths(spark):
    rows = near_copies(5, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == jaccard.brute(rows, 5, 80)


def test_nulls_and_repeated_rows(spark):
    t = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(None, None), (None, t), (4, t), (4, t), (7, ""), (8, "one"), (9, "ONE")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.classes(docs, 4, 85).collect())
    assert got == [(-1, 0, -1), (-1, 17, 4), (4, 17, 4), (4, 17, 4), (7, 0, 7), (8, 1, 8), (9, 1, 8)]  # a row for each row
    assert jaccard.classes(docs.limit(0)).collect() == []
    first = {(r.doc_id, r.n_shingles): r.is_first for r in jaccard.classes(docs, 4, 85).collect()}
    assert first == {(None, 0): True, (None, 17): True, (4, 17): False, (7, 0): True, (8, 1): True, (9, 1): False}


@pytest.mark.parametrize("dealt", [1, 2, 3, 7])
def test_a_row_for_each_row_however_they_are_dealt(spark, dealt):
    """Repeated rows, also beside near copies and equal texts of other ids, in one task or several."""
    w = [f"w{k}" for k in range(40)]
    t, near = " ".join(w), " ".join(w[:39])
    rows = [(4, t)] * 5 + [(2, t)] * 2 + [(9, near)] * 3 + [(None, t)] * 2 + [(None, None)] * 4 + [(7, "")] * 2 + [(8, "its own")] * 3 + [(1, "its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(dealt)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.is_first) for r in jaccard.classes(docs, 4, 85).collect())
    want = [("4", 37, "2", False)] * 5 + [("2", 37, "2", False)] * 2 + [("9", 36, "2", False)] * 3 + [("None", 37, "2", True)] * 2
    want += [("None", 0, "None", True)] * 4 + [("7", 0, "7", True)] * 2 + [("8", 1, "1", False)] * 3 + [("1", 1, "1", True)]
    assert got == sorted(want)


def test_one_id_with_two_texts(spark):
    """Of two texts under one id only the one that is a near copy of another document is no first."""
    w = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:59])), (2, "quite another text of its own with more than a few words"), (3, " ".join(w)), (3, " ".join(w[1:]))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.is_first) for r in jaccard.classes(docs, 5, 80).collect())
    assert got == [(1, 56, 1, True), (2, 8, 2, True), (2, 55, 1, False), (3, 55, 1, False), (3, 56, 1, False)]


def test_linked_sets_share_a_part():
    """Sets at or near the threshold, of all sizes, keep a common part, whatever the order by which each drops parts."""
    import numpy as np

    rng, n_linked = np.random.default_rng(1), 0

    def kept(t, threshold, seed):
        out = set()
        for c, p, drop in jaccard.parts(t, threshold):
            order = sorted(p.tolist(), key=lambda x: hash((x, seed)))
            out |= {(c, x) for x in order[drop:]}
        return out

    for threshold in (85, 80, 50):
        for k in range(1500):
            n = int(rng.integers(1, 30 if k % 2 else 400))
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            drop = int(rng.integers(0, (100 - threshold) * n // 100 + 1))
            add = int(rng.integers(0, max(0, 100 * (n - drop) // threshold - n) + 1))
            y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2)]))
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= threshold * (len(x) + len(y) - both):
                n_linked += 1
                assert kept(x, threshold, k) & kept(y, threshold, k)
    assert n_linked > 3000
