"""The metric tree against all pairs, and how many distances it works out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metric_tree, neighbours


def frames(spark, v, q):
    a = spark.createDataFrame([(i, list(map(float, x)), float(i % 2)) for i, x in enumerate(v)], "vid long, v array<double>, y double").repartition(3)
    b = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(q)], "qid long, q array<double>").repartition(2)
    return a, b


def found(df):
    return sorted((r.qid, r["at"], r.vid, r.y) for r in df.collect())


def plain(v, q, k):
    out = []
    for i, x in enumerate(q):
        d = ((v - x) ** 2).sum(1)
        out += [(i, n + 1, int(j), float(j % 2)) for n, j in enumerate(np.lexsort((np.arange(len(v)), d))[:k])]
    return sorted(out)


def test_balls():
    """One tree by itself, with ties, repeated points and bounds."""
    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(700, 3)), 1)
    q = np.round(r.normal(size=(60, 3)), 1)
    for leaf in (1, 20, 40, 1000):
        tree = metric_tree.Balls(v, leaf)
        d2, at = tree.nearest(q, 7, np.full(60, np.inf))
        want = [np.lexsort((np.arange(700), ((v - x) ** 2).sum(1)))[:7] for x in q]
        assert (at == np.array(want)).all() and (np.diff(d2, axis=1) >= 0).all()
        some = np.sqrt(d2[:, 3])
        _, within = tree.nearest(q, 7, some)
        for i in range(60):
            inside = [j for j, d in zip(want[i], d2[i]) if d <= d2[i, 3]]
            assert within[i][: len(inside)].tolist() == inside
    assert len(metric_tree.Balls(np.zeros((100, 2)), 10).center) == 1


@pytest.mark.parametrize("pivots", [1, 24])
def test_equals_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(metric_tree, "BLOCK", 50)
    r = np.random.default_rng(pivots)
    v = np.concatenate([np.round(r.normal(size=(150, 4)), 1), np.round(5 + r.normal(size=(100, 4)) / 10, 1), np.zeros((30, 4))])
    q = np.concatenate([np.round(r.normal(size=(30, 4)), 1), np.zeros((3, 4)), np.full((2, 4), 40.0), np.round(5 + r.normal(size=(20, 4)) / 10, 1)])
    a, b = frames(spark, v, q)
    got = found(metric_tree.nearest(b, a, 5, 20, pivots))
    assert got == plain(v, q, 5) and got == found(neighbours.nearest(b, a, 5))


def test_few_vectors_and_none(spark):
    v = np.arange(6.0).reshape(3, 2)
    a, b = frames(spark, v, v[:2])
    assert found(metric_tree.nearest(b, a, 5)) == plain(v, v[:2], 5)
    assert metric_tree.nearest(b, a.limit(0), 5).collect() == [] and metric_tree.nearest(b.limit(0), a, 5).collect() == []


def test_distances_on_clustered_data(spark):
    """Of 40 clusters in eight dimensions less than a fifth of all pairs is worked out."""
    r = np.random.default_rng(4)
    center = 20 * r.normal(size=(40, 8))
    v = center[r.integers(0, 40, 4000)] + r.normal(size=(4000, 8))
    q = center[r.integers(0, 40, 400)] + r.normal(size=(400, 8))
    a, b = frames(spark, v, q)
    counted = spark.sparkContext.accumulator(0)
    got = metric_tree.nearest(b, a, 5, 30, 40, counted)
    assert found(got) == plain(v, q, 5)
    assert 0 < counted.value < 4000 * 400 / 5, counted.value


def test_leaf_size_changes_nothing(spark):
    rows = spark.range(200).selectExpr("id", "(id * 37 % 101) / 101.0D as a", "(id * 53 % 97) / 97.0D as b").selectExpr("*", "cast(a + 0.3D * b > 0.65D as double) as label")
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    one, two = ([r.probability[1] for r in neighbours.Neighbours(k=5, weights="distance", leafSize=n).fit(rows).setProbabilityCol("probability").transform(rows.withColumn("a", F.col("a"))).orderBy("id").collect()] for n in (3, 40))
    assert one == pytest.approx(two) and {0.0, 1.0} <= set(one)
