"""Histogram boosting against a plain version on the same bins."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import boosting, models


def rows_of(seed=0, n=200, features=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, features)), 2)
    x[:, 1] = r.integers(0, 4, n)
    y = (x[:, 0] + 0.5 * (x[:, 1] == 2) + r.normal(size=n) * 0.4 > 0.2).astype(float)
    return x, y, np.where(y == 1, 0.8, 1.4)


def frame(spark, x, y, w):
    names = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))], f"sample_id long, {', '.join(f'{c} double' for c in names)}, label double, weight double").repartition(3)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def plain_fit(b, y, w, bins, trees, depth, l2, least, rate, symmetric):
    """Trees by looking at every split of every node: lists of {node: (feature, bin)}, leaf values and margins."""
    margin, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        at, chosen = np.zeros(len(y), int), {}
        for level in range(depth):
            nodes = range(2**level - 1, 2 ** (level + 1) - 1)

            def won(node, f, c):
                here, left = at == node, (at == node) & (b[:, f] <= c)
                gl, hl, gt, ht = g[left].sum(), h[left].sum(), g[here].sum(), h[here].sum()
                if hl < least or ht - hl < least:
                    return 0.0
                return 0.5 * (gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2))

            table = {n: [[won(n, f, c) for c in range(bins)] for f in range(b.shape[1])] for n in nodes}
            whole = np.sum([table[n] for n in nodes], 0)
            for n in nodes:
                t = np.round(whole if symmetric else np.array(table[n]), 12)
                if t.max() > 1e-12:
                    chosen[n] = divmod(int(t.argmax()), bins)
            right = np.zeros(len(y), int)
            for n, (f, c) in chosen.items():
                right |= ((at == n) & (b[:, f] > c)).astype(int)
            at = 2 * at + 1 + right
        value = {n: -g[at == n].sum() / (h[at == n].sum() + l2) * rate for n in set(at.tolist())}
        margin = margin + np.array([value[n] for n in at])
        out.append((chosen, value))
    return out, margin


@pytest.mark.parametrize("symmetric", [False, True])
def test_gain_and_leaves_against_plain(spark, symmetric):
    x, y, w = rows_of()
    df = frame(spark, x, y, w)
    est = boosting.Boosting(maxIter=12, maxDepth=3, stepSize=0.3, l2=1.5, least=0.5, bins=16, symmetric=symmetric)
    model = est.fit(df)
    cuts = boosting.quantile_cuts(df.select(vector_to_array("features").alias("x")), 3, 16)
    b = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1)
    want, margin = plain_fit(b, y, w, 16, 12, 3, 1.5, 0.5, 0.3, symmetric)
    start, got, _ = model.record()
    assert start == 0.0 and len(got) == 12
    for (tree, by_value), (chosen, value) in zip(got, want):
        for node in range(7):
            if node in chosen:
                f, c = chosen[node]
                assert (tree.feature[node], by_value[node]) == (f, cuts[f][c])
            elif any(7 + k in value for k in range(8)):
                assert by_value[node] == np.inf
        for node, v in value.items():
            assert tree.value[node - 7] == pytest.approx(v, abs=1e-9)
    out = {r.sample_id: r for r in model.transform(df).select("sample_id", "prediction", vector_to_array("rawPrediction").alias("m"), vector_to_array("probability").alias("p")).collect()}
    assert [out[i].m[1] for i in range(len(y))] == pytest.approx(margin.tolist(), abs=1e-9)
    assert all(abs(r.p[1] - 1 / (1 + np.exp(-r.m[1]))) < 1e-12 and r.prediction == float(r.p[1] >= 0.5) for r in out.values())
    if symmetric:
        for tree, by_value in got:
            for level in range(3):
                assert len({(tree.feature[n], by_value[n]) for n in range(2**level - 1, 2 ** (level + 1) - 1)}) == 1


def test_cover_adds_up(spark):
    x, y, w = rows_of(3)
    for symmetric in (False, True):
        _, trees, won = boosting.Boosting(maxIter=3, maxDepth=4, least=8.0, bins=8, symmetric=symmetric).fit(frame(spark, x, y, w)).record()
        for t, _ in trees:
            inner = len(t.feature)
            for n in range(inner):
                assert t.cover[n] == pytest.approx(t.cover[2 * n + 1] + t.cover[2 * n + 2])
        assert won[0] > won[2]


def test_one_aggregation_for_a_level(spark):
    x, y, w = rows_of()
    df = frame(spark, x, y, w).select(vector_to_array("features").alias("x"), F.col("label").alias("y"), F.col("weight").alias("w"))
    cuts = boosting.quantile_cuts(df, 3, 8)
    rows = df.mapInArrow(boosting._binned(cuts, 0.0), "b binary, y double, w double, margin double")
    tree = boosting.Tree(np.zeros(7, int), np.full(7, 255), np.zeros(8), np.zeros(15))
    plan = boosting.level_sums(rows, [], tree, 2, 3, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("partial_sum") == 2


def test_nan_odd_columns_and_saving(spark, tmp_path):
    x, y, w = rows_of(1)
    x[::7, 0] = np.nan
    x[:, 2] = 5.0
    names = ["f0", "f1", "f2"]
    df = frame(spark, x[:, :3], y, w).drop("features")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), boosting.Boosting(maxIter=5, maxDepth=2)]).fit(df)
    assert pipe.stages[-1].featureImportances[2] == 0.0 and sum(pipe.stages[-1].featureImportances) == pytest.approx(1.0)
    pipe.write().overwrite().save(f"file://{tmp_path}/m")
    back = PipelineModel.load(f"file://{tmp_path}/m")
    a, b = ([r.m for r in m.transform(df).orderBy("sample_id").select(vector_to_array("rawPrediction").alias("m")).collect()] for m in (pipe, back))
    assert a == b
    with pytest.raises(ValueError, match="no rows"):
        boosting.Boosting(maxIter=1).fit(frame(spark, x[:1], y[:1], w[:1]).limit(0))


def test_registry_learns(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1200, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "sample_id long, a double, b double, y int")
    for name in ("gbt", "gbt_balanced"):
        model = models.fit(df.where("sample_id < 900"), ["a", "b"], "y", name, maxIter=30, maxDepth=3)
        out = models.score(model, df.where("sample_id >= 900")).select("y", "y_prob").collect()
        right = sum((r.y_prob >= 0.5) == r.y for r in out) / len(out)
        assert right > 0.93, (name, right)
        assert all(v > 0.2 for _, v in models.importances(model, ["a", "b"]))
