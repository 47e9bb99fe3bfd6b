"""Gradients against differences, early stopping, batches and saving."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import models, perceptron


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_gradient(activation):
    r = np.random.default_rng(1)
    x, y, w = r.normal(size=(30, 3)), r.integers(0, 2, 30).astype(float), r.random(30)
    sizes = [3, 5, 4, 1]
    flat = perceptron.packed(perceptron.initial(sizes, activation, 2))
    loss = lambda v: (w * perceptron.losses(perceptron.margins(perceptron.unpacked(v, sizes), x, activation)[0], y)).sum()
    got = perceptron.gradient(perceptron.unpacked(flat, sizes), x, y, w, activation)
    for j in range(len(flat)):
        d = np.zeros_like(flat)
        d[j] = 1e-6
        assert got[j] == pytest.approx((loss(flat + d) - loss(flat - d)) / 2e-6, abs=1e-5)


def frame(spark, n, seed, label):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 2)), 6)
    df = spark.createDataFrame([(i, float(a), float(b), int(label(a, b))) for i, (a, b) in enumerate(x)], "sample_id long, a double, b double, y int").repartition(3)
    return df.cache()


def test_sums_over_tasks(spark):
    """A step's mean gradient and held-out loss are those of all rows, whatever the tasks."""
    r = np.random.default_rng(3)
    x, y, w, part = r.normal(size=(90, 2)), r.integers(0, 2, 90), r.random(90), r.integers(-1, 2, 90)
    rows = spark.createDataFrame([([float(a) for a in v], float(b), float(c), int(d)) for v, b, c, d in zip(x, y, w, part)], "x array<double>, y double, w double, part int").repartition(4)
    layers = perceptron.initial([2, 3, 1], "tanh", 5)
    g, n, loss = perceptron.step_sums(rows, layers, "tanh", 1, True)
    mine, held = part == 1, part == -1
    assert n == pytest.approx(w[mine].sum())
    assert np.allclose(g, perceptron.gradient(layers, x[mine], y[mine], w[mine], "tanh") / w[mine].sum())
    assert loss == pytest.approx((w * perceptron.losses(perceptron.margins(layers, x, "tanh")[0], y))[held].sum() / w[held].sum())


def test_stops_early_and_is_saved(spark, tmp_path):
    df = frame(spark, 400, 1, lambda a, b: a + b > 0)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), perceptron.Perceptron(layers=(8,), maxIter=200, stepSize=0.3, tol=1e-3, patience=4, batch=150)])
    model = pipe.fit(df.withColumn("label", F.col("y").cast("double")))
    record = model.stages[-1].record()
    assert 4 < record["epochs"] < 200 and len(record["held_out"]) == record["epochs"]
    assert min(record["held_out"]) < 0.15 and record["sizes"] == [2, 8, 1]
    out = model.transform(df).select("y", "prediction", vector_to_array("probability").alias("p"))
    assert out.where("y = prediction").count() > 385 and out.where("abs(p[0] + p[1] - 1) > 1e-12").count() == 0
    model.write().overwrite().save(f"file://{tmp_path}/m")
    back = PipelineModel.load(f"file://{tmp_path}/m").transform(df).select("sample_id", vector_to_array("rawPrediction").alias("m"))
    assert sorted(map(str, back.collect())) == sorted(map(str, model.transform(df).select("sample_id", vector_to_array("rawPrediction").alias("m")).collect()))


def test_registry(spark):
    df = frame(spark, 600, 2, lambda a, b: a * b > 0)
    model = models.fit(df.where("sample_id < 450"), ["a", "b"], "y", "mlp", layers=(16,), activation="tanh", maxIter=60, stepSize=0.1)
    out = models.score(model, df.where("sample_id >= 450")).collect()
    assert sum((r.y_prob >= 0.5) == r.y for r in out) / len(out) > 0.85
    heavy = models.fit(df, ["a", "b"], "y", "mlp", layers=(4,), alpha=1e4, maxIter=25, stepSize=0.1)
    assert np.abs(np.array(heavy.stages[-1].record()["weights"])).max() < 1.5
    with pytest.raises(ValueError, match="activation"):
        models.fit(df, ["a", "b"], "y", "mlp", activation="step")
    assert len(models.REGISTRY["mlp"][1]) == 12 and len(models.REGISTRY["knn"][1]) == 24
