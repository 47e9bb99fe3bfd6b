"""The sigmoid against a plain fit, and calibrated pipelines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration, models
from plumbline.plans import experiments
from plumbline.settings import Settings


def plain(f, y):
    """a and b by many small Newton steps over rows."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([f, np.ones(len(f))], 1)
    v = np.array([0.0, np.log((n0 + 1) / (n1 + 1))])
    for _ in range(200):
        p = 1 / (1 + np.exp(x @ v))
        g, h = x.T @ (t - p), (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(h + 1e-13 * np.eye(2), g)
        v = v - 0.7 * step
    return v


@pytest.mark.parametrize("seed,scale", [(0, 1.0), (1, 1000.0), (2, 0.001)])
def test_coefficients(spark, seed, scale):
    r = np.random.default_rng(seed)
    y = (r.random(400) < 0.3).astype(int)
    f = np.round(scale * (0.4 * y + 0.5 * r.random(400)), 9 if scale < 1 else 3)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(f, y)] + [(None, 1)], "f double, y int")
    a, b = calibration.fit_sigmoid(calibration.distinct_scores(df))
    want = plain(f, y)
    assert a == pytest.approx(want[0], rel=1e-6) and b == pytest.approx(want[1], rel=1e-6)


def test_odd_scores(spark):
    one = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "f double, y int")
    a, b = calibration.fit_sigmoid(calibration.distinct_scores(one))
    assert 1 / (1 + np.exp(a * 0.5 + b)) == pytest.approx((1 * (2 / 3) + 2 * (1 / 4)) / 3)
    apart = spark.createDataFrame([(0.1, 0)] * 50 + [(0.9, 1)] * 50, "f double, y int")
    a, b = calibration.fit_sigmoid(calibration.distinct_scores(apart))
    p = [1 / (1 + np.exp(a * f + b)) for f in (0.1, 0.9)]
    assert p[0] == pytest.approx(1 / 52, abs=1e-6) and p[1] == pytest.approx(51 / 52, abs=1e-6)
    with pytest.raises(ValueError):
        calibration.fit_sigmoid(calibration.distinct_scores(one.limit(0)))


def test_calibrated_pipeline(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as sample_id", "(id * 37 % 101) / 101.0D as a", "(id * 53 % 97) / 97.0D as b").selectExpr("*", "cast(a + 0.6D * b + 0.3D * rand(3) > 0.9D as int) as y").cache()
    s = Settings(target="y", id_column="sample_id", features=["a", "b"], calibrate=True, calibration="sigmoid", calibration_folds=2, outer=2, inner=2)
    assert not s.problems() and Settings(calibration="none").problems()
    experiments.train(rows, s, "logistic", f"file://{tmp_path}/m")
    got = {r.sample_id: r.y_prob for r in models.score(experiments.artifacts.load_model(spark, f"file://{tmp_path}/m")[0], rows).collect()}
    model = models.fit_calibrated(rows, ["a", "b"], "y", "logistic", 2, calibration="sigmoid", missing="median")
    curves = [x for x in model.stages if isinstance(x, calibration.SigmoidModel)]
    assert len(curves) == 2
    out = model.transform(rows).select("sample_id", "y_prob", *[F.element_at(models.vector_to_array(f"probability_{i}"), 2).alias(f"f{i}") for i in range(2)]).collect()
    for r in out:
        each = [1 / (1 + np.exp(c.getOrDefault(c.a) * f + c.getOrDefault(c.b))) for c, f in zip(curves, (r.f0, r.f1))]
        assert r.y_prob == pytest.approx(sum(each) / 2) and got[r.sample_id] == pytest.approx(r.y_prob)
    with pytest.raises(ValueError, match="calibration"):
        models.fit_calibrated(rows, ["a", "b"], "y", "logistic", 2, calibration="spline")
