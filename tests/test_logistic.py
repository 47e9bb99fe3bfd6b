"""Logistic models by Newton steps against those of the library, run to convergence, and what is measured of them."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import logistic, metrics, models


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    x = np.stack([r.normal(1e6, 3, 900).round(1), r.integers(0, 5, 900) * 0.01, r.exponential(2000, 900).round(-2)], 1)
    y = (0.5 * (x[:, 0] - 1e6) + 30 * x[:, 1] + 0.002 * x[:, 2] + r.normal(0, 2, 900) > 5).astype(int)
    once = [(*map(float, v), int(t)) for v, t in zip(x, y)]
    return spark.createDataFrame([(i, *v, f"d{i % 2}") for i, v in enumerate(once + once[:300])], "sample_id long, a double, b double, c double, y int, dataset string").cache()


def by_library(df: DataFrame, features: list[str], scale: bool = True, **params) -> PipelineModel:
    return Pipeline(stages=models._stages(features, "logistic", None, scale, params | {"tol": 1e-13, "maxIter": 500})).fit(models.weighted(df, "y"))


@pytest.mark.parametrize("scale, params", [(True, {"regParam": 0.001}), (True, {"regParam": 0.02, "elasticNetParam": 1.0}), (False, {"regParam": 0.01, "elasticNetParam": 0.4})])
def test_same_minimum(rows, tmp_path, scale, params):
    passes = []
    rows_of = logistic._sums
    with pytest.MonkeyPatch.context() as m:
        m.setattr(logistic, "_sums", lambda *a: passes.append(1) or rows_of(*a))
        got = models.fit(rows, ["a", "b", "c"], "y", "logistic", scale=scale, **params)
    assert 0 < len(passes) < 15
    want = by_library(rows, ["a", "b", "c"], scale, **params)
    assert np.allclose(got.stages[-1].coefficients.toArray(), want.stages[-1].coefficients.toArray(), rtol=1e-4, atol=1e-7)
    p = {r.sample_id: r.y_prob for r in models.score(want, rows).collect()}
    assert all(abs(p[r.sample_id] - r.y_prob) < 1e-5 for r in models.score(got, rows).collect())
    got.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [type(s) for s in again.stages] == [type(s) for s in want.stages] and again.stages[-1].coefficients == got.stages[-1].coefficients


def test_what_the_library_has_to_see_to(rows):
    flat = rows.withColumn("k", F.lit(3.0))
    assert models._linear(flat, ["a", "k"], "y", True, {"regParam": 0.1}) is None
    assert models.fit(flat, ["a", "k"], "y", "logistic", regParam=0.1).stages[-1].coefficients[1] == 0
    assert models._linear(rows.where("y = 1"), ["a"], "y", True, {"regParam": 0.1}) is None
    assert models._linear(rows.withColumn("a", F.expr("if(sample_id = 5, null, a)")), ["a"], "y", True, {"regParam": 0.1}) is None
    assert not logistic.takes({}) and not logistic.takes({"regParam": 0.1, "maxIter": 3})


def test_search_and_ablation_measure_all_rows(rows):
    """Models fitted and measured together are those of each fold by itself."""
    features, grid = ["a", "b", "c"], [{"regParam": 0.001}, {"regParam": 0.3, "elasticNetParam": 0.5}]
    dealt = models._dealt(rows, features, 3, "y", 42, "_inner")
    got = models.search_history(rows, features, "y", "logistic", grid)
    for p, mean, each in got:
        for i, value in enumerate(each):
            pred = models.score(by_library(dealt.where(F.col("_inner") != i), features, **p), dealt.where(F.col("_inner") == i))
            assert abs(metrics.auroc(pred.selectExpr("'m' as entity", "y as y_true", "y_prob"), ["entity"]).first().auroc - value) < 1e-4
        assert mean == pytest.approx(sum(each) / 3)
    plan = models.Plan("logistic", {"regParam": 0.001}, tune=False)
    variants = {"": (features, plan), "c": (["a", "b"], plan)}
    together = {(r.name, r.fold, r.metric): r.value for r in models.variant_scores(rows, "y", variants).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(models, "_newton", lambda *a: False)
        apart = {(r.name, r.fold, r.metric): r.value for r in models.variant_scores(rows, "y", variants).collect()}
    assert set(together) == set(apart) and len(apart) == 24
    assert all(abs(together[k] - apart[k]) < 1e-2 for k in apart)


def test_datasets_against_each_other(rows):
    got = {tuple(r)[2:5]: r.value for r in models.cross(rows, ["a", "b", "c"], "y", "logistic", 2, regParam=0.001).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(models, "_newton", lambda *a: False)
        want = {tuple(r)[2:5]: r.value for r in models.cross(rows, ["a", "b", "c"], "y", "logistic", 2, regParam=0.001).collect()}
    assert set(got) == set(want) and len(got) == 8 and all(abs(got[k] - want[k]) < 1e-3 for k in got)
