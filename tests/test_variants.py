from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(120).selectExpr("id as sample_id", "(id * 37 % 101) / 101.0D as a")
    return df.selectExpr("*", "cast(a > 0.65D as int) as y").cache()


def test_weights_are_counted_once(rows):
    """Passes over weighted rows only map them: no count, window or join is left in their plan; rows without a class go, as
    they did, and count in the total."""
    df = rows.withColumn("y", F.when(F.col("sample_id") >= 10, F.col("y")))
    got = models.weighted(df, "y")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Window", "Join", "Aggregate"))
    n = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    want = {r.sample_id: (float(r.y), 120 / (2 * n[r.y])) for r in df.collect() if r.y is not None}
    assert n[None] == 10 and {r.sample_id: (r.label, r.weight) for r in got.collect()} == want


def test_variants_of_one_model_fit_it_once(rows, monkeypatch):
    made, trained = [], models.trained

    def watched(train, features, target, plan, params):
        made.append(plan.tune)
        return trained(train, features, target, plan, params)

    monkeypatch.setattr(models, "trained", watched)
    monkeypatch.setattr(models, "tuned", lambda *_: 0.5)
    plan = models.Plan("logistic", {"regParam": 0.01})
    plans = {"full": (["a"], plan), "no_threshold": (["a"], replace(plan, tune=False)), "no_scaling": (["a"], replace(plan, scale=False))}
    got = models.variant_scores(rows, "y", plans, 2)
    assert len(made) == 4 and got.count() == 3 * 2 * len(models.METRICS)
