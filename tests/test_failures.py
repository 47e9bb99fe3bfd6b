"""Queries whose result cannot say what is missing from it fail where a part of it fails."""

import pytest

import __spark_entry__
from plumbline import catalog
from plumbline.operators import models


@pytest.mark.parametrize("name", ["cross_dataset", "lodo_train"])
def test_a_failure_is_no_result(spark, monkeypatch, name):
    rows = spark.range(240).selectExpr("id as sample_id", "concat('d', id % 3) as dataset", *[f"(id * {k} % 101) / 101.0D as {f}" for k, f in zip((37, 53, 71, 11), catalog.FEATURES)]).selectExpr("*", "cast(l_quantity > 0.5D as int) as y")
    trained = models.trained

    def fails(train, *more):
        if "d1" not in {r.dataset for r in train.select("dataset").distinct().collect()}:
            raise ValueError("planted")
        return trained(train, *more)

    monkeypatch.setattr(catalog, "learnable", lambda s, d: rows)
    monkeypatch.setattr(models, "trained", fails)
    with pytest.raises(RuntimeError, match="planted"):
        __spark_entry__.queries()[name](spark, "")
