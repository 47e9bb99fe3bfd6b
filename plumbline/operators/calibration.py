"""Sigmoid calibration: p = 1 / (1 + exp(a * f + b)), fitted by Newton steps on sums over distinct scores.

Targets are smoothed, (n1 + 1) / (n1 + 2) for rows of class 1 and 1 / (n0 + 2) for the others.  Scores are reduced once to distinct
values with their counts, so a step is one aggregation of five sums over that table, whatever the number of rows; the
driver holds two numbers.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, SMALL, RIDGE = 100, 1e-10, 1e-12


def distinct_scores(scores: DataFrame) -> DataFrame:
    """(f, n1, n0): the rows of either class at each score, from (f, y)."""
    return scores.where("f is not null").groupBy("f").agg(F.sum((F.col("y") == 1).cast("double")).alias("n1"), F.sum((F.col("y") != 1).cast("double")).alias("n0"))


def _loss(z: Column, t1: float, t0: float) -> Column:
    """Negative log-likelihood of a score's rows where p = 1 / (1 + exp(z))."""
    soft = F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))  # -log(p); -log(1 - p) is this less z
    return F.col("n1") * (soft - (1 - t1) * z) + F.col("n0") * (soft - (1 - t0) * z)


def fit_sigmoid(table: DataFrame) -> tuple[float, float]:
    """a and b that minimise the loss of (f, n1, n0); with a single score, a is 0."""
    total = table.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.avg("f").alias("m"), F.stddev_pop("f").alias("s")).first()
    if total.n1 is None:
        raise ValueError("no scores to calibrate")
    n1, n0 = total.n1, total.n0
    t1, t0 = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    m, s = total.m, total.s or 1.0
    x = (F.col("f") - F.lit(m)) / F.lit(s)  # steps are taken on the standardised score
    a, b = 0.0, math.log((n0 + 1) / (n1 + 1))

    def sums(a: float, b: float):
        z = F.lit(a) * x + F.lit(b)
        p = F.when(z > 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
        d = F.col("n1") * (F.lit(t1) - p) + F.col("n0") * (F.lit(t0) - p)
        w = (F.col("n1") + F.col("n0")) * p * (1 - p)
        return table.agg(F.sum(_loss(z, t1, t0)).alias("loss"), F.sum(d * x).alias("ga"), F.sum(d).alias("gb"), F.sum(w * x * x).alias("haa"), F.sum(w * x).alias("hab"), F.sum(w).alias("hbb")).first()

    now = sums(a, b)
    for _ in range(STEPS):
        if max(abs(now.ga), abs(now.gb)) < SMALL * (n1 + n0):
            break
        haa, hbb = now.haa + RIDGE, now.hbb + RIDGE
        det = haa * hbb - now.hab**2
        if det <= 0:
            break
        da, db = -(hbb * now.ga - now.hab * now.gb) / det, -(haa * now.gb - now.hab * now.ga) / det
        step, slope = 1.0, now.ga * da + now.gb * db
        while step > 1e-10:
            then = sums(a + step * da, b + step * db)
            if then.loss <= now.loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        a, b, now = a + step * da, b + step * db, then
    return a / s, b - a * m / s


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, Params):
    a = Param(Params._dummy(), "a", "slope", TypeConverters.toFloat)
    b = Param(Params._dummy(), "b", "intercept", TypeConverters.toFloat)


class Sigmoid(Estimator, _Settings):
    """Calibrates the second entry of a probability vector by log-odds' kin: the score itself is f."""

    def __init__(self, featuresCol: str = "probability", labelCol: str = "label", predictionCol: str = "calibrated") -> None:  # noqa: N803
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)

    def _fit(self, dataset: DataFrame) -> SigmoidModel:
        scores = dataset.select(vector_to_array(self.getFeaturesCol())[1].alias("f"), F.col(self.getLabelCol()).alias("y"))
        table = distinct_scores(scores).persist()
        try:
            a, b = fit_sigmoid(table)
        finally:
            table.unpersist()
        return self._copyValues(SigmoidModel())._set(a=a, b=b)


class SigmoidModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = F.lit(self.getOrDefault(self.a)) * vector_to_array(self.getFeaturesCol())[1] + F.lit(self.getOrDefault(self.b))
        return dataset.withColumn(self.getPredictionCol(), 1 / (1 + F.exp(z)))
