"""Exact nearest neighbours in blocks, and a classifier by them (which finds them by a metric tree)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.storage import kept
from plumbline.operators import metric_tree

#: Rows of a block on either side; a task compares two blocks.
BLOCK = 4096


def nearest(queries: DataFrame, vectors: DataFrame, k: int, other: bool = False, block: int = BLOCK) -> DataFrame:
    """qid, vid, y, d, at: for each query (qid, q) its k nearest of vectors (vid, v, y) by distance, ties to the smaller vid.

    Both sides are dealt into blocks by hash, each pair of blocks is a task that keeps k of each query, and those are
    merged.  The work is queries times vectors: for query sets of stated size.  With `other`, a query is not its own
    neighbour."""
    nq, nv = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    left = queries.select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("b"))
    right = vectors.select("vid", "v", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("a"), F.pmod(F.xxhash64("vid"), F.lit(nv)).cast("int").alias("b"))

    def near(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(v):
            v = v.sort_values("vid")
            x, ids, y = np.stack(v.v.to_numpy()), v.vid.to_numpy(), v.y.to_numpy()
            for qid, one in zip(q.qid, q.q):
                d = ((x - np.asarray(one)) ** 2).sum(1)
                for i in np.argsort(d, kind="stable")[: k + 1].tolist():
                    if not (other and ids[i] == qid):
                        out.append((qid, ids[i], y[i], d[i]))
        return pd.DataFrame(out, columns=["qid", "vid", "y", "d"])

    kinds = {f.name: f.dataType.simpleString() for df in (queries, vectors) for f in df.schema}
    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(near, f"qid {kinds['qid']}, vid {kinds['vid']}, y double, d double")
    return pairs.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("d", "vid"))).where(F.col("at") <= k)


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    def _named(self, name, value):
        return self._set(**{name: value})

    def setFeaturesCol(self, value):  # noqa: N802
        return self._named("featuresCol", value)

    def setProbabilityCol(self, value):  # noqa: N802
        return self._named("probabilityCol", value)

    def setRawPredictionCol(self, value):  # noqa: N802
        return self._named("rawPredictionCol", value)

    def setPredictionCol(self, value):  # noqa: N802
        return self._named("predictionCol", value)


class Neighbours(Estimator, _Columns):
    """The share of label 1 among the k nearest training rows, each weighing one, or the inverse of its distance; leafSize is
    that of the metric tree and changes no result."""

    @keyword_only
    def __init__(self, k: int = 5, weights: str = "uniform", leafSize: int = 30) -> None:  # noqa: N803
        super().__init__()
        if weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights {weights!r}")
        self.k, self.weights, self.leaf = k, weights, leafSize
        self._setDefault(featuresCol="features", labelCol="label")

    def _fit(self, dataset: DataFrame) -> NeighboursModel:
        v = vector_to_array(self.getFeaturesCol())
        rows = dataset.select(v.alias("v"), F.col(self.getLabelCol()).alias("y")).groupBy("v", "y").count()
        # equal rows are one row with a count; a digest of the vector and label orders ties
        rows = rows.select(F.md5(F.concat_ws(":", F.concat_ws(",", F.col("v").cast("array<string>")), "y")).alias("vid"), "v", "y", "count")
        return self._copyValues(NeighboursModel(kept(rows), self.k, self.weights, self.leaf))


class NeighboursModel(Model, _Columns):
    """It keeps the training rows as a written table, which is not saved with it."""

    def __init__(self, rows: DataFrame, k: int, weights: str, leaf: int) -> None:
        super().__init__()
        self.rows, self.k, self.weights, self.leaf = rows, k, weights, leaf

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = vector_to_array(self.getFeaturesCol())
        asked = dataset.withColumn("_q", v)
        q = asked.select(F.col("_q").alias("qid"), F.col("_q").alias("q")).distinct()
        near = metric_tree.nearest(q, self.rows.select("vid", "v", "y"), self.k, self.leaf).join(self.rows.select("vid", "count"), "vid")
        before = F.coalesce(F.sum("count").over(Window.partitionBy("qid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = near.withColumn("n", F.greatest(F.least(F.col("count"), F.lit(self.k) - before), F.lit(0)))
        if self.weights == "distance":  # rows at distance 0 alone count where there are any
            here = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("qid"))
            near = near.withColumn("n", F.when(here == 1, F.when(F.col("d") == 0, F.col("n")).otherwise(0)).otherwise(F.col("n") / F.sqrt("d")))
        p = near.groupBy("qid").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("_p"))
        out = asked.join(p, asked["_q"] == p["qid"]).withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
        return out.drop("_q", "qid", "_p")
