"""Gradient boosting of the log-loss by histograms, with second derivatives.

Features are cut at quantiles into a fixed number of bins, once, and a row is then one byte for each feature.  A level
of a tree is one aggregation: every task adds up gradients and Hessians by (node, feature, bin) over all its rows, and
these sums, whose number depends on nodes, features and bins alone, are added by a shuffle and read by the driver, which
splits each node where `gain` is largest.  Rows alike in all bins, class and weight are one row, with their weights added up.  A leaf is worth `leaf`, a Newton step with an L2 penalty.

`symmetric` trees split all nodes of a level at one feature and bin, where the gains of all nodes together are largest.

Rows keep the margin of the trees that a checkpoint has seen; later trees are evaluated in each pass, so that a
pass is narrow and lineage ends at the last checkpoint.  A fitted model is a parameter (JSON), so it is saved and
loaded with its pipeline.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.storage import kept, let_go
from plumbline.operators.neighbours import _Columns

#: Trees that passes evaluate before their margin is written down.
RECENT = 10


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def leaf(g: np.ndarray | float, h: np.ndarray | float, l2: float):
    """The value of a leaf with these sums of gradients and Hessians."""
    return -g / (h + l2)


def gain(gl, hl, gr, hr, l2: float):
    """By how much the penalised loss falls when a node is split into these two."""
    score = lambda g, h: g * g / (h + l2)
    return 0.5 * (score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr))


@dataclass
class Tree:
    """A complete binary tree: feature and bin of each inner node, in level order, rows of a larger bin going right, and the
    values of its leaves.  A node that is not split sends all rows left.  `cover` has the Hessians of all nodes."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @property
    def depth(self) -> int:
        return int(len(self.value)).bit_length() - 1

    def nodes(self, x: np.ndarray, cuts: np.ndarray | None = None, levels: int | None = None) -> np.ndarray:
        """The node (in level order) that each row of x reaches after so many levels; x has bins, or values beside the
        `cuts` (by inner node) that bins stand for."""
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth if levels is None else levels):
            if cuts is None:
                right = x[row, self.feature[at]] > self.cut[at]
            else:  # NaN lies in the last bin, and a node that is not split has no cut
                right = ~(x[row, self.feature[at]] <= cuts[at]) & (cuts[at] != np.inf)
            at = 2 * at + 1 + right
        return at

    def of(self, x: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
        return self.value[self.nodes(x, cuts) - len(self.feature)]


def quantile_cuts(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """For each feature up to bins - 1 distinct values; bin b has the values above cut b - 1, up to cut b."""
    at = [(k + 1) / bins for k in range(bins - 1)]
    got = rows.agg(*[F.percentile_approx(F.col("x")[i], F.array(*map(F.lit, at)), 20 * bins).alias(f"f{i}") for i in range(features)]).first()
    top = rows.agg(*[F.max(F.col("x")[i]).alias(f"f{i}") for i in range(features)]).first()
    return [np.unique(np.array([v for v in got[i] or [] if v < top[i]], float)) for i in range(features)]


def _binned(cuts: list[np.ndarray], start: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            b = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(b.shape[1]), len(b), [None, pa.py_buffer(b.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(1), batch.column(2), pa.array(np.full(len(b), start))], names=["b", "y", "w", "margin"])

    return work


def alike(rows: DataFrame) -> DataFrame:
    """Rows alike in bins, class and weight as one whose weight is theirs together: all trees treat them alike, so sums are the same."""
    return rows.groupBy("b", "y", "w", "margin").agg(F.count("*").alias("_n")).select("b", "y", (F.col("w") * F.col("_n")).alias("w"), "margin")


def _unpacked(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    packed = batch.column(0)
    first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
    b = np.frombuffer(packed.buffers()[2], np.uint8)[first : first + len(packed) * features].reshape(-1, features)
    return b, *(np.asarray(batch.column(k), float) for k in (1, 2, 3))


def _sums(trees: list[Tree], growing: Tree, level: int, features: int, bins: int):
    """(cell, g, h): the sums of a task, by node of a level, feature and bin."""
    first = 2**level - 1
    size = 2**level * features * bins

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h, seen = np.zeros(size), np.zeros(size), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            b, y, w, margin = _unpacked(batch, features)
            for t in trees:
                margin = margin + t.of(b)
            p = sigmoid(margin)
            at = (growing.nodes(b, levels=level) - first)[:, None] * features + np.arange(features)
            cell = (at * bins + b).ravel()
            g += np.bincount(cell, np.repeat(w * (p - y), features), size)
            h += np.bincount(cell, np.repeat(w * p * (1 - p), features), size)
        if seen:
            some = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some]), pa.array(h[some])], names=["cell", "g", "h"])

    return work


def _moved(trees: list[Tree], features: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, _, _, margin = _unpacked(batch, features)
            for t in trees:
                margin = margin + t.of(b)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin)], names=["b", "y", "w", "margin"])

    return work


def level_sums(rows: DataFrame, trees: list[Tree], growing: Tree, level: int, features: int, bins: int) -> DataFrame:
    """(cell, g, h) over all rows: one aggregation, added up in each task before the shuffle."""
    return rows.mapInArrow(_sums(trees, growing, level, features, bins), "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def split(g: np.ndarray, h: np.ndarray, l2: float, least: float, symmetric: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bin and gain for each node, from sums by (node, feature, bin); gain 0 where a node stays whole."""
    gl, hl = np.cumsum(g, 2), np.cumsum(h, 2)
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    won = gain(gl, hl, gt - gl, ht - hl, l2)
    fits = (hl >= least) & (ht - hl >= least)
    nodes, _, bins = won.shape
    if symmetric:  # a node that cannot be split there adds nothing
        flat = np.where(fits, won, 0.0).sum(0).ravel()
        best = np.full(nodes, int(np.round(flat, 12).argmax()))
        won = np.full(nodes, max(float(flat.max()), 0.0))
    else:
        flat = np.where(fits, won, 0.0).reshape(nodes, -1)
        best = np.round(flat, 12).argmax(1)
        won = np.maximum(flat[np.arange(nodes), best], 0.0)
    return best // bins, best % bins, np.where(won > 1e-12, won, 0.0)


def grow(rows: DataFrame, trees: list[Tree], features: int, bins: int, depth: int, l2: float, least: float, rate: float, symmetric: bool) -> tuple[Tree, np.ndarray]:
    """The next tree, and the gain of each feature in it; one aggregation for each level."""
    inner, leaves = 2**depth - 1, 2**depth
    tree = Tree(np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(leaves), np.zeros(inner + leaves))
    won, sums = np.zeros(features), None
    for level in range(depth):
        first, n = 2**level - 1, 2**level
        got = np.array([(r.cell, r.g, r.h) for r in level_sums(rows, trees, tree, level, features, bins).collect()]).reshape(-1, 3)
        g, h = np.zeros(n * features * bins), np.zeros(n * features * bins)
        g[got[:, 0].astype(np.int64)], h[got[:, 0].astype(np.int64)] = got[:, 1], got[:, 2]
        g, h = g.reshape(n, features, bins), h.reshape(n, features, bins)
        tree.cover[first : first + n] = h[:, 0].sum(1)
        f, b, by = split(g, h, l2, least, symmetric)
        np.add.at(won, f, by if not symmetric else by / n)
        at = slice(first, first + n)
        tree.feature[at], tree.cut[at] = np.where(by > 0, f, 0), np.where(by > 0, b, 255)
        to = np.minimum(tree.cut[at], bins - 1)
        gl, hl = (np.cumsum(s, 2)[np.arange(n), tree.feature[at], to] for s in (g, h))
        sums = np.stack([gl, g[:, 0].sum(1) - gl], 1).ravel(), np.stack([hl, h[:, 0].sum(1) - hl], 1).ravel()
        if not (by > 0).any():  # nothing more to gain: the rows below go left all the way
            for deeper in range(level + 1, depth):
                tree.cover[2**deeper - 1 : 2 ** (deeper + 1) - 1] = sums[1]
                sums = tuple(np.stack([s, np.zeros(len(s))], 1).ravel() for s in sums)
            break
    tree.cover[inner:] = sums[1]
    tree.value[:] = np.where(sums[1] > 0, leaf(sums[0], np.maximum(sums[1], 0.0), l2) * rate, 0.0)
    return tree, won


class _Settings(_Columns, Params):
    """Parameters that both estimator and model are saved with."""

    trees = Param(Params._dummy(), "trees", "the fitted trees as JSON", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", probabilityCol="probability", rawPredictionCol="rawPrediction", predictionCol="prediction")


class Boosting(Estimator, _Settings):
    """Boosted trees over `features`, `label` (0, 1) and `weight`.

    maxIter trees of maxDepth levels, stepSize their rate; l2 the penalty of leaves, least the least Hessian on either side
    of a split, bins (256 at most) the quantile bins of a feature; NaN counts as larger than any number."""

    @keyword_only
    def __init__(self, maxIter: int = 100, maxDepth: int = 3, stepSize: float = 0.1, l2: float = 1.0, least: float = 1.0, bins: int = 64, symmetric: bool = False, weightCol: str = "weight") -> None:  # noqa: N803
        super().__init__()
        self.iterations, self.depth, self.rate = maxIter, maxDepth, stepSize
        self.l2, self.least, self.bins, self.symmetric, self.weight = l2, least, bins, symmetric, weightCol
        if not 2 <= bins <= 256:
            raise ValueError("bins must lie between 2 and 256")

    def _fit(self, dataset: DataFrame) -> BoostingModel:
        w = F.col(self.weight).cast("double") if self.weight in dataset.columns else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), w.alias("w"))
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        n, start = first.n, 0.0
        cuts = quantile_cuts(rows, n, self.bins)
        data = kept(alike(rows.mapInArrow(_binned(cuts, start), "b binary, y double, w double, margin double")))
        trees: list[Tree] = []
        recent: list[Tree] = []
        won = np.zeros(n)
        for _ in range(self.iterations):
            tree, by = grow(data, recent, n, self.bins, self.depth, self.l2, self.least, self.rate, self.symmetric)
            won += by
            trees.append(tree)
            recent.append(tree)
            if len(recent) == RECENT:
                moved = kept(data.mapInArrow(_moved(recent, n), "b binary, y double, w double, margin double"))
                let_go(data)
                data, recent = moved, []
        let_go(data)
        value = lambda f, b: float(cuts[f][b]) if b < len(cuts[f]) else float("inf")
        record = {"start": start, "won": won.tolist(), "trees": [{"feature": t.feature.tolist(), "cut": [value(f, b) for f, b in zip(t.feature.tolist(), t.cut.tolist())], "value": t.value.tolist(), "cover": t.cover.tolist()} for t in trees]}
        model = self._copyValues(BoostingModel())
        return model._set(trees=json.dumps(record))


class BoostingModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the raw prediction (margin), the probability of both classes and the prediction."""

    def record(self) -> tuple[float, list[tuple[Tree, np.ndarray]], np.ndarray]:
        """The first margin, each tree with its cuts as values, and the gain of each feature."""
        got = json.loads(self.getOrDefault(self.trees))
        trees = [(Tree(np.array(t["feature"]), np.array(t["cut"]), np.array(t["value"]), np.array(t["cover"])), np.array(t["cut"], float)) for t in got["trees"]]
        return got["start"], trees, np.array(got["won"])

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """The share of each feature in all gains."""
        won = self.record()[2]
        return DenseVector(won / (won.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        start, trees, _ = self.record()

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.stack(x.to_numpy())
            return pd.Series(start + sum((t.of(rows, cuts) for t, cuts in trees), np.zeros(len(rows))))

        m, p = F.col("_margin"), 1 / (1 + F.exp(-F.col("_margin")))
        out = dataset.withColumn("_margin", margin(vector_to_array(self.getFeaturesCol())))
        out = out.withColumn(self.getRawPredictionCol(), array_to_vector(F.array(-m, m))).withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))
        return out.withColumn(self.getPredictionCol(), (p >= 0.5).cast("double")).drop("_margin")
