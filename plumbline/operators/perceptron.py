"""A multilayer perceptron for two classes: relu or tanh layers, an L2 penalty, mini-batches and early stopping.

Rows are dealt by a hash of their features: a tenth is held out, the others into mini-batches, each a folder of its own, in which
rows alike in features, class and weight are one row with their weights added up.  A step is one aggregation: every
task adds up the gradient of all its rows of the batch (as blocks, which executors keep), and the driver adds up one sum
for each task and takes an Adam step.  The
loss of the held-out rows comes with the first step of each epoch.  When it has not fallen by `tol` for `patience` epochs,
training ends, and the weights with the least held-out loss are those of the model.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.storage import kept, let_go
from plumbline.operators.neighbours import _Columns

ACTIVATIONS = ("relu", "tanh")
Layers = list[tuple[np.ndarray, np.ndarray]]


def initial(sizes: list[int], activation: str, seed: int) -> Layers:
    """Weights and offsets of each layer, uniform within a bound that keeps the variance of signals."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return out


def packed(layers: Layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def unpacked(flat: np.ndarray, sizes: list[int]) -> Layers:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def margins(layers: Layers, x: np.ndarray, activation: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The log-odds of each row, and the signals that enter each layer."""
    signals = [x]
    for w, b in layers[:-1]:
        z = signals[-1] @ w + b
        signals.append(np.maximum(z, 0.0) if activation == "relu" else np.tanh(z))
    w, b = layers[-1]
    return (signals[-1] @ w + b)[:, 0], signals


def losses(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, m) - y * m


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray, weight: np.ndarray, activation: str) -> np.ndarray:
    """The gradient of the weighted sum of losses, packed."""
    m, signals = margins(layers, x, activation)
    delta = (weight * (1 / (1 + np.exp(-m)) - y))[:, None]
    out: Layers = []
    for k in range(len(layers) - 1, -1, -1):
        out.append((signals[k].T @ delta, delta.sum(0)))
        if k:
            slope = (signals[k] > 0) if activation == "relu" else 1 - signals[k] ** 2
            delta = (delta @ layers[k][0].T) * slope
    return packed(out[::-1])


def _summed(layers: Layers, activation: str, batch_number: int):
    """(j, g): the gradient by weight; j of -1 and -2 are the weight of its rows and of the held-out ones, -3 the loss of those."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, np.zeros(3)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            y, w, part = (np.asarray(batch.column(k), float) for k in (1, 2, 3))
            held = part < 0
            if held.any():
                sums[1] += w[held].sum()
                sums[2] += (w[held] * losses(margins(layers, x[held], activation)[0], y[held])).sum()
            mine = part == batch_number
            g = gradient(layers, x[mine], y[mine], w[mine], activation)
            total = g if total is None else total + g
            sums[0] += w[mine].sum()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-3, len(total))), pa.array(np.concatenate([sums[::-1], total]))], names=["j", "g"])

    return work


def step_sums(rows: DataFrame, layers: Layers, activation: str, batch_number: int, with_held: bool) -> tuple[np.ndarray, float, float | None]:
    """The mean gradient of a mini-batch, the weight of its rows and, if wanted, the mean loss of the held-out rows."""
    used = rows.where(F.col("part").isin([batch_number, -1] if with_held else [batch_number])).select("x", "y", "w", "part")
    got = {r.j: r.g for r in used.mapInArrow(_summed(layers, activation, batch_number), "j long, g double").groupBy("j").agg(F.sum("g").alias("g")).collect()}
    n = got.get(-1, 0.0)
    size = sum(w.size + b.size for w, b in layers)
    g = np.array([got.get(j, 0.0) for j in range(size)]) / n if n else np.zeros(size)
    return g, n, got[-3] / got[-2] if got.get(-2) else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a mini-batch as blocks: features, class and weight of each row."""
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            rows = np.column_stack([x, np.asarray(batch.column(1), float), np.asarray(batch.column(2), float)])
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["block"])


class Blocks:
    """The mini-batches of a fit as blocks that executors keep (on disk where memory is short), each batch in partitions of its own;
    a step is one job over those of its batch, with neither a plan nor a shuffle.

    Every task sends one sum by weight, so the driver takes as many as a batch has partitions."""

    def __init__(self, data: DataFrame, parts: list[int]) -> None:
        self.context, self.of, each, at = data.sparkSession.sparkContext, {}, [], 0
        for p in parts:
            rdd = data.where(F.col("part") == p).select("x", "y", "w").mapInArrow(_packed, "block binary").rdd.map(lambda r: bytes(r[0]))
            self.of[p] = list(range(at, at := at + rdd.getNumPartitions()))
            each.append(rdd)
        self.rdd = self.context.union(each).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, layers: Layers, activation: str, batch_number: int, with_held: bool) -> tuple[np.ndarray, float, float | None]:
        """As `step_sums`."""
        width = len(layers[0][0]) + 2
        mine, held = self.of.get(batch_number, []), self.of.get(-1, []) if with_held else []

        def over(blocks: Iterator[bytes], step: bool):
            total, n, loss = None, 0.0, 0.0
            for block in blocks:
                rows = np.frombuffer(block).reshape(-1, width)
                x, y, w = rows[:, :-2], rows[:, -2], rows[:, -1]
                n += w.sum()
                if step:
                    g = gradient(layers, x, y, w, activation)
                    total = g if total is None else total + g
                else:
                    loss += (w * losses(margins(layers, x, activation)[0], y)).sum()
            return [(step, total, n, loss)]

        first = set(mine)
        got = self.context.runJob(self.rdd.mapPartitionsWithIndex(lambda i, blocks: over(blocks, i in first)), list, [*mine, *held]) if mine or held else []
        size = sum(w.size + b.size for w, b in layers)
        n = sum(r[2] for r in got if r[0])
        g = sum((r[1] for r in got if r[0] and r[1] is not None), np.zeros(size))
        weight = sum(r[2] for r in got if not r[0])
        return (g / n if n else g), n, sum(r[3] for r in got if not r[0]) / weight if weight else None

    def let_go(self) -> None:
        self.rdd.unpersist()


class _Settings(_Columns, Params):
    network = Param(Params._dummy(), "network", "the fitted layers as JSON", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", probabilityCol="probability", rawPredictionCol="rawPrediction", predictionCol="prediction")


class Perceptron(Estimator, _Settings):
    """layers: the sizes of the hidden ones; alpha: the penalty of squared weights, over the number of rows; maxIter: epochs at
    most; batch: rows that a mini-batch is meant to hold (one batch where there are fewer, ten at most)."""

    @keyword_only
    def __init__(self, layers: tuple[int, ...] = (50,), activation: str = "relu", alpha: float = 1e-4, maxIter: int = 200, stepSize: float = 0.02, batch: int = 20_000, tol: float = 1e-4, patience: int = 10, seed: int = 42, weightCol: str = "weight") -> None:  # noqa: N803
        super().__init__()
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {activation!r}")
        self.layers, self.activation, self.alpha, self.epochs, self.rate = tuple(layers), activation, alpha, maxIter, stepSize
        self.batch, self.tol, self.patience, self.seed, self.weight = batch, tol, patience, seed, weightCol

    def _fit(self, dataset: DataFrame) -> PerceptronModel:
        w = F.col(self.weight).cast("double") if self.weight in dataset.columns else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), w.alias("w"))
        h = F.xxhash64("x", F.lit(self.seed))
        rows = kept(rows.withColumn("h", F.pmod(h, F.lit(10))).withColumn("b", F.pmod(F.shiftright(h, 20), F.lit(1 << 20))))
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        n = rows.count()
        many = int(min(10, max(1, round(0.9 * n / self.batch))))
        held = rows.where("h = 0").limit(1).count() > 0 and n >= 20  # of fewer rows none can be spared
        part = F.when((F.col("h") == 0) & F.lit(held), F.lit(-1)).otherwise(F.col("b") % many).cast("int")
        alike = rows.groupBy("x", "y", "w", part.alias("part")).agg(F.count("*").alias("_n"))  # weigh together as one row
        data = kept(alike.select("x", "y", (F.col("w") * F.col("_n")).alias("w"), "part"), by=("part",))
        blocks = Blocks(data, [*([-1] if held else []), *range(many)])
        sizes = [first.n, *self.layers, 1]
        layers = initial(sizes, self.activation, self.seed)
        flat = packed(layers)
        penalised = packed([(np.ones_like(a), np.zeros_like(b)) for a, b in layers])  # offsets are not
        one, two, t = np.zeros_like(flat), np.zeros_like(flat), 0
        best, least, waited, history = flat.copy(), np.inf, 0, []
        try:
            for epoch in range(self.epochs):
                for b in range(many):
                    g, _, loss = blocks.sums(unpacked(flat, sizes), self.activation, b, b == 0)
                    if b == 0 and loss is not None:
                        history.append(float(loss))
                        waited = 0 if loss < least - self.tol else waited + 1
                        if loss < least:
                            best, least = flat.copy(), loss
                        if waited >= self.patience:
                            break
                    g = g + self.alpha * penalised * flat / n
                    t += 1
                    one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
                    flat = flat - self.rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
                if waited >= self.patience:
                    break
        finally:
            blocks.let_go()
            let_go(data, rows)
        if not np.isfinite(least):
            best = flat
        record = {"sizes": sizes, "activation": self.activation, "weights": best.tolist(), "epochs": epoch + 1 if self.epochs else 0, "held_out": history}
        return self._copyValues(PerceptronModel())._set(network=json.dumps(record))


class PerceptronModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the raw prediction (log-odds), the probability of both classes and the prediction."""

    def record(self) -> dict:
        """Sizes of the layers, activation, weights, epochs run and the held-out loss of each."""
        return json.loads(self.getOrDefault(self.network))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        got = self.record()
        layers, activation = unpacked(np.array(got["weights"]), got["sizes"]), got["activation"]

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(margins(layers, np.stack(x.to_numpy()).astype(float), activation)[0]) if len(x) else pd.Series([], dtype=float)

        m, p = F.col("_margin"), 1 / (1 + F.exp(-F.col("_margin")))
        out = dataset.withColumn("_margin", margin(vector_to_array(self.getFeaturesCol())))
        out = out.withColumn(self.getRawPredictionCol(), array_to_vector(F.array(-m, m))).withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))
        return out.withColumn(self.getPredictionCol(), (p >= 0.5).cast("double")).drop("_margin")
