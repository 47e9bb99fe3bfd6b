"""Logistic regression by Newton steps, of many models in the same passes over the rows.

The objective is that of the ML library: the mean of weighted losses, classes weighed alike, plus a penalty (ridge, lasso or both) of
coefficients taken on features of unit weighted deviation.  It has one minimum, which Newton steps
reach in about ten passes.  A pass is one aggregation: every task adds up loss, gradient and second derivatives of every
model over its rows, for each model those of its own parts, and the driver holds these sums alone, whose number depends on models and
features.  With a lasso the quadratic model of a step is minimised coordinate by coordinate.

Rows are (part, features, y, n): n rows alike are one.  A model learns from some of the parts (folds), so the models of all folds and
parameters of a search are fitted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.storage import kept, let_go

#: Passes at most, the change of coefficients at which a model is done, rows that are worked on at once.
PASSES, SMALL, SLAB = 100, 1e-9, 2048
#: Bytes of sums that the driver takes from all tasks together.
AT_ONCE = 1 << 24
#: Ranges of scores that are added up apart.
RANGES = 64


@dataclass(frozen=True)
class Job:
    """A model: the parts it learns from, the numbers of its features, and its parameters."""

    parts: frozenset[int]
    used: tuple[int, ...]
    reg: float
    net: float = 0.0


@dataclass
class Fitted:
    """Coefficients (0 where a feature is not used) and intercept on raw features, mean and sample deviation of each."""

    coefficients: np.ndarray
    intercept: float
    mean: np.ndarray
    deviation: np.ndarray


def takes(params: dict) -> bool:
    """Whether these parameters are penalised ones, with which the minimum is finite and single."""
    return set(params) <= {"regParam", "elasticNetParam"} and params.get("regParam", 0.0) > 0


def rows_of(df: DataFrame, features: list[str], target: str, part: Column, together: bool = True) -> DataFrame:
    """(part, f0, f1, ..., y, n); `together` makes one row of those alike."""
    names = [f"f{i}" for i in range(len(features))]
    rows = df.where(F.col(target).isNotNull()).select(part.cast("int").alias("part"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)], F.col(target).cast("double").alias("y"))
    if together:
        return rows.groupBy("part", *names, "y").agg(F.count("*").alias("n"))
    return rows.withColumn("n", F.lit(1).cast("long"))


@dataclass
class Moments:
    """Rows, sums and squares of features (about `center`, over `unit`) by part and class."""

    center: np.ndarray
    unit: np.ndarray
    by: dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]

    def of(self, parts: frozenset[int], y: int) -> tuple[float, np.ndarray, np.ndarray]:
        d = len(self.center)
        mine = [v for (p, c), v in self.by.items() if p in parts and c == y]
        return sum(v[0] for v in mine), sum((v[1] for v in mine), np.zeros(d)), sum((v[2] for v in mine), np.zeros(d))


def moments(rows: DataFrame, d: int) -> Moments | None:
    """None if a feature has no value or a label is neither 0 nor 1: these are the library's to refuse."""
    f = [F.col(f"f{i}") for i in range(d)]
    odd = F.lit(False)
    for c in f:
        odd = odd | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    odd = odd | ~F.col("y").isin([0.0, 1.0])
    first = rows.agg(F.count_if(odd).alias("odd"), F.sum("n").cast("double").alias("n"), *[F.sum(c * F.col("n")).alias(f"s{i}") for i, c in enumerate(f)]).first()
    if first.odd or not first.n:
        return None
    center = np.array([first[f"s{i}"] / first.n for i in range(d)])
    off = [c - F.lit(float(m)) for c, m in zip(f, center)]
    got = rows.groupBy("part", "y").agg(F.sum("n").cast("double").alias("n"), *[F.sum(c * F.col("n")).alias(f"s{i}") for i, c in enumerate(off)], *[F.sum(c * c * F.col("n")).alias(f"q{i}") for i, c in enumerate(off)]).collect()
    total = sum(np.array([r[f"q{i}"] for i in range(d)]) for r in got)
    unit = np.sqrt(total / first.n)
    unit[unit <= 1e-12 * np.abs(center)] = 1.0  # all values alike, but for rounding
    unit[unit == 0] = 1.0
    by = {(r.part, int(r.y)): (r.n, np.array([r[f"s{i}"] for i in range(d)]) / unit, np.array([r[f"q{i}"] for i in range(d)]) / unit**2) for r in got}
    return Moments(center, unit, by)


def losses(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and losses at these log-odds."""
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1.0, e) / (1 + e), np.log1p(e) + np.maximum(m, 0.0) - y * m


def _blocks(center: np.ndarray, unit: np.ndarray):
    """(part, block): rows of a part as one value, each (1, features about center over unit, y, n), so that a pass does not turn
    every number into a row and back."""
    d = len(center) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x = np.asarray(batch.column(0)), np.ones((batch.num_rows, d + 2))
            for k in range(1, d):
                x[:, k] = (np.asarray(batch.column(k)) - center[k - 1]) / unit[k - 1]
            x[:, d], x[:, d + 1] = np.asarray(batch.column(d)), np.asarray(batch.column(d + 1))
            for p in np.unique(part):
                mine = x[part == p]
                values = [mine[lo : lo + SLAB].tobytes() for lo in range(0, len(mine), SLAB)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), p, np.int32)), pa.array(values, pa.binary())], names=["part", "block"])

    return work


def _sums(at: np.ndarray, jobs: list[Job], classes: np.ndarray, whole: bool):
    """Loss, gradient and upper second derivatives of each model, one after the other: all as one value (v) or as (k, v)."""
    d = at.shape[1]
    up = np.triu_indices(d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros((len(jobs), 1 + d + len(up[0]))), False
        of: dict[int, list[int]] = {}
        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = of.setdefault(p, [k for k, j in enumerate(jobs) if p in j.parts])
                if not mine:
                    continue
                x = np.frombuffer(block.as_buffer()).reshape(-1, d + 2)
                z, y, n = x[:, :d], x[:, d : d + 1], x[:, d + 1 :]
                prob, loss = losses(z @ at[mine].T, y)
                w = np.where(y > 0.5, classes[mine, 1], classes[mine, 0]) * n
                out[mine, 0] += (w * loss).sum(0)
                out[mine, 1 : d + 1] += (w * (prob - y)).T @ z
                out[mine, d + 1 :] += (w * prob * (1 - prob)).T @ (z[:, up[0]] * z[:, up[1]])
                seen = True
        if seen and whole:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])
        elif seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["k", "v"])

    return work


def _pass(blocks: DataFrame, tasks: int, at: np.ndarray, jobs: list[Job], classes: np.ndarray) -> np.ndarray:
    """The sums of all models: those of the tasks added up here where they are small, else by a shuffle."""
    d = at.shape[1]
    sums = np.zeros((len(jobs), 1 + d + d * (d + 1) // 2))
    whole = tasks * sums.nbytes <= AT_ONCE
    got = blocks.mapInArrow(_sums(at, jobs, classes, whole), "v binary" if whole else "k long, v double")
    if whole:
        return sum((np.frombuffer(r.v).reshape(sums.shape) for r in got.collect()), sums)
    got = got.groupBy("k").agg(F.sum("v").alias("v")).collect()
    sums.ravel()[[r.k for r in got]] = [r.v for r in got]
    return sums


def _step(theta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The change that minimises the quadratic model, whose g and h hold the ridge, plus the lasso at theta."""
    h = h + np.eye(len(h)) * 1e-12 * max(float(np.trace(h)), 1e-300)
    if not l1.any():
        return -np.linalg.solve(h, g)
    new = theta.copy()
    for sweep in range(10_000):
        moved = 0.0
        for k in range(len(theta)):
            slope = g[k] + h[k] @ (new - theta)
            v = new[k] - slope / h[k, k]
            v = np.sign(v) * max(abs(v) - l1[k] / h[k, k], 0.0)
            moved, new[k] = max(moved, abs(v - new[k])), v
        if moved < 1e-13 * (1 + np.abs(new).max()):
            break
        if sweep % 10 == 9:  # the minimum where signs stay as they are, if that is the one of all
            on, sign = (new != 0) | (l1 == 0), np.sign(new)
            change = np.where(on, 0.0, -theta)
            change[on] = np.linalg.solve(h[np.ix_(on, on)], -(g[on] + l1[on] * sign[on] + h[np.ix_(on, ~on)] @ change[~on]))
            slope = g + h @ change
            if (np.sign(theta + change)[on & (l1 > 0)] == sign[on & (l1 > 0)]).all() and (np.abs(slope[~on]) <= l1[~on]).all():
                return change
    return new - theta


class _Descent:
    """A model on its way: its last point that was taken, and the one that the next pass looks at."""

    def __init__(self, job: Job, m: Moments) -> None:
        self.job, d = job, len(m.center)
        sides = [m.of(job.parts, y) for y in (0, 1)]
        n = sides[0][0] + sides[1][0]
        self.fits = sides[0][0] > 0 and sides[1][0] > 0
        if not self.fits:
            return
        self.classes = np.array([n / (2 * s[0]) for s in sides])  # weights add up to n
        mean = sum(w * s[1] for w, s in zip(self.classes, sides)) / n
        squares = sum(w * s[2] for w, s in zip(self.classes, sides)) - n * mean**2
        free = n - sum(w * w * s[0] for w, s in zip(self.classes, sides)) / n
        scale = np.sqrt(np.maximum(squares, 0.0) / free) if free > 0 else np.zeros(d)
        plain = (sides[0][1] + sides[1][1]) / n
        spread = np.maximum(sides[0][2] + sides[1][2] - n * plain**2, 0.0) / max(n - 1, 1)
        self.mean, self.deviation = m.center + m.unit * plain, m.unit * np.sqrt(spread)
        on = np.zeros(d, bool)
        on[list(job.used)] = True
        if (on & (scale < 1e-6 * (1 + np.abs(mean)))).any():  # a feature that is constant, or is but for rounding
            self.fits = False
            return
        self.on = np.concatenate([[True], on])
        scale = np.concatenate([[0.0], np.where(on, scale, 0.0)])
        self.l2, self.l1 = job.reg * (1 - job.net) * scale**2, job.reg * job.net * scale
        self.n, self.scale = n, np.where(scale > 0, scale, 1.0)
        self.taken, self.at = None, np.zeros(d + 1)
        self.value, self.length, self.done = np.inf, 1.0, False

    def look(self, sums: np.ndarray) -> None:
        """Takes the point looked at, if the objective fell enough, and steps on from it, or else halves the step."""
        d = len(self.at)
        value = sums[0] / self.n + 0.5 * (self.l2 * self.at**2).sum() + (self.l1 * np.abs(self.at)).sum()
        if self.taken is not None and not value <= self.value + 1e-4 * self.length * self.fall + 1e-15 * abs(self.value):
            self.length /= 2
            self.done = self.length < 1e-9
            self.at = self.taken + (0.0 if self.done else self.length) * self.change
            return
        g = sums[1 : d + 1] / self.n + self.l2 * self.at
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = sums[d + 1 :] / self.n
        h = np.triu(h) + np.triu(h, 1).T + np.diag(self.l2)
        on = np.flatnonzero(self.on)
        change = np.zeros(d)
        change[on] = _step(self.at[on], g[on], h[np.ix_(on, on)], self.l1[on])
        self.fall = float(g @ change + (self.l1 * (np.abs(self.at + change) - np.abs(self.at))).sum())
        self.taken, self.value, self.length, self.change = self.at, value, 1.0, change
        self.done = bool(np.abs(change * self.scale).max() < SMALL * (1 + np.abs(self.at * self.scale).max()) or self.fall > -1e-16)
        self.at = self.taken + change


def fit_all(rows: DataFrame, d: int, jobs: list[Job]) -> list[Fitted] | None:
    """The models of all jobs, over `rows_of`, which are read once in each pass; None if one of them is not for this solver
    (values that are none, other labels, a class that is not there, a constant feature): these are the library's."""
    m = moments(rows, d)
    if m is None:
        return None
    all_of = [_Descent(j, m) for j in jobs]
    if not all(t.fits for t in all_of):
        return None
    parts = sorted(set().union(*[j.parts for j in jobs]))
    names = ["part", *[f"f{i}" for i in range(d)], "y", "n"]
    blocks = kept(rows.where(F.col("part").isin(parts)).select(*names).mapInArrow(_blocks(m.center, m.unit), "part int, block binary"))
    tasks = blocks.rdd.getNumPartitions()
    try:
        for _ in range(PASSES):
            left = [t for t in all_of if not t.done]
            if not left:
                break
            sums = _pass(blocks, tasks, np.stack([t.at for t in left]), [t.job for t in left], np.stack([t.classes for t in left]))
            for t, s in zip(left, sums):
                t.look(s)
    finally:
        let_go(blocks)
    out = []
    for t in all_of:
        w = t.at[1:] / m.unit
        out.append(Fitted(w, float(t.at[0] - (w * m.center).sum()), t.mean, t.deviation))
    return out


def _model(kind, java: str, *values):
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    cls = sc._jvm
    for name in java.split("."):
        cls = getattr(cls, name)
    return kind(cls(*[v if isinstance(v, str | float) else _py2java(sc, v) for v in values]))


def pipeline(fitted: Fitted, used: list[int], features: list[str], scale: bool, last: LogisticRegression, tag: str = "") -> PipelineModel:
    """The model as stages of the library: assemble, scale, classify; `last` names the columns."""
    raw, w, b = f"_raw{tag}" if scale else f"features{tag}", fitted.coefficients[used], fitted.intercept
    stages = [VectorAssembler(inputCols=[features[i] for i in used], outputCol=raw)]
    if scale:
        mean, deviation = fitted.mean[used], fitted.deviation[used]
        scaler = StandardScaler(inputCol=raw, outputCol=f"features{tag}", withMean=True, withStd=True)
        stages.append(scaler._copyValues(_model(StandardScalerModel, "org.apache.spark.ml.feature.StandardScalerModel", scaler.uid, Vectors.dense(deviation), Vectors.dense(mean))))
        w, b = w * deviation, b + float((w * mean).sum())
    got = _model(LogisticRegressionModel, "org.apache.spark.ml.classification.LogisticRegressionModel", last.uid, Vectors.dense(w), float(b))
    return PipelineModel(stages=[*stages, last._copyValues(got)])


def _margins(columns: list[np.ndarray], f: Fitted) -> np.ndarray:
    m = np.full(len(columns[0]), f.intercept)
    for x, w in zip(columns, f.coefficients):  # one by one, so that rows alike score alike wherever they are
        m += x * w
    return m


def _scored(fitted: list[Fitted], held: list[int], cuts: list[np.ndarray], d: int):
    """(b, m, pos, n): log-odds of a batch for each model on its held-out part, those alike as one; b is model and range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, y, n = (np.asarray(batch.column(k)) for k in (0, d + 1, d + 2))
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                x = [np.asarray(batch.column(k + 1))[rows] for k in range(d)]
                pos = y[rows] * n[rows]
                for job in (j for j, h in enumerate(held) if h == p):
                    m, to = np.unique(_margins(x, fitted[job]), return_inverse=True)
                    b = job * RANGES + np.searchsorted(cuts[job], m, "left")
                    columns = [b.astype(np.int32), m, np.bincount(to, pos, len(m)), np.bincount(to, n[rows], len(m))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["b", "m", "pos", "n"])

    return work


def _range(table: pa.Table) -> pa.Table:
    """Of the rows of a range: those of either class, and on either side of even odds, and pairs in the right order, ties as halves."""
    m, pos, n = (table.column(c).to_numpy() for c in ("m", "pos", "n"))
    yes = m >= 0
    tp, n_yes = pos[yes].sum(), n[yes].sum()
    scores, to = np.unique(m, return_inverse=True)
    pos, n = np.bincount(to, pos, len(scores)), np.bincount(to, n, len(scores))
    neg = n - pos
    pairs = (pos * (np.cumsum(neg) - neg / 2)).sum()
    return pa.table({"b": table.column("b").slice(0, 1), "pos": [pos.sum()], "neg": [neg.sum()], "pairs": [pairs], "tp": [tp], "fp": [n_yes - tp]})


def measured(rows: DataFrame, d: int, fitted: list[Fitted], held: list[int]) -> list[dict[str, float | None]]:
    """tp, fp, tn, fn (at even odds) and auroc of each model on the part named in `held`, over all its rows.

    Scores are dealt by ranges, whose cuts are those of a few rows: they say only which task adds a score up."""
    names = ["part", *[f"f{i}" for i in range(d)], "y", "n"]
    few = rows.where(F.col("part").isin(sorted(set(held)))).select(*names[1 : d + 1]).limit(4096).collect()
    x = [np.array([r[i] for r in few], float) for i in range(d)]
    cuts = [np.unique(np.quantile(_margins(x, f), np.arange(1, RANGES) / RANGES)) if few else np.zeros(0) for f in fitted]
    scored = rows.where(F.col("part").isin(sorted(set(held)))).select(*names).mapInArrow(_scored(fitted, held, cuts, d), "b int, m double, pos double, n double")
    got = scored.groupBy("b").applyInArrow(_range, "b int, pos double, neg double, pairs double, tp double, fp double").collect()
    out = []
    for job in range(len(fitted)):
        mine = sorted((r for r in got if r.b // RANGES == job), key=lambda r: r.b)
        n1, n0 = sum(r.pos for r in mine), sum(r.neg for r in mine)
        before, pairs = 0.0, 0.0
        for r in mine:
            pairs += r.pairs + r.pos * before
            before += r.neg
        tp, fp = sum(r.tp for r in mine), sum(r.fp for r in mine)
        out.append({"tp": tp, "fp": fp, "tn": n0 - fp, "fn": n1 - tp, "auroc": pairs / (n1 * n0) if n1 and n0 else None})
    return out
