"""What each feature adds to a score: exact Shapley values of tree models and of the linear model, kept by a cache.

A tree model is a relation of nodes (tree, node, feature, threshold, left, right, value, cover).  The value of a set of
features is the mean of the leaves that a row may reach when it follows its own splits on features of the set and, on
the others, goes both ways by cover.  For one leaf that is a product over the features of its path: the share of
cover z that the path keeps of a feature, or 1 or 0 if the row stays on the path or leaves it (o).  The Shapley value of a
feature is then a sum of coefficients of one polynomial, weighed by set size, and only the patterns of o that rows
have are worked out: 2 to the number of features of a path at most, whatever the number of rows.

Rows that lie between the same thresholds have the same values, so trees are put together into grids of cells between
thresholds, as long as a grid is small; the values of its cells are worked out once, and a row then looks up its cell in each grid.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.storage import shared_folder
from plumbline.operators.boosting import BoostingModel

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"


def explained_stage(model: PipelineModel):
    """The stage that is explained: the first with trees or coefficients (of a calibrated pipeline its first model), or None."""
    return next((s for s in model.stages if isinstance(s, BoostingModel) or hasattr(s, "trees") or hasattr(s, "coefficients")), None)


def tree_nodes(stage, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted tree model; leaves have feature -1.  Values are margins of boosted trees, whose sum is the score,
    and shares of the probability of class 1 of a forest; a model of either kind is as large as its parameters make it."""
    if isinstance(stage, BoostingModel):
        rows = []
        for t, (tree, cuts) in enumerate(stage.record()[1]):
            inner = len(tree.feature)
            rows += [(t, n, int(tree.feature[n]), float(cuts[n]), 2 * n + 1, 2 * n + 2, 0.0, float(tree.cover[n])) for n in range(inner)]
            rows += [(t, inner + k, -1, 0.0, -1, -1, float(v), float(tree.cover[inner + k])) for k, v in enumerate(tree.value)]
        return spark.createDataFrame(rows, NODES)
    path = shared_folder(spark)
    stage.write().overwrite().save(path)
    n, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    threshold = F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0))
    share = F.when(n["leftChild"] < 0, F.coalesce(F.try_divide(F.get(stats, F.lit(1)), cover), F.lit(0.0)) / stage.getNumTrees).otherwise(F.lit(0.0))
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"), threshold.alias("threshold"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), share.alias("value"), cover.alias("cover"))


@dataclass
class Path:
    """A leaf as a row sees it: for each feature on its way the interval (low, high] that leads there and the share of cover."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def paths(nodes: list[tuple]) -> list[Path]:
    """The leaves of a list of nodes (as `NODES`) that any row of the training data reached."""
    by = {(r[0], r[1]): r for r in nodes}
    children = {(r[0], c) for r in nodes if r[2] >= 0 for c in (r[4], r[5])}
    out, open_ = [], [(k, {}) for k in by if k not in children]
    while open_:
        (tree, node), held = open_.pop()
        _, _, feature, threshold, left, right, value, cover = by[tree, node]
        if feature < 0:
            if value:
                f = sorted(held)
                out.append(Path(np.array(f, np.int64), np.array([held[k][0] for k in f]), np.array([held[k][1] for k in f]), np.array([held[k][2] for k in f]), value))
            continue
        low, high, share = held.get(feature, (-np.inf, np.inf, 1.0))
        for child, lo, hi in ((left, low, min(high, threshold)), (right, max(low, threshold), high)):
            part = by[tree, child][7] / cover if cover > 0 else 0.0
            if part > 0:
                open_.append(((tree, child), held if threshold == np.inf else held | {feature: (lo, hi, share * part)}))
    return out


def shares_of(path: Path, kept: np.ndarray) -> np.ndarray:
    """The Shapley values of a path's features for each pattern (patterns by features, 1 where the row stays on the path)."""
    n, m = kept.shape
    out = np.zeros((n, m))
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    for i in range(m):
        poly = np.zeros((n, m))  # coefficients by the number of features in the set
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                poly[:, 1:] = poly[:, 1:] * path.share[j] + poly[:, :-1] * kept[:, j : j + 1]
                poly[:, 0] *= path.share[j]
        out[:, i] = (kept[:, i] - path.share[i]) * (poly @ weight) * path.value
    return out


def tree_shares(leaves: list[Path], x: np.ndarray) -> np.ndarray:
    """Rows by features: the Shapley values of the sum of all leaves."""
    out = np.zeros(x.shape)
    for p in leaves:
        m = len(p.feature)
        if not m:
            continue
        v = x[:, p.feature]
        # a value that is not a number goes right, as in the models
        on = np.where(np.isnan(v), p.high == np.inf, ((v > p.low) | (p.low == -np.inf)) & (v <= p.high))
        code = on @ (1 << np.arange(m, dtype=np.int64))
        seen, of = np.unique(code, return_inverse=True)
        pattern = (seen[:, None] >> np.arange(m) & 1).astype(float)
        np.add.at(out.T, p.feature, shares_of(p, pattern)[of].T)
    return out


#: Cells of a grid at most.
CELLS = 1 << 17


@dataclass
class Grid:
    """Leaves whose thresholds cut their features into few cells: the cuts of each feature, and the Shapley values of each cell."""

    feature: list[int]
    cuts: list[np.ndarray]
    values: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """A value that is not a number lies above all cuts, as in the models; infinity below the cut that it is, as any value."""
        cell = np.zeros(len(x), np.int64)
        for f, c in zip(self.feature, self.cuts):
            v = x[:, f]
            at = np.searchsorted(c, v, "left")
            cell = cell * (len(c) + 1) + np.where(np.isnan(v), len(c), at)
        return self.values[cell]


def _cuts(leaves: list[Path]) -> dict[int, np.ndarray]:
    by: dict[int, set[float]] = {}
    for p in leaves:
        for f, lo, hi in zip(p.feature.tolist(), p.low.tolist(), p.high.tolist()):
            by.setdefault(f, set()).update(v for v in (lo, hi) if np.isfinite(v))
    return {f: np.array(sorted(v)) for f, v in by.items()}


def _cells(leaves: list[Path]) -> int:
    return math.prod(len(c) + 1 for c in _cuts(leaves).values())


def _grid(leaves: list[Path], features: int, values: Callable[[np.ndarray], np.ndarray]) -> Grid:
    """The grid of these leaves, with what `values` says of a row in each cell: the cut above it, or no number in the last."""
    cuts = _cuts(leaves)
    inside = [np.append(c, np.nan) for c in cuts.values()]
    x = np.zeros((math.prod(map(len, inside)), features))
    for f, v in zip(cuts, np.meshgrid(*inside, indexing="ij")):
        x[:, f] = v.ravel()
    return Grid(list(cuts), list(cuts.values()), values(x))


def grids(trees: list[list[Path]], features: int) -> tuple[list[Grid], list[Path]]:
    """The trees as grids, each of as many as fit, and the leaves of those that are too large for one."""
    fit = [t for t in trees if _cells(t) <= CELLS]
    lots: list[list[list[Path]]] = []
    for t in fit:
        if lots and _cells([p for u in (*lots[-1], t) for p in u]) <= CELLS:
            lots[-1].append(t)
        else:
            lots.append([t])
    out = []
    for lot in lots:  # leaf by leaf only in each tree's own cells
        own = [_grid(t, features, lambda x, t=t: tree_shares(t, x)) for t in lot]
        out.append(_grid([p for t in lot for p in t], features, lambda x, own=own: sum(g.of(x) for g in own)))
    return out, [p for t in trees if _cells(t) > CELLS for p in t]


def by_tree(nodes: list[tuple]) -> list[list[Path]]:
    """The paths of each tree."""
    of: dict[int, list[tuple]] = {}
    for r in nodes:
        of.setdefault(r[0], []).append(r)
    return [paths(of[t]) for t in sorted(of)]


def expected(leaves: list[Path]) -> float:
    """The score of no features: all leaves by cover."""
    return float(sum(p.value * np.prod(p.share) for p in leaves))


def _explained(tables: list[Grid], leaves: list[Path], base: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                phi = sum((g.of(x) for g in tables), tree_shares(leaves, x))
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), flat, pa.array(base + phi.sum(1))], names=["sample_id", "base", "phi", "score"])

    return work


def explain(model: PipelineModel, df: DataFrame, features: list[str], background: DataFrame | None = None) -> DataFrame:
    """sample_id, base, phi (feature -> value), score for each row: base + sum(phi) = score.

    The score is the margin of boosted trees and of the linear model, the probability of a forest.  Trees need no
    background, the linear model takes the mean of `background` (or of df) as its base; of a calibrated pipeline the first
    model is explained, before calibration.  A model of neither kind is an error; `models.shapley_sampled` takes any."""
    stage = explained_stage(model)
    if stage is None:
        raise ValueError("neither trees nor coefficients; sampled orders explain any model")
    names = F.array(*map(F.lit, features))
    x = vector_to_array(stage.getFeaturesCol())
    rows = model.transform(df).select("sample_id", x.alias("x"))
    kind = df.schema["sample_id"].dataType.simpleString()
    if hasattr(stage, "coefficients") and not isinstance(stage, BoostingModel):
        w = [float(c) for c in stage.coefficients]
        seen = model.transform(df if background is None else background).select(x.alias("x"))
        mean = [float(v) for v in seen.agg(*[F.avg(F.col("x")[i]) for i in range(len(features))]).first()]
        base = float(stage.intercept) + sum(a * b for a, b in zip(w, mean))
        phi = F.array(*[F.lit(a) * (F.col("x")[i] - F.lit(b)) for i, (a, b) in enumerate(zip(w, mean))])
        out = rows.select("sample_id", F.lit(base).alias("base"), phi.alias("phi")).withColumn("score", F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, v: a + v))
    else:
        start = stage.record()[0] if isinstance(stage, BoostingModel) else 0.0
        trees = by_tree([tuple(r) for r in tree_nodes(stage, df.sparkSession).collect()])
        base = start + sum(map(expected, trees))
        out = rows.mapInArrow(_explained(*grids(trees, len(features)), base), f"sample_id {kind}, base double, phi array<double>, score double")
    return out.select("sample_id", "base", F.map_from_arrays(names, "phi").alias("phi"), "score")


def mean_shares(explained: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, value: the mean absolute share of each feature."""
    return explained.select(*keys, F.explode("phi").alias("feature", "_v")).groupBy(*keys, "feature").agg(F.avg(F.abs("_v")).alias("value"))


class Cache:
    """Explanations as Parquet by model, fold and digest of the rows; `hits` and `misses` count what was asked for."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.hits, self.misses = spark, root.rstrip("/"), 0, 0

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    @staticmethod
    def digest(rows: DataFrame, features: list[str], model: str = "") -> str:
        """12 hex digits of the rows (ids and features, in whatever order) and of what names their model."""
        h = F.xxhash64("sample_id", *features)
        r = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
        return hashlib.sha256(json.dumps([model, features, r.n, r.x, str(r.s)]).encode()).hexdigest()[:12]

    def path(self, model: str, fold: int, digest: str) -> str:
        return f"{self.root}/model={model}/fold={fold}/digest={digest}"

    def get(self, model: str, fold: int, digest: str) -> DataFrame | None:
        """What was put under these keys, if its writing ended."""
        path = self.path(model, fold, digest)
        fs, at = self._at(f"{path}/_SUCCESS")
        if not fs.exists(at):
            self.misses += 1
            return None
        self.hits += 1
        return self.spark.read.parquet(path)

    def put(self, explained: DataFrame, model: str, fold: int, digest: str) -> DataFrame:
        path = self.path(model, fold, digest)
        explained.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> int:
        """Removes all that is kept; the number of explanations that were."""
        fs, root = self._at(self.root)
        if not fs.exists(root):
            return 0
        n = len(fs.globStatus(self._at(f"{self.root}/model=*/fold=*/digest=*/_SUCCESS")[1]))
        fs.delete(root, True)
        return n
