"""Exact nearest neighbours by a metric tree.

The first level is distributed: pivots spread over a sample (each the point farthest from those before) cut the vectors into
cells, each with its radius.  A query looks at the cells nearest to it that hold enough vectors; the distance to the last
of its neighbours there bounds the true one, and by the triangle inequality only cells that come nearer than that are
looked at in a second round.  Inside a cell a task builds a tree of balls down to leaves of a few vectors, and passes by
every ball that lies farther from a query than its bound.

The sample only places pivots, whatever it holds the result is exact.  Cells are dealt in blocks of vectors and of queries,
so no task holds more of either than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.storage import kept, let_go

#: Vectors that a cell is meant to hold, the most pivots, sampled vectors for each, and vectors or queries of a block.
CELL, PIVOTS, SAMPLED, BLOCK = 512, 512, 8, 4096
#: Numbers that a step of working out distances holds at once.
SLAB = 1_000_000
#: Distances are compared with this much room, for they are rounded.
ROOM = 1e-9


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, each the farthest from those before."""
    far, out = np.full(len(points), np.inf), [0]
    while len(out) < min(n, len(points)):
        far = np.minimum(far, ((points - points[out[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        out.append(int(far.argmax()))
    return points[out]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances, rows by pivots."""
    return np.sqrt(squared(x, pivots))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, rows of x by rows of y; differences are held for a slab of both at a time."""
    out = np.empty((len(x), len(y)))
    wide = max(1, min(len(y), SLAB // max(1, x.shape[1])))
    step = max(1, SLAB // max(1, wide * x.shape[1]))
    for a in range(0, len(x), step):
        for b in range(0, len(y), wide):
            out[a : a + step, b : b + wide] = ((x[a : a + step, None, :] - y[None, b : b + wide]) ** 2).sum(2)
    return out


class Balls:
    """A binary tree of balls over vectors; leaves hold up to `leaf` of them."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.x, self.leaf = x, leaf
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray | None] = []
        self.child: list[tuple[int, int]] = []
        self.seen = 0
        self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> int:
        me, points = len(self.center), self.x[rows]
        center = points.mean(0)
        far = np.sqrt(((points - center) ** 2).sum(1))
        self.center.append(center)
        self.radius.append(float(far.max()))
        self.rows.append(rows)
        self.child.append((-1, -1))
        if len(rows) > self.leaf and far.max() > 0:
            a = points[far.argmax()]
            b = points[((points - a) ** 2).sum(1).argmax()]
            at = points @ (b - a)
            order = np.argsort(at, kind="stable")
            half = len(rows) // 2
            self.rows[me] = None
            self.child[me] = (self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))
        return me

    def nearest(self, q: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and rows of the k nearest of each query within its bound, rows of smaller number first on ties;
        missing ones are infinite and -1.  `seen` counts the distances worked out."""
        d2, at = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        everyone = np.arange(len(q))
        self._visit(0, q, everyone, self._to(0, q, everyone), d2, at, bound)
        return d2, at

    def _to(self, node: int, q: np.ndarray, who: np.ndarray) -> np.ndarray:
        self.seen += len(who)
        return np.sqrt(((q[who] - self.center[node]) ** 2).sum(1))

    def _visit(self, node: int, q: np.ndarray, who: np.ndarray, away: np.ndarray, d2: np.ndarray, at: np.ndarray, bound: np.ndarray) -> None:
        limit = np.minimum(bound[who], np.sqrt(d2[who, -1]))
        near = away - self.radius[node] <= limit * (1 + ROOM) + ROOM * self.radius[node]
        who, away = who[near], away[near]
        if not len(who):
            return
        rows = self.rows[node]
        if rows is not None:
            rows = np.sort(rows)
            self.seen += len(who) * len(rows)
            k = d2.shape[1]
            step = max(1, SLAB // (k + len(rows)))  # a leaf of copies can be as large as a block
            for part in (who[lo : lo + step] for lo in range(0, len(who), step)):
                found = np.concatenate([d2[part], squared(q[part], self.x[rows])], 1)
                which = np.concatenate([at[part], np.broadcast_to(rows, (len(part), len(rows)))], 1)
                which_or_last = np.where(which < 0, np.iinfo(np.int64).max, which)
                best = np.lexsort((which_or_last, found), axis=1)[:, :k]
                d2[part], at[part] = np.take_along_axis(found, best, 1), np.take_along_axis(which, best, 1)
            return
        left, right = self.child[node]
        a, b = self._to(left, q, who), self._to(right, q, who)
        first = a <= b
        self._visit(left, q, who[first], a[first], d2, at, bound)
        self._visit(right, q, who[~first], b[~first], d2, at, bound)
        self._visit(right, q, who[first], b[first], d2, at, bound)
        self._visit(left, q, who[~first], a[~first], d2, at, bound)


def _search(pairs: DataFrame, cells: DataFrame, sizes: DataFrame, k: int, leaf: int, kinds: dict[str, str], counted) -> DataFrame:
    """qid, vid, y, d: up to k of each pair of a query (qid, q, bound) and a cell."""
    many = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("_v")))  # a row for each cell
    asked = F.broadcast(pairs.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_q")))
    left = pairs.join(many, "cell").join(asked, "cell").withColumn("a", F.pmod(F.xxhash64("qid"), F.col("_q"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("_v") - 1)))
    right = cells.join(many, "cell").join(asked, "cell").withColumn("b", F.pmod(F.xxhash64("vid"), F.col("_v"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
    left = left.select("cell", F.col("a").cast("long"), F.col("b").cast("long"), "qid", "q", "bound")
    right = right.select("cell", F.col("a").cast("long"), F.col("b").cast("long"), "vid", "v", "y")

    def near(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"qid": [], "vid": [], "y": [], "d": []})
        held = held.sort_values("vid", kind="stable").reset_index(drop=True)
        tree = Balls(np.stack(held.v.to_numpy()).astype(float), leaf)
        d2, at = tree.nearest(np.stack(asking.q.to_numpy()).astype(float), min(k, len(held)), asking.bound.to_numpy(float))
        if counted is not None:
            counted.add(tree.seen)
        i, j = np.nonzero(at >= 0)
        rows = at[i, j]
        return pd.DataFrame({"qid": asking.qid.to_numpy()[i], "vid": held.vid.to_numpy()[rows], "y": held.y.to_numpy()[rows], "d": d2[i, j]})

    return left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInPandas(near, f"qid {kinds['qid']}, vid {kinds['vid']}, y double, d double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, leaf: int = 30, pivots: int | None = None, counted=None) -> DataFrame:
    """qid, vid, y, d, at: for each query (qid, q) its k nearest of vectors (vid, v, y) by squared distance, ties to the smaller
    vid; all of them where there are fewer.  Ids are distinct.  `counted`, an accumulator, gets the number of distances."""
    kinds = {f.name: f.dataType.simpleString() for df in (queries, vectors) for f in df.schema}
    n = vectors.count()
    wanted = pivots or max(1, min(PIVOTS, -(-n // CELL)))
    sample = [r.v for r in vectors.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLED * wanted).select("v").collect()]  # to place pivots
    if not sample:
        return queries.select("qid").limit(0).selectExpr("qid", f"cast(null as {kinds['vid']}) as vid", "cast(null as double) as y", "cast(null as double) as d", "0 as at")
    centers = spread(np.array(sample, float), wanted)

    @F.pandas_udf("struct<cell:int,far:double>")
    def home(v: pd.Series) -> pd.DataFrame:
        d = to_pivots(np.stack(v.to_numpy()).astype(float), centers) if len(v) else np.zeros((0, 1))
        if counted is not None:
            counted.add(d.size)
        return pd.DataFrame({"cell": d.argmin(1) if len(v) else [], "far": d.min(1) if len(v) else []})

    @F.pandas_udf("array<double>")
    def ways(q: pd.Series) -> pd.Series:
        d = to_pivots(np.stack(q.to_numpy()).astype(float), centers) if len(q) else np.zeros((0, 1))
        if counted is not None:
            counted.add(d.size)
        return pd.Series(list(d))

    cells = kept(vectors.withColumn("_h", home("v")).select("vid", "v", "y", F.col("_h.cell").alias("cell"), F.col("_h.far").alias("far")))
    sizes = kept(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")))
    table = {r.cell: (r.n, r.radius) for r in sizes.collect()}  # a row for each pivot
    names = np.array(sorted(table))
    held, radius = np.array([table[c][0] for c in names]), np.array([table[c][1] for c in names])

    @F.pandas_udf("array<int>")
    def first(d: pd.Series) -> pd.Series:
        out = []
        for row in d:
            away = np.asarray(row)[names]
            order = np.argsort(away, kind="stable")
            out.append(names[order[: int(np.searchsorted(np.cumsum(held[order]), k)) + 1]].tolist())
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def others(d: pd.Series, seen: pd.Series, bound: pd.Series) -> pd.Series:
        out = []
        for row, had, b in zip(d, seen, bound):
            near = np.asarray(row)[names] - radius <= b * (1 + ROOM) + ROOM * radius
            out.append([c for c in names[near].tolist() if c not in set(had)])
        return pd.Series(out)

    asked = kept(queries.withColumn("d", ways("q")).withColumn("home", first("d")))
    at = F.row_number().over(Window.partitionBy("qid").orderBy("d", "vid"))
    one = _search(asked.select("qid", "q", F.explode("home").alias("cell"), F.lit(float("inf")).alias("bound")), cells, sizes, k, leaf, kinds, counted)
    one = kept(one.withColumn("at", at).where(F.col("at") <= k).drop("at"))
    bound = one.groupBy("qid").agg(F.when(F.count("*") >= k, F.sqrt(F.max("d"))).otherwise(F.lit(float("inf"))).alias("bound"))
    more = asked.join(bound, "qid").withColumn("cell", F.explode(others("d", "home", "bound"))).select("qid", "q", "cell", "bound")
    two = _search(kept(more), cells, sizes, k, leaf, kinds, counted)
    out = kept(one.unionByName(two).withColumn("at", at).where(F.col("at") <= k))
    let_go(asked, one)
    return out
