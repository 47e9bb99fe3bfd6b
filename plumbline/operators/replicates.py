"""Bootstrap replicates by Poisson weights, and metrics of one's own.

In replicate r a row counts w times, w Poisson with mean 1.  It comes from a polynomial hash of degree two modulo a
prime, of a number that the row has (from a digest of its id) and three that the replicate has, so that any engine with whole
numbers draws the same weights, and the weights of a replicate's rows are three-wise independent.

Weights are made and added up where the rows are.  Metrics of confusion counts: a task sends, for each entity, four sums for
each replicate.  Metrics of scores: rows are dealt once by ranges of the score, cut where a sketch of the scores says;
a task sends a row for each replicate of its range.  What is shuffled is thus rows once, and replicates times tasks or
ranges, but never rows times replicates.

A metric of one's own is either an expression of tp, fp, tn, fn or a function of sorted distinct scores and the weights of both
classes at them; registered, it can be used wherever metrics are named: in intervals and in ablations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import range_bucket, range_cuts
from plumbline.operators.metrics import EDGES, auroc, bin_of, brier, calibration_error, confusion, long, scores

#: The prime of the hash, and the shares of it below which a weight is 0, 1, 2, and so on.
PRIME = 2**31 - 1
STEPS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]
#: Weights that a task holds at once, and that it works out at once, within the processor's cache.
SLAB, CACHED = 200_000, 50_000
#: Weights above this one are rare and looked up one by one; kinds of rows that are added up together.
FEW, TOGETHER = 4, 32


def row_number_of(seed: str, id_column: str = "sample_id") -> Column:
    """The number of a row below the prime."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))), 1, 8), 16, 10).cast("long") % PRIME


def replicate_numbers(seed: str, b: int) -> np.ndarray:
    """Three numbers below the prime for each replicate."""
    digests = [hashlib.md5(f"{seed}|{r}".encode()).hexdigest() for r in range(b)]
    return np.array([[int(h[8 * k : 8 * k + 8], 16) % PRIME for k in range(3)] for h in digests], np.int64)


def product(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """a @ b by blocks of columns, so small that BLAS starts no threads: every core has a task of its own."""
    out = np.empty((len(a), b.shape[1]), b.dtype) if out is None else out
    step = max(1, 200_000 // max(1, a.size))
    for lo in range(0, b.shape[1], step):
        np.matmul(a, b[:, lo : lo + step], out=out[:, lo : lo + step])
    return out


def weights(x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Rows by replicates.

    The hash a x^2 + b x + c is a product of two matrices: x and its square, in pieces of 16 bits, by the numbers of the replicates.
    Whole numbers stay below 2^49 there, so doubles hold them exactly, and so they do the remainder."""
    x = x.astype(np.int64)
    square = x * x % PRIME
    pieces = np.stack([square >> 16, square & 0xFFFF, x >> 16, x & 0xFFFF, np.ones_like(x)], 1).astype(float)
    a, b, c = numbers.T
    by = np.stack([a * 0x10000 % PRIME, a, b * 0x10000 % PRIME, b, c]).astype(float)
    out = np.empty((len(x), len(numbers)), np.uint8)
    step = max(1, CACHED // max(1, len(numbers)))
    h, q = np.empty((2, step, len(numbers)))
    over = np.empty(h.shape, bool)
    for lo in range(0, len(x), step):
        n = min(step, len(x) - lo)
        v, d, m, w = h[:n], q[:n], over[:n], out[lo : lo + n]
        product(pieces[lo : lo + n], by, v)
        np.add(v, 0.5, out=d)  # a half keeps multiples of the prime on their side of the rounded quotient
        d *= 1 / PRIME
        np.floor(d, out=d)
        d *= PRIME
        v -= d
        np.greater_equal(v, STEPS[0], out=w.view(bool))
        for k in range(1, FEW):
            np.greater_equal(v, STEPS[k], out=m)
            w += m.view(np.uint8)
        np.greater_equal(v, STEPS[FEW], out=m)
        at = np.flatnonzero(m)
        w.reshape(-1)[at] = np.searchsorted(STEPS, v.reshape(-1)[at], "right")
    return out


def _codes(columns: list[pa.Array], n: int) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's key among the keys of a batch, and these."""
    code, keys = np.zeros(n, np.int64), [()]
    for column in columns:
        coded = column.dictionary_encode("encode")
        values = coded.dictionary.to_pylist()
        seen, code = np.unique(code * len(values) + np.asarray(coded.indices, np.int64), return_inverse=True)
        keys = [(*keys[i // len(values)], values[i % len(values)]) for i in seen.tolist()]
    return code, keys


def _counted(b: int, seed: str, width: int):
    numbers = replicate_numbers(seed, b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                columns = [pa.array([v] * b) for v in key] + [pa.array(np.arange(b))] + [pa.array(sums[k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"k{i}" for i in range(width)] + ["replicate", "tp", "fp", "tn", "fn"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            code, keys = _codes([batch.column(k) for k in range(width)], batch.num_rows)
            cell = code * 4 + np.asarray(batch.column(width), np.int64)
            # entities of one sample have the same weights
            numbered, of = np.unique(np.asarray(batch.column(width + 1), np.int64), return_inverse=True)
            order = np.argsort(of, kind="stable")
            cell, of = cell[order], of[order]
            step = max(1, SLAB // b)
            for lo in range(0, len(numbered), step):
                first, end = np.searchsorted(of, [lo, lo + step])
                kinds, kind = np.unique(cell[first:end], return_inverse=True)
                w = weights(numbered[lo : lo + step], numbers).astype(np.float32 if (end - first) * len(STEPS) < 1 << 24 else float)
                for k in range(0, len(kinds), TOGETHER):
                    mine = np.flatnonzero((kind >= k) & (kind < k + TOGETHER))
                    rows, at = np.unique(of[first:end][mine] - lo, return_inverse=True)
                    times = np.zeros((min(TOGETHER, len(kinds) - k), len(rows)), w.dtype)
                    np.add.at(times, (kind[mine] - k, at), 1)
                    for c, total in zip(kinds[k : k + TOGETHER].tolist(), product(times, w if len(rows) == len(w) else w[rows])):
                        held.setdefault(keys[c // 4], np.zeros((4, b), np.int64))[c % 4] += total.astype(np.int64)
            if len(held) > 256:
                yield from sent()
        yield from sent()

    return work


def _typed(pred: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {pred.schema[k].dataType.simpleString()}" for k in keys)


def count_replicates(pred: DataFrame, b: int, keys: list[str] | None = None, seed: str = "boot", expressions: dict[str, Column] | None = None) -> DataFrame:
    """keys (entity), replicate and metrics (of `expressions`, or the built-in ones) of b replicates; those that hold one class only
    are left out."""
    keys = keys or ["entity"]
    y, p = F.col("y_true"), F.col("y_pred")
    cell = F.when((y == 1) & (p == 1), 0).when((y == 0) & (p == 1), 1).when((y == 0) & (p == 0), 2).otherwise(3)
    rows = pred.where("y_true is not null and y_pred is not null").select(*keys, cell.alias("_c"), row_number_of(seed).alias("_x"))
    got = rows.mapInArrow(_counted(b, seed, len(keys)), f"{_typed(pred, keys)}, replicate long, tp long, fp long, tn long, fn long")
    counts = got.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    return counts.where("tp + fn > 0 and fp + tn > 0").select(*keys, "replicate", *[c.alias(n) for n, c in (expressions or scores()).items()])


_BINS = len(EDGES) - 1
_SUMS = ["w1", "w0", "u", "brier", *[f"{c}{i}" for c in "nsy" for i in range(_BINS)]]


def _range_sums(keys: list[str], b: int, seed: str):
    numbers = replicate_numbers(seed, b)

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        p, y, x = rows["y_prob"].to_numpy(), rows["y_true"].to_numpy() == 1, rows["_x"].to_numpy().astype(np.int64)
        bins = rows["_bin"].fill_null(-1).to_numpy().astype(int)
        order = np.lexsort((y, p))
        p, y, x, bins = p[order], y[order], x[order], bins[order]
        differs = np.append(True, p[1:] != p[:-1])
        starts = differs | np.append(True, y[1:] != y[:-1])
        sums = {n: np.zeros(b) for n in _SUMS}
        below = np.zeros(b)  # negatives of smaller scores, by replicate
        tied: dict[bool, np.ndarray] = {}  # both classes at the score that is being read

        def passed() -> None:
            if True in tied:
                sums["u"] += tied[True] * (below + tied[False] / 2 if False in tied else below)
            if False in tied:
                np.add(below, tied[False], out=below)
            tied.clear()

        step = max(1, SLAB // b)
        for lo in range(0, len(p), step):
            at = slice(lo, lo + step)
            w, here, score = weights(x[at], numbers).astype(float), y[at], p[at]
            names, by = ["w1", "w0", "brier"], [here, ~here, np.where(here, 1 - score, score) ** 2]
            for i in np.unique(bins[at]).tolist():
                if i >= 0:
                    inside = bins[at] == i
                    names += [f"n{i}", f"s{i}", f"y{i}"]
                    by += [inside, inside * score, inside & here]
            for n, total in zip(names, product(np.stack(by).astype(float), w)):
                sums[n] += total
            first = np.flatnonzero(starts[at])
            if not len(first) or first[0]:
                first = np.append(0, first)
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(w)]):
                if differs[lo + i]:
                    passed()
                part = w[i] if j == i + 1 else w[i:j].sum(0)
                c = bool(here[i])
                tied[c] = tied[c] + part if c in tied else part
        passed()
        names = [*keys, "_part"]
        return pa.table([pa.repeat(k, b) for k in key] + [pa.array(np.arange(b))] + [pa.array(v) for v in sums.values()], names=[*names, "replicate", *sums])

    return work


def score_replicates(pred: DataFrame, b: int, keys: list[str] | None = None, seed: str = "boot", parts: int = 64) -> DataFrame:
    """keys (entity), replicate, auroc, cliffs_delta, brier, ece, mce of b replicates of the rows with a score; those that hold one
    class only are left out."""
    keys = keys or ["entity"]
    rows = pred.where("y_prob is not null and y_true is not null").select(*keys, "y_true", "y_prob", bin_of(F.col("y_prob")).alias("_bin"), row_number_of(seed).alias("_x"))
    dealt = rows.join(F.broadcast(range_cuts(rows, keys, "y_prob", parts)), keys).withColumn("_part", range_bucket(F.col("y_prob"), F.col("_cuts"), parts.bit_length())).drop("_cuts")
    got = dealt.groupBy(*keys, "_part").applyInArrow(_range_sums(keys, b, seed), f"{_typed(pred, keys)}, _part int, replicate long, " + ", ".join(f"{n} double" for n in _SUMS))
    before = Window.partitionBy(*keys, "replicate").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("u", F.col("u") + F.col("w1") * F.coalesce(F.sum("w0").over(before), F.lit(0.0)))
    t = got.groupBy(*keys, "replicate").agg(*[F.sum(n).alias(n) for n in _SUMS]).where("w1 > 0 and w0 > 0")
    area, n = F.col("u") / (F.col("w1") * F.col("w0")), F.col("w1") + F.col("w0")
    gaps = [F.abs(F.col(f"y{i}") - F.col(f"s{i}")) for i in range(_BINS)]
    each = [F.coalesce(F.try_divide(g, F.col(f"n{i}")), F.lit(0.0)) for i, g in enumerate(gaps)]
    inside = sum(F.col(f"n{i}") for i in range(_BINS))
    return t.select(*keys, "replicate", area.alias("auroc"), (2 * area - 1).alias("cliffs_delta"), (F.col("brier") / n).alias("brier"), F.coalesce(F.try_divide(sum(gaps), inside), F.lit(0.0)).alias("ece"), F.greatest(*each).alias("mce"))


@dataclass
class Metric:
    """A metric by an expression of tp, fp, tn, fn, or by a function of scores (sorted, distinct) and the weights of class 1
    and class 0 at each."""

    name: str
    expression: Callable[[], Column] | None = None
    function: Callable[[np.ndarray, np.ndarray, np.ndarray], float] | None = None


REGISTRY: dict[str, Metric] = {}


def register_metric(name: str, expression: Callable[[], Column] | None = None, function: Callable[[np.ndarray, np.ndarray, np.ndarray], float] | None = None) -> Metric:
    """Adds a metric; exactly one of both ways is to be given, and built-in names are taken."""
    if (expression is None) == (function is None):
        raise ValueError("a metric is an expression or a function")
    if name in BUILT_IN:
        raise ValueError(f"{name!r} is built in")
    REGISTRY[name] = Metric(name, expression, function)
    return REGISTRY[name]


BUILT_IN = ("precision_0", "precision_1", "recall_0", "recall_1", "f1_0", "f1_1", "f1_weighted", "mcc", "balanced_accuracy", "auroc", "brier", "ece", "mce")


def _distinct(pred: DataFrame, keys: list[str]) -> DataFrame:
    return pred.where("y_prob is not null and y_true is not null").groupBy(*keys, "y_prob").agg(F.sum((F.col("y_true") == 1).cast("double")).alias("n1"), F.sum((F.col("y_true") != 1).cast("double")).alias("n0"))


def _value(f: Callable, p: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> float | None:
    some = (n1 + n0) > 0
    if not n1.sum() or not n0.sum():
        return None
    got = float(f(p[some], n1[some], n0[some]))
    return got if got == got else None


def _function_values(keys: list[str], metric: Metric):
    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y_prob")
        value = _value(metric.function, pdf.y_prob.to_numpy(float), pdf.n1.to_numpy(float), pdf.n0.to_numpy(float))
        return pd.DataFrame({k: [v] for k, v in zip(keys, key)} | {"metric": [metric.name], "value": [value]})

    return work


def _built_in(pred: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and at least the metrics named: of counts, areas, squared errors and bins only what they need."""
    counts, wide = scores(), None
    if any(n in counts for n in names):
        wide = confusion(pred, keys).select(*keys, *[counts[n].alias(n) for n in names if n in counts])
    how = "left" if wide is not None else "full"
    for part, gives in ((auroc, {"auroc"}), (brier, {"brier"}), (calibration_error, {"ece", "mce"})):
        if gives & set(names):
            wide = part(pred, keys) if wide is None else wide.join(part(pred, keys), keys, how)
    return wide


def metric_values(pred: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, metric, value of built-in and registered metrics; null where a metric has none.

    A function gets all distinct scores of a key in one task."""
    if unknown := [n for n in names if n not in BUILT_IN and n not in REGISTRY]:
        raise KeyError(f"unknown metrics {unknown}; known: {[*BUILT_IN, *REGISTRY]}")
    out = None
    if built := [n for n in names if n in BUILT_IN]:
        out = long(_built_in(pred, keys, built), keys, built)
    if by_counts := [n for n in names if n in REGISTRY and REGISTRY[n].expression]:
        part = long(confusion(pred, keys).select(*keys, *[REGISTRY[n].expression().alias(n) for n in by_counts]), keys, by_counts)
        out = part if out is None else out.unionByName(part)
    for n in [n for n in names if n in REGISTRY and REGISTRY[n].function]:
        part = _distinct(pred, keys).groupBy(*keys).applyInPandas(_function_values(keys, REGISTRY[n]), f"{_typed(pred, keys)}, metric string, value double")
        out = part if out is None else out.unionByName(part)
    return out


def function_replicates(pred: DataFrame, b: int, name: str, keys: list[str] | None = None, seed: str = "boot", together: int = 50) -> DataFrame:
    """keys, replicate and the value of a registered function; so many replicates are worked out together, by a task that holds
    the rows of one key.  Weights are those of `score_replicates`."""
    keys, f = keys or ["entity"], REGISTRY[name].function
    rows = pred.where("y_prob is not null and y_true is not null").select(*keys, "y_true", "y_prob", row_number_of(seed).alias("_x"))
    blocks = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // together))))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * together
        numbers = replicate_numbers(seed, b)[first : first + together]
        p, at = np.unique(pdf.y_prob.to_numpy(float), return_inverse=True)
        y, x = pdf.y_true.to_numpy() == 1, pdf["_x"].to_numpy(np.int64)
        n = np.zeros((2, len(p), len(numbers)))
        step = max(1, SLAB // len(numbers))
        for lo in range(0, len(x), step):
            w = weights(x[lo : lo + step], numbers).astype(float)
            for c in (0, 1):
                of = y[lo : lo + step] == bool(c)
                np.add.at(n[c], at[lo : lo + step][of], w[of])
        values = [_value(f, p, n[1][:, r], n[0][:, r]) for r in range(len(numbers))]
        return pd.DataFrame({k: [v] * len(values) for k, v in zip(keys, key)} | {"replicate": np.arange(first, first + len(values)), name: values})

    got = blocks.groupBy(*keys, "_r").applyInPandas(work, f"{_typed(pred, keys)}, replicate long, {name} double")
    return got.where(F.col(name).isNotNull())


def intervals(pred: DataFrame, metric: str, b: int = 1000, level: float = 0.95, keys: list[str] | None = None, seed: str = "boot") -> DataFrame:
    """keys, metric, mean, lower, upper, n: percentiles of the replicates of a built-in or registered metric."""
    keys = keys or ["entity"]
    if metric in REGISTRY:
        m = REGISTRY[metric]
        reps = function_replicates(pred, b, metric, keys, seed) if m.function else count_replicates(pred, b, keys, seed, {metric: m.expression()})
    elif metric in ("auroc", "brier", "ece", "mce", "cliffs_delta"):
        reps = score_replicates(pred, b, keys, seed)
    elif metric in BUILT_IN:
        reps = count_replicates(pred, b, keys, seed)
    else:
        raise KeyError(f"unknown metric {metric!r}")
    q = F.percentile(metric, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    out = reps.groupBy(*keys).agg(F.avg(metric).alias("mean"), q.alias("q"), F.count("*").alias("n"))
    return out.select(*keys, F.lit(metric).alias("metric"), "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "n")
