"""Bootstrap intervals.

Metrics of the four confusion counts: resampling rows is a multinomial draw of the counts, so one aggregation
and a draw on the driver give any number of replicates whatever the size.  Metrics of scores: the same draw over the
counts of distinct scores and labels, first over ranges of the scores (cut by a sketch), then inside each in its own task.
`replicates` has Poisson weights by a hash instead, which can be repeated in any engine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions.storage import kept, let_go
from plumbline.functions.windows import range_bucket, range_cuts
from plumbline.operators.metrics import EDGES, bin_of, scores


def _by_counts(c: np.ndarray) -> dict[str, np.ndarray]:
    tp, fp, tn, fn = c.astype(float).T
    div = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    n1, n0 = tp + fn, tn + fp
    f0, f1, r0, r1 = div(2 * tn, 2 * tn + fn + fp), div(2 * tp, 2 * tp + fp + fn), div(tn, n0), div(tp, n1)
    return {
        "precision_0": div(tn, tn + fn), "precision_1": div(tp, tp + fp), "recall_0": r0, "recall_1": r1, "f1_0": f0, "f1_1": f1, "f1_weighted": div(n0 * f0 + n1 * f1, n0 + n1),
        "mcc": div(tp * tn - fp * fn, np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "balanced_accuracy": np.where(n1 == 0, r0, np.where(n0 == 0, r1, (r0 + r1) / 2)),
    }


def _cells(pred: DataFrame, by: list[str], blocks: int) -> DataFrame:
    """by, _block, c: the rows of each block, dealt by a hash of the id."""
    return pred.groupBy(*by, F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).alias("_block")).agg(F.count("*").alias("c"))


def count_intervals(pred: DataFrame, keys: list[str], b: int = 1000, level: float = 0.95, method: str = "bca", blocks: int = 200, seed: int = 42, cells: DataFrame | None = None) -> DataFrame:
    """keys, metric, point, mean, std, lower, upper, method, valid; BCa falls back to percentiles where it has no value.

    The acceleration is that of leaving out blocks of rows dealt by a hash of the id.  `cells` are the rows of pred counted
    before, by keys, y_true, y_pred and block at least."""
    if b < 100:
        raise ValueError("at least 100 replicates")
    cells = _cells(pred, [*keys, "y_true", "y_pred"], blocks) if cells is None else cells
    some = lambda y, p: F.coalesce(F.sum(F.when((F.col("y_true") == y) & (F.col("y_pred") == p), F.col("c"))), F.lit(0))
    parts = cells.groupBy(*keys, "_block").agg(some(1, 1).alias("tp"), some(0, 1).alias("fp"), some(0, 0).alias("tn"), some(1, 0).alias("fn")).collect()
    groups: dict[tuple, list] = {}
    for r in parts:
        groups.setdefault(tuple(r[k] for k in keys), []).append([r.tp, r.fp, r.tn, r.fn])
    out, rng = [], np.random.default_rng(seed)
    for key, rows in sorted(groups.items()):
        cells = np.array(rows)
        total = cells.sum(0)
        point, draws, left = _by_counts(total[None]), rng.multinomial(total.sum(), total / total.sum(), b), _by_counts(total - cells)
        both = ((draws[:, 0] + draws[:, 3]) > 0) & ((draws[:, 1] + draws[:, 2]) > 0)
        values = _by_counts(draws[both])
        out += _rows(key, values, point, left, bool(both.mean() >= 0.5), level, method)
    return _table(pred, keys, out)


def _rows(key: tuple, values: dict, point: dict, left: dict, valid: bool, level: float, method: str) -> list[tuple]:
    """A row for each metric, from its replicates, its value and its values without each block."""
    out = []
    for m, v in values.items():
        used, levels = "percentile", ((1 - level) / 2, (1 + level) / 2)
        if not valid:
            out.append((*key, m, float(point[m][0]), None, None, None, None, used, False))
            continue
        if method == "bca":
            d = left[m].mean() - left[m]
            s = (d * d).sum()
            a = float((d**3).sum() / (6 * s**1.5)) if len(d) > 2 and s > 0 else 0.0
            found = stats.bca_levels(int((v < point[m][0]).sum()), len(v), a, level)
            if found:
                used, levels = "bca", found
        lo, hi = np.quantile(v, levels)
        out.append((*key, m, float(point[m][0]), float(v.mean()), float(v.std(ddof=1)), float(lo), float(hi), used, True))
    return out


def _table(pred: DataFrame, keys: list[str], rows: list[tuple]) -> DataFrame:
    schema = ", ".join(f"{k} {pred.schema[k].dataType.simpleString()}" for k in keys) + ", metric string, point double, mean double, std double, lower double, upper double, method string, valid boolean"
    return pred.sparkSession.createDataFrame(rows, schema)


#: Numbers that a task holds at once for a part of the score range.
SLAB = 2_000_000


def _by_scores(t: pd.DataFrame) -> dict[str, np.ndarray]:
    n = (t.w1 + t.w0).to_numpy(float)
    bins = np.stack([np.stack([t[f"{c}{i}"].to_numpy(float) for i in range(len(EDGES) - 1)]) for c in "nsy"])
    gap = np.abs(bins[2] - bins[1])
    auroc = t.u.to_numpy(float) / (t.w1 * t.w0).to_numpy(float)
    each = np.divide(gap, bins[0], out=np.zeros_like(gap), where=bins[0] > 0)
    return {"auroc": auroc, "brier": t.brier.to_numpy(float) / n, "ece": gap.sum(0) / n, "mce": each.max(0), "cliffs_delta": 2 * auroc - 1}


def score_intervals(pred: DataFrame, keys: list[str], b: int = 1000, level: float = 0.95, method: str = "bca", blocks: int = 200, seed: int = 42, parts: int = 256, cells: DataFrame | None = None) -> DataFrame:
    """As count_intervals, for auroc, brier, ece, mce and cliffs_delta of positives against negatives; rows without a
    score play no part.  Null where one class is missing.  `cells` are the rows of pred counted before, by keys, y_prob, y_true and
    block at least; then pred is read once, for the cuts of the score range."""
    if b < 100:
        raise ValueError("at least 100 replicates")
    scored = "y_prob is not null and y_true is not null"
    cuts = kept(range_cuts(pred.where(scored), keys, "y_prob", parts))
    own = kept(_cells(pred.where(scored), [*keys, "y_prob", "y_true"], blocks)) if cells is None else None
    cells = (own if cells is None else cells).where(scored).join(F.broadcast(cuts), keys)
    cells = cells.select(*keys, range_bucket(F.col("y_prob"), F.col("_cuts"), parts.bit_length()).cast("long").alias("_part"), "y_prob", bin_of(F.col("y_prob")).alias("_bin"), "y_true", "_block", "c")
    sizes: dict[tuple, dict[int, int]] = {}
    for r in cells.groupBy(*keys, "_part").agg(F.sum("c").alias("n")).collect():
        sizes.setdefault(tuple(r[k] for k in keys), {})[r["_part"]] = r["n"]
    order = {key: number for number, key in enumerate(sorted(sizes))}
    nb, n_keys = len(EDGES) - 1, len(keys)
    names = ["w1", "w0", "u", "brier", *[f"{c}{i}" for c in "nsy" for i in range(nb)]]

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        who, k = tuple(key[:n_keys]), int(key[n_keys])
        mine = sorted(sizes[who].items())
        total = np.array([n for _, n in mine])
        size = np.random.default_rng([seed, order[who]]).multinomial(total.sum(), total / total.sum(), b)[:, [x for x, _ in mine].index(k)]
        rng = np.random.default_rng([seed, order[who], k + 2])
        p, at = np.unique(pdf.y_prob.to_numpy(float), return_inverse=True)
        m, y, of, c = len(p), pdf.y_true.to_numpy(int), pdf["_block"].to_numpy(int), pdf.c.to_numpy(int)
        bins = np.full(m, -1)
        bins[at] = pdf["_bin"].fillna(-1).to_numpy(int)
        cell = at + m * (y == 1)
        all_counts = np.bincount(cell, c, 2 * m).astype(np.int64)
        out, step = [], max(1, SLAB // (2 * m))
        for a in range(-1, b + blocks, step):  # -1 is the whole, then replicates, then the whole without each block
            reps = np.arange(a, min(a + step, b + blocks))
            w = np.repeat(all_counts[None], len(reps), 0)
            drawn = (reps >= 0) & (reps < b)
            if drawn.any():
                w[drawn] = rng.multinomial(size[reps[drawn]], all_counts / all_counts.sum())
            inside = of + b - a
            inside_ok = (inside >= 0) & (inside < len(reps))
            np.subtract.at(w, (inside[inside_ok], cell[inside_ok]), c[inside_ok])
            neg, pos = w[:, :m], w[:, m:]
            cols = [pos.sum(1), neg.sum(1), (pos * (np.cumsum(neg, 1) - neg / 2)).sum(1), pos @ (1 - p) ** 2 + neg @ p**2]
            for x in (pos + neg, (pos + neg) * p, pos):
                cols += [x[:, bins == i].sum(1) for i in range(nb)]
            out.append(pd.DataFrame({"rep": reps} | {n: np.asarray(v, float) for n, v in zip(names, cols)}))
        got = pd.concat(out)
        for name, value in zip([*keys, "_part"], key):
            got[name] = value
        return got

    typed = ", ".join(f"{k} {pred.schema[k].dataType.simpleString()}" for k in keys)
    got = cells.groupBy(*keys, "_part").applyInPandas(work, f"{typed}, _part long, rep long, " + ", ".join(f"{n} double" for n in names))
    before = Window.partitionBy(*keys, "rep").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("u", F.col("u") + F.col("w1") * F.coalesce(F.sum("w0").over(before), F.lit(0.0)))
    table = got.groupBy(*keys, "rep").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    let_go(cuts, *([own] if own is not None else []))
    out = []
    for key in order:
        mine = table[np.logical_and.reduce([table[k] == v for k, v in zip(keys, key)])].sort_values("rep")
        both = (mine.w1 > 0) & (mine.w0 > 0)
        whole, draws, left = (mine[(mine.rep >= lo) & (mine.rep < hi)] for lo, hi in ((-1, 0), (0, b), (b, b + blocks)))
        if not both[whole.index].all():
            out += [(*key, m, None, None, None, None, None, "percentile", False) for m in ("auroc", "brier", "ece", "mce", "cliffs_delta")]
            continue
        left = left[left.w1 + left.w0 < (whole.w1 + whole.w0).iloc[0]]  # blocks that have rows
        used = draws[both[draws.index]]
        out += _rows(key, _by_scores(used), _by_scores(whole), _by_scores(left[both[left.index]]), len(used) >= 0.5 * b, level, method)
    return _table(pred, keys, out)


def all_intervals(pred: DataFrame, keys: list[str], b: int = 1000, level: float = 0.95, method: str = "bca", blocks: int = 200, seed: int = 42) -> DataFrame:
    """Intervals of the metrics of counts and, for entities with scores, of those of scores; rows are counted once and written."""
    if b < 100:
        raise ValueError("at least 100 replicates")
    cells = kept(_cells(pred, [*keys, "y_prob", "y_true", "y_pred"], blocks))
    out = count_intervals(pred, keys, b, level, method, blocks, seed, cells).unionByName(score_intervals(pred, keys, b, level, method, blocks, seed, cells=cells))
    let_go(cells)
    return out


def forest(bounds: DataFrame, metric: str = "mcc") -> DataFrame:
    """entity, point, lower, upper of one metric, valid ones only, the least first."""
    return bounds.where(F.col("valid") & (F.col("metric") == metric)).select("entity", "point", "lower", "upper").orderBy("point", "entity")


def format_ci(point: F.Column, lower: F.Column, upper: F.Column, digits: int = 3) -> F.Column:
    """0.850 [0.823, 0.877]; without bounds the value alone."""
    one = lambda c: F.format_string(f"%.{digits}f", c.cast("double"))
    return F.when(lower.isNull() | upper.isNull(), one(point)).otherwise(F.concat(one(point), F.lit(" ["), one(lower), F.lit(", "), one(upper), F.lit("]")))


def format_p(p: F.Column, least: float = 0.001) -> F.Column:
    """Three decimals; below `least`, that it is below; nothing for null."""
    return F.when(p.isNull(), "").when(p < least, f"<{least}").otherwise(F.format_string("%.3f", p.cast("double")))


def percentile_interval(replicates: DataFrame, metric: str, level: float = 0.95) -> DataFrame:
    q = F.percentile(metric, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return replicates.groupBy("entity").agg(F.avg(metric).alias("mean"), q.alias("q")).select("entity", "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def jackknife(pred: DataFrame, blocks: int = 20) -> DataFrame:
    """entity, block, accuracy without the block."""
    block = F.conv(F.substring(F.md5(F.concat(F.lit("jack:"), F.col("sample_id").cast("string"))), 1, 8), 16, 10).cast("long") % blocks
    per = pred.groupBy("entity", block.alias("block")).agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("k"))
    total = per.groupBy("entity").agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    return per.join(F.broadcast(total), "entity").select("entity", "block", ((F.col("tk") - F.col("k")) / (F.col("tn") - F.col("n"))).alias("accuracy"))


def acceleration(left_out: DataFrame) -> DataFrame:
    """entity, a = sum d^3 / (6 (sum d^2)^1.5) with d the mean less each value."""
    m = left_out.groupBy("entity").agg(F.avg("accuracy").alias("m"))
    d = F.col("m") - F.col("accuracy")
    per = left_out.join(F.broadcast(m), "entity").groupBy("entity").agg(F.sum(d * d * d).alias("c"), F.sum(d * d).alias("s"))
    return per.select("entity", F.coalesce(F.try_divide(F.col("c"), 6 * F.pow("s", F.lit(1.5))), F.lit(0.0)).alias("a"))


def cliffs_delta(auroc: DataFrame) -> DataFrame:
    """Adds delta = 2 auroc - 1 and its band."""
    d = 2 * F.col("auroc") - 1
    band = F.when(F.abs(d) < 0.147, "negligible").when(F.abs(d) < 0.33, "small").when(F.abs(d) < 0.474, "medium").otherwise("large")
    return auroc.select("*", d.alias("delta"), band.alias("band"))
