"""Metrics over a prediction relation (entity, fold, sample_id, y_true, y_prob, y_pred): one aggregation, then projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rounding import rounded
from plumbline.functions.windows import running

#: The edges of ten equal bins, as a float grid of tenths has them.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def confusion(pred: DataFrame, keys: list[str], y_pred: Column | None = None) -> DataFrame:
    """keys, tp, fp, tn, fn."""
    y, p = F.col("y_true"), F.col("y_pred") if y_pred is None else y_pred
    return pred.groupBy(*keys).agg(
        count_if((y == 1) & (p == 1)).alias("tp"), count_if((y == 0) & (p == 1)).alias("fp"), count_if((y == 0) & (p == 0)).alias("tn"), count_if((y == 1) & (p == 0)).alias("fn")
    )


def scores() -> dict[str, Column]:
    """Metrics as expressions of tp, fp, tn, fn; a class that is not there counts 0, as does an empty denominator."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n1, n0 = tp + fn, tn + fp
    f0, f1 = ratio(2 * tn, 2 * tn + fn + fp), ratio(2 * tp, 2 * tp + fp + fn)
    r0, r1 = ratio(tn, n0), ratio(tp, n1)
    return {
        "precision_0": ratio(tn, tn + fn), "precision_1": ratio(tp, tp + fp), "recall_0": r0, "recall_1": r1, "f1_0": f0, "f1_1": f1,
        "f1_weighted": ratio(n0 * f0 + n1 * f1, n0 + n1),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "balanced_accuracy": F.when(n1 == 0, r0).when(n0 == 0, r1).otherwise((r0 + r1) / 2),
    }


def auroc(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auroc by mid-ranks of distinct scores; null with one class only."""
    return area(pred.where("y_prob is not null").groupBy(*keys, "y_prob").agg(F.sum("y_true").alias("pos"), F.count("*").alias("n")), keys)


def area(by: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auroc from (keys, y_prob, pos, n): the rows, and those of class 1, at each distinct score."""
    by = running(by, keys, "y_prob", {"upto": "n"})
    mid = F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2.0)
    out = by.groupBy(*keys).agg(F.sum(mid).alias("r"), F.sum("pos").cast("double").alias("n1"), F.sum("n").cast("double").alias("n"))
    return out.select(*keys, F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * (F.col("n") - F.col("n1"))).alias("auroc"))


def brier(pred: DataFrame, keys: list[str]) -> DataFrame:
    return pred.where("y_prob is not null").groupBy(*keys).agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), 2)).alias("brier"))


def bin_of(p: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """0-based bin (lo, hi], the first closed below; null outside."""
    out = F.when((p >= edges[0]) & (p <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((p > edges[i]) & (p <= edges[i + 1]), i)
    return out


def reliability(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, n, mean_prob, positive_rate."""
    rows = pred.where("y_prob is not null").withColumn("bin", bin_of(F.col("y_prob"))).where("bin is not null")
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("y_prob").alias("mean_prob"), F.avg("y_true").alias("positive_rate"))


def calibration_error(pred: DataFrame, keys: list[str]) -> DataFrame:
    bins = reliability(pred, keys)
    gap = F.abs(F.col("positive_rate") - F.col("mean_prob"))
    total = pred.where("y_prob is not null").groupBy(*keys).agg(F.count("*").alias("total"))
    return bins.groupBy(*keys).agg(F.sum(F.col("n") * gap).alias("s"), F.max(gap).alias("mce")).join(total, keys).select(*keys, (F.col("s") / F.col("total")).alias("ece"), "mce")


def curve(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y_prob, tp, fp, fpr, tpr, prec at each distinct score as threshold."""
    by = pred.where("y_prob is not null").groupBy(*keys, "y_prob").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    by = running(by, keys, "y_prob", {"tp": "pos", "fp": "neg"}, descending=True)
    total = pred.where("y_prob is not null").groupBy(*keys).agg(F.sum("y_true").alias("n1"), F.sum(1 - F.col("y_true")).alias("n0"))
    tpr, fpr = ratio(F.col("tp"), F.col("n1")), ratio(F.col("fp"), F.col("n0"))
    return by.join(total, keys).select(*keys, "y_prob", F.col("tp").cast("long"), F.col("fp").cast("long"), fpr.alias("fpr"), tpr.alias("tpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("prec"))


def youden(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold, j, sens, spec: the highest threshold with the largest tpr - fpr, compared at 12 decimals."""
    rows = curve(pred, keys).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = F.max(F.struct(rounded("j", 12).alias("key"), "y_prob", "j", "tpr", "fpr")).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, F.col("b.y_prob").alias("threshold"), F.col("b.j").alias("j"), F.col("b.tpr").alias("sens"), (1 - F.col("b.fpr")).alias("spec"))


def at_threshold(pred: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """keys, sens, spec, j when scores at or above the threshold count as positive."""
    counts = confusion(pred.where("y_prob is not null"), keys, (F.col("y_prob") >= threshold).cast("int"))
    sens, spec = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return counts.select(*keys, sens.alias("sens"), spec.alias("spec"), (sens + spec - 1).alias("j"))


def method_for(n: int, cut: int = 1000) -> str:
    """How a threshold is chosen: from all out-of-fold scores of few rows, else as the mean of those of the folds."""
    return "oof" if n < cut else "cv"


def fold_mean(c: str) -> Column:
    """The mean of few values at twelve decimals: whatever the order in which they are added, a mean that lies halfway
    between two shorter numbers is the same double, and is rounded alike later."""
    return rounded(F.avg(c), 12)


def cv_threshold(oof: DataFrame) -> DataFrame:
    """entity, threshold: the mean of the folds' Youden thresholds."""
    return youden(oof, ["entity", "fold"]).groupBy("entity").agg(fold_mean("threshold").alias("threshold"))


def threshold_of(oof: DataFrame, method: str) -> float:
    """The threshold of one entity's out-of-fold scores; 0.5 where no threshold beats chance."""
    best = youden(oof, ["entity"]).first()
    if best is None or best.j <= 0:
        return 0.5
    return float(best.threshold if method == "oof" else cv_threshold(oof).first().threshold)


def default_against_own(values: DataFrame) -> DataFrame:
    """metric, at_default, at_own, difference from (entity: default or own, metric, value)."""
    pick = lambda e: F.max(F.when(F.col("entity") == e, F.col("value")))
    return values.groupBy("metric").agg(pick("default").alias("at_default"), pick("own").alias("at_own")).withColumn("difference", F.col("at_own") - F.col("at_default"))


def class_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label (0, 1, macro, weighted), precision, recall, f1, support from confusion counts."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n0, n1 = tn + fp, tp + fn
    p = [ratio(tn, tn + fn), ratio(tp, tp + fp)]
    r = [ratio(tn, n0), ratio(tp, n1)]
    f = [ratio(2 * tn, 2 * tn + fn + fp), ratio(2 * tp, 2 * tp + fp + fn)]
    row = lambda label, x, n: F.struct(F.lit(label).alias("label"), x(p).alias("precision"), x(r).alias("recall"), x(f).alias("f1"), n.cast("long").alias("support"))
    rows = F.array(row("0", lambda v: v[0], n0), row("1", lambda v: v[1], n1), row("macro", lambda v: (v[0] + v[1]) / 2, n0 + n1), row("weighted", lambda v: ratio(n0 * v[0] + n1 * v[1], n0 + n1), n0 + n1))
    return counts.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def summary(fold_metrics: DataFrame) -> DataFrame:
    """entity, metric, mean, sample std, min, max, median over folds, from (entity, fold, metric, value)."""
    v = F.col("value")
    return fold_metrics.groupBy("entity", "metric").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.expr("percentile(value, 0.5)").alias("median"))


def summary_text(fold_summary: DataFrame, digits: int = 3) -> DataFrame:
    """entity, metric, text: mean ± deviation of a `summary`; of one fold the mean alone."""
    one = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    return fold_summary.select("entity", "metric", F.when(F.col("std").isNull(), one("mean")).otherwise(F.concat_ws(" ± ", one("mean"), one("std"))).alias("text"))


def long(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.metric", "m.value")


def all_metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys and every metric; those of scores are null for entities without."""
    wide = confusion(pred, keys).select(*keys, *[c.alias(n) for n, c in scores().items()])
    for part in (auroc(pred, keys), brier(pred, keys), calibration_error(pred, keys)):
        wide = wide.join(part, keys, "left")
    return wide


def confusion_normalized(pred: DataFrame, keys: list[str]) -> DataFrame:
    cells = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    return cells.select(*keys, "y_true", "y_pred", (F.col("n") / total).alias("share"))
