"""Errors by confidence: how far from the operating threshold the wrong predictions lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.quantiles import exact

CUTS = (0.6, 0.7, 0.8, 0.9, 0.95)
TINY = 2.220446049250313e-16


def misclassified(pred: DataFrame, default: float = 0.5) -> DataFrame:
    """Rows with y_pred unlike y_true, with margin |p - t| and confidence, the margin as a part of its side."""
    t, p = F.coalesce("threshold", F.lit(default)), F.col("y_prob")
    side = F.when(p >= t, F.greatest(1 - t, F.lit(TINY))).otherwise(F.greatest(t, F.lit(TINY)))
    rows = pred.where("y_prob is not null and y_true != y_pred").withColumn("margin", F.abs(p - t))
    return rows.withColumn("confidence", F.least(F.greatest(F.col("margin") / side, F.lit(0.0)), F.lit(1.0)))


def _cut(cuts: tuple[float, ...] = CUTS) -> F.Column:
    return F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("confidence") >= c)).alias("cut")


def by_cut(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cut, n, pct (of rows), pct_errors, mean and sample deviation of confidence, mean margin; 0 where there is none."""
    wrong = misclassified(pred)
    totals = pred.where("y_prob is not null").groupBy(*keys).agg(F.count("*").alias("rows"))
    all_wrong = wrong.groupBy(*keys).agg(F.count("*").alias("errors"))
    per = wrong.select(*keys, "confidence", "margin", _cut()).groupBy(*keys, "cut").agg(F.count("*").alias("n"), F.avg("confidence").alias("mc"), F.stddev_samp("confidence").alias("sc"), F.avg("margin").alias("mm"))
    grid = totals.join(all_wrong, keys, "left").withColumn("cut", F.explode(F.array(*map(F.lit, CUTS))))
    out, zero = grid.join(per, [*keys, "cut"], "left"), F.lit(0)
    return out.select(
        *keys, "cut", F.coalesce("n", zero).cast("long").alias("n"), (100.0 * F.coalesce("n", zero) / F.col("rows")).alias("pct"), F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("errors").cast("double")), F.lit(0.0)).alias("pct_errors"),
        F.coalesce("mc", F.lit(0.0)).alias("mean_confidence"), F.coalesce("sc", F.lit(0.0)).alias("std_confidence"), F.coalesce("mm", F.lit(0.0)).alias("mean_margin"),
    )


def by_class(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cut, y_true, n, pct (of the cut's errors), mean and sample deviation of confidence (0 for one), and the class
    that it is most often taken for, with its count (the smaller class on ties)."""
    rows = misclassified(pred).select(*keys, "y_true", "y_pred", "confidence", _cut())
    out = rows.groupBy(*keys, "cut", "y_true").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("std_confidence"))
    to = rows.groupBy(*keys, "cut", "y_true", "y_pred").agg(F.count("*").alias("_n"))
    to = to.groupBy(*keys, "cut", "y_true").agg(F.min(F.struct((-F.col("_n")).alias("n"), "y_pred")).alias("_m"))
    total = F.sum("n").over(Window.partitionBy(*keys, "cut"))
    out = out.withColumn("pct", 100.0 * F.col("n") / total).join(to, [*keys, "cut", "y_true"])
    return out.select(*keys, "cut", "y_true", "n", "pct", "mean_confidence", "std_confidence", F.col("_m.y_pred").alias("confused_with"), (-F.col("_m.n")).alias("confused_n"))


def fold_report(pred: DataFrame) -> DataFrame:
    """entity, cut: mean and population deviation of n and pct over folds, mean of the confidences and margins of folds that
    have errors, and mean n of each true class; folds without errors count 0."""
    per = by_cut(pred, ["entity", "fold"])
    some = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    out = per.groupBy("entity", "cut").agg(F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("std_n"), F.avg("pct").alias("mean_pct"), F.stddev_pop("pct").alias("std_pct"), some("mean_confidence").alias("mean_confidence"), some("mean_margin").alias("mean_margin"))
    folds = pred.where("y_prob is not null").groupBy("entity").agg(F.count_distinct("fold").alias("_k"))
    wrong = misclassified(pred).select("entity", "y_true", _cut()).groupBy("entity", "cut").agg(F.count_if(F.col("y_true") == 0).alias("_0"), F.count_if(F.col("y_true") == 1).alias("_1"))
    out = out.join(folds, "entity").join(wrong, ["entity", "cut"], "left")
    mean = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("_k")
    return out.withColumn("mean_n_0", mean("_0")).withColumn("mean_n_1", mean("_1")).drop("_k", "_0", "_1")


def detail(pred: DataFrame) -> DataFrame:
    """entity: errors, those missed, mean, sample deviation and quartiles of confidence and of margin."""
    wrong = misclassified(pred)
    out = wrong.groupBy("entity").agg(F.count("*").alias("n"), F.count_if((F.col("y_true") == 1)).cast("long").alias("n_missed"), F.avg("confidence").alias("mean_confidence"), F.stddev_samp("confidence").alias("std_confidence"), F.avg("margin").alias("mean_margin"), F.stddev_samp("margin").alias("std_margin"))
    for c, tag in (("confidence", ""), ("margin", "margin_")):
        q = exact(wrong, ["entity"], c, [0.25, 0.5, 0.75], "_q")
        out = out.join(q, "entity").select(*out.columns, F.col("_q")[0].alias(f"{tag}q25"), F.col("_q")[1].alias(f"{tag}median"), F.col("_q")[2].alias(f"{tag}q75"))
    return out


def confusions(pred: DataFrame) -> DataFrame:
    """entity, y_true, y_pred, n of the errors."""
    return misclassified(pred).groupBy("entity", "y_true", "y_pred").agg(F.count("*").alias("n"))


def report_line(pred: DataFrame, cut: float = 0.9) -> DataFrame:
    """entity, mean_confident (errors at or above the cut, mean over folds), errors (all of them)."""
    per = fold_report(pred).where(F.col("cut") == cut).select("entity", F.col("mean_n").alias("mean_confident"))
    return per.join(misclassified(pred).groupBy("entity").agg(F.count("*").alias("errors")), "entity", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def box(pred: DataFrame, column: str) -> DataFrame:
    """entity, wrong, n, least, q25, median, q75, most of a number for right and wrong predictions."""
    rows = pred.where(F.col(column).isNotNull()).select("entity", (F.col("y_true") != F.col("y_pred")).cast("int").alias("wrong"), F.col(column).cast("double").alias("_x"))
    keys = ["entity", "wrong"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most"))
    return out.join(exact(rows, keys, "_x", [0.25, 0.5, 0.75]), keys).select(*keys, "n", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "most")


def by_category(pred: DataFrame, category: str) -> DataFrame:
    """entity, fold, category, share of rows that are wrong."""
    return pred.groupBy("entity", "fold", category).agg(F.avg((F.col("y_true") != F.col("y_pred")).cast("double")).alias("share"))


def histogram(pred: DataFrame, bins: int = 30) -> DataFrame:
    """entity, bin, n, density: confidence of errors in equal bins over [0, 1], the last closed; densities integrate to 1."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    out = misclassified(pred).groupBy("entity", b.alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("density", F.col("n") * F.lit(float(bins)) / F.sum("n").over(Window.partitionBy("entity")))


def confidence_summary(pred: DataFrame) -> DataFrame:
    """entity, mean, median, std (population) of the confidence of errors."""
    wrong = misclassified(pred)
    out = wrong.groupBy("entity").agg(F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std"))
    return out.join(exact(wrong, ["entity"], "confidence", [0.5]), "entity").select("entity", "mean", F.col("q")[0].alias("median"), "std")
