"""Cells of train-by-test matrices, generalisation gaps, rankings and ablation statistics, from small relations of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import metrics, paired


def cells(fold_values: DataFrame) -> DataFrame:
    """mean, population deviation and number of folds by (model, metric, source, target)."""
    return fold_values.groupBy("model", "metric", "source", "target").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_folds"))


def carried(pred: DataFrame, folds: int) -> DataFrame:
    """model, metric, source, target, fold, value of scores (entity, dataset, fold, y_true, y_prob) whose threshold is carried over:
    that of a source's other folds (Youden) is used on the fold of every dataset.

    A row helps to choose the thresholds of all folds but its own, so the curves see it `folds` - 1 times."""
    rows = pred.where("y_prob is not null")
    others = rows.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_out != fold")
    keys = ["entity", "source", "fold"]
    cut = metrics.youden(others.select("entity", F.col("dataset").alias("source"), F.col("_out").alias("fold"), "y_true", "y_prob"), keys)
    cut = cut.select(*keys, F.when(F.col("j") > 0, F.col("threshold")).otherwise(0.5).alias("_t"))  # a row for each entity, dataset and fold
    tested = rows.select("entity", "dataset", "fold", "y_true", "y_prob").join(F.broadcast(cut), ["entity", "fold"])
    tested = tested.withColumn("y_pred", (F.col("y_prob") >= F.col("_t")).cast("int")).withColumnRenamed("dataset", "target")
    by = ["entity", "source", "target", "fold"]
    wide = metrics.confusion(tested, by).select(*by, *[c.alias(n) for n, c in metrics.scores().items()])
    own = pred.where("y_prob is not null").withColumnRenamed("dataset", "target")
    for part in (metrics.auroc, metrics.brier, metrics.calibration_error):
        wide = wide.join(part(own, ["entity", "target", "fold"]), ["entity", "target", "fold"], "left")
    names = [*metrics.scores(), "auroc", "brier", "ece", "mce"]
    return metrics.long(wide, by, names).select(F.col("entity").alias("model"), "metric", "source", "target", "fold", "value")


def gap(fold_values: DataFrame) -> DataFrame:
    """model, metric, source, gap, n_folds: in-dataset value less the mean over targets, over folds that all cells have."""
    per = fold_values.where("value is not null").groupBy("model", "metric", "source", "fold").agg(F.max(F.when(F.col("source") == F.col("target"), F.col("value"))).alias("own"), F.avg(F.when(F.col("source") != F.col("target"), F.col("value"))).alias("cross"), F.count_distinct("target").alias("k"))
    full = per.withColumn("most", F.max("k").over(Window.partitionBy("model", "metric"))).where("k = most and own is not null and cross is not null")
    return full.groupBy("model", "metric", "source").agg(F.avg(F.col("own") - F.col("cross")).alias("gap"), F.count("*").alias("n_folds"))


def same_and_cross(cell: DataFrame) -> DataFrame:
    same = F.col("source") == F.col("target")
    return cell.groupBy("model", "metric").agg(F.avg(F.when(same, F.col("mean"))).alias("same"), F.avg(F.when(~same, F.col("mean"))).alias("cross"), F.stddev_samp(F.when(~same, F.col("mean"))).alias("spread")).withColumn("gap", F.col("same") - F.col("cross"))


def best_and_worst(cell: DataFrame, n: int = 3) -> DataFrame:
    """The n best and n worst cross cells of each model and metric."""
    rows = cell.where("source != target")
    w = Window.partitionBy("model", "metric")
    up = F.row_number().over(w.orderBy(F.desc("mean"), "source", "target"))
    down = F.row_number().over(w.orderBy("mean", "source", "target"))
    rows = rows.select("model", "metric", "source", "target", "mean", up.alias("best_rank"), down.alias("worst_rank"))
    return rows.where((F.col("best_rank") <= n) | (F.col("worst_rank") <= n))


def difficulty(cell: DataFrame) -> DataFrame:
    return cell.where("source != target").groupBy("model", "metric", "target").agg(F.avg("mean").alias("mean"))


def stability(cell: DataFrame) -> DataFrame:
    return cell.groupBy("model").agg((1 / (1 + F.avg("std"))).alias("stability"))


def importance_ranks(importance: DataFrame) -> DataFrame:
    """entity, feature, mean, population deviation, dense rank by mean."""
    per = importance.groupBy("entity", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return per.withColumn("rank", F.dense_rank().over(Window.partitionBy("entity").orderBy(F.desc("mean"))))


def top_frequency(ranks: DataFrame, n: int = 10) -> DataFrame:
    return ranks.where(F.col("rank") <= n).groupBy("feature").agg(F.count("*").alias("times"))


def best_model(scores: DataFrame) -> DataFrame:
    return scores.groupBy("entity").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"), "entity").limit(1)


def best_per_metric(scores: DataFrame, lower: tuple[str, ...] = ("brier", "ece", "mce")) -> DataFrame:
    """metric, entity, mean: the best, the first by name on ties; for some metrics the least is best."""
    per = scores.groupBy("metric", "entity").agg(F.avg("value").alias("mean")).where("mean is not null")
    sign = F.when(F.col("metric").isin(*lower), F.col("mean")).otherwise(-F.col("mean"))
    return per.groupBy("metric").agg(F.min(F.struct(sign.alias("s"), "entity", "mean")).alias("b")).select("metric", "b.entity", "b.mean")


def fold_gaps(fold_values: DataFrame) -> DataFrame:
    """model, metric, source, fold, gap: the paired gap of each fold, as `gap` averages them."""
    per = fold_values.where("value is not null").groupBy("model", "metric", "source", "fold").agg(F.max(F.when(F.col("source") == F.col("target"), F.col("value"))).alias("own"), F.avg(F.when(F.col("source") != F.col("target"), F.col("value"))).alias("cross"), F.count_distinct("target").alias("k"))
    full = per.withColumn("most", F.max("k").over(Window.partitionBy("model", "metric"))).where("k = most and own is not null and cross is not null")
    return full.select("model", "metric", "source", "fold", (F.col("own") - F.col("cross")).alias("gap"))


def bootstrap_means(df: DataFrame, keys: list[str], value: str, order: list[str], b: int = 1000, seed: str = "mean") -> DataFrame:
    """keys, replicate, mean of n values drawn from the n of a key by a hash of seed, replicate and draw.

    For values of folds or cells: a key's values are one row's array, its replicates are dealt out."""
    one = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_v"))
    draws = one.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).select(*keys, "replicate", "_v", F.posexplode("_v").alias("_j", "_x"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", "_j")), 1, 8), 16, 10).cast("long") % F.size("_v")
    return draws.groupBy(*keys, "replicate").agg(F.avg(F.get("_v", pick.cast("int"))[value]).alias("mean"))


def mean_interval(df: DataFrame, keys: list[str], value: str, order: list[str], b: int = 1000, level: float = 0.95, seed: str = "mean") -> DataFrame:
    """keys, mean, lower, upper, n: percentiles of the replicates of a mean over folds; one value gives itself."""
    reps = bootstrap_means(df, keys, value, order, b, seed)
    q = F.percentile("mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    ends = reps.groupBy(*keys).agg(q.alias("_q"))
    point = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return point.join(ends, keys).select(*keys, "mean", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "n")


def gap_interval(fold_values: DataFrame, b: int = 1000, level: float = 0.95) -> DataFrame:
    """model, metric, source, mean, lower, upper, n of the paired gaps of folds."""
    return mean_interval(fold_gaps(fold_values), ["model", "metric", "source"], "gap", ["fold"], b, level, "gap")


def group_gap_interval(cell: DataFrame, b: int = 1000, level: float = 0.95) -> DataFrame:
    """model, metric, gap, lower, upper: same-dataset cells less cross cells, each group drawn by itself; null bounds with
    fewer than two cells in a group."""
    side = F.when(F.col("source") == F.col("target"), "same").otherwise("cross").alias("side")
    rows = cell.where("mean is not null").select("model", "metric", side, "source", "target", F.col("mean").alias("value"))
    keys = ["model", "metric"]
    reps = bootstrap_means(rows, [*keys, "side"], "value", ["source", "target"], b, "group")
    diff = reps.groupBy(*keys, "replicate").agg((F.max(F.when(F.col("side") == "same", F.col("mean"))) - F.max(F.when(F.col("side") == "cross", F.col("mean")))).alias("d"))
    ends = diff.groupBy(*keys).agg(F.percentile("d", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("_q"))
    same = F.col("side") == "same"
    point = rows.groupBy(*keys).agg((F.avg(F.when(same, F.col("value"))) - F.avg(F.when(~same, F.col("value")))).alias("gap"), F.least(F.count_if(same), F.count_if(~same)).alias("_n"))
    bound = lambda i: F.when(F.col("_n") >= 2, F.col("_q")[i])
    return point.join(ends, keys).select(*keys, "gap", bound(0).alias("lower"), bound(1).alias("upper"))


def search_summary(history: DataFrame) -> DataFrame:
    """rank, parameters, mean, std (population), cv_pct, least, most, spread over inner folds, best first."""
    v = F.col("value")
    out = history.groupBy("rank", "parameters").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    return out.select("rank", "parameters", "mean", "std", F.coalesce(100 * F.try_divide(F.col("std"), F.col("mean")), F.lit(0.0)).alias("cv_pct"), "least", "most", (F.col("most") - F.col("least")).alias("spread"))


def search_overview(history: DataFrame) -> DataFrame:
    """candidates, best, mean, std, least, most of the candidates' mean scores: one row for a search."""
    per = history.groupBy("rank").agg(F.avg("value").alias("m"))
    return per.agg(F.count("*").alias("candidates"), F.max("m").alias("best"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.min("m").alias("least"), F.max("m").alias("most"))


def ablation(scores: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """keys, baseline, ablated, delta, delta_pct, t, d_av, n over paired folds of (keys, fold, baseline, ablated)."""
    d = F.col("baseline") - F.col("ablated")
    per = scores.groupBy(*keys).agg(F.avg("baseline").alias("b"), F.avg("ablated").alias("a"), F.stddev_samp("baseline").alias("sb"), F.stddev_samp("ablated").alias("sa"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n"))
    delta = F.col("b") - F.col("a")
    return per.select(
        *keys, F.col("b").alias("baseline"), F.col("a").alias("ablated"), delta.alias("delta"), F.coalesce(100 * F.try_divide(delta, F.col("b")), F.lit(0.0)).alias("delta_pct"),
        F.try_divide(delta, F.col("sd") / F.sqrt("n")).alias("t"), F.try_divide(delta, F.sqrt((F.col("sb") * F.col("sb") + F.col("sa") * F.col("sa")) / 2)).alias("d_av"), "n",
    )


def ablation_tests(scores: DataFrame, alpha: float = 0.05, keys: tuple[str, ...] = ("metric", "name")) -> DataFrame:
    """As `ablation`, with the paired t test's p, Holm over the finite ones of a metric, and whether it is below alpha.

    p needs the t distribution, which Spark lacks: it is computed on the driver from one row for each ablation."""
    table = ablation(scores, keys)
    rows = [(*r, None if r.t is None or r.n < 2 else stats.student_two_sided(r.t, r.n - 1)) for r in table.collect()]
    tests = scores.sparkSession.createDataFrame(rows, table.schema.add("p", "double"))
    fine = paired.holm(tests.where("p is not null"), family=keys[0], tie=keys[-1])
    return fine.unionByName(tests.where("p is null"), allowMissingColumns=True).withColumn("significant", F.coalesce(F.col("p_holm") < alpha, F.lit(False)))


def top_ablations(tests: DataFrame, k: int = 10, significant_only: bool = False) -> DataFrame:
    """The k ablations that cost most, by metric."""
    rows = tests.where("significant") if significant_only else tests
    at = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("delta"), "name"))
    return rows.withColumn("at", at).where(F.col("at") <= k).drop("at")
