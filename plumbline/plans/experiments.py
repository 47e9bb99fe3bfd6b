"""Whole runs: comparison of models and rules, datasets against each other, final training, scoring, ablation.

Each returns small tables by name; predictions of every row go to a store and are read back from there, fold by fold,
so that a run that ended early goes on with the folds that are missing.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.storage import kept
from plumbline.operators import clean, errors, explain, folds, intervals, metrics, models, paired, profile, replicates, rules, shift, transfer
from plumbline.settings import Settings
from plumbline.sources import artifacts
from plumbline.sources.files import PredictionStore, run_key

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


#: Equal rows that a task numbers together.
BLOCK = 4096


def numbered(df: DataFrame, name: str = "sample_id") -> DataFrame:
    """df with an id from the content of each row; equal rows are told apart by a number.

    It does not depend on files, partitions or the order of rows: rows are counted by content and dealt out again."""
    cols = df.columns
    rows = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").cast("int").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / BLOCK).cast("int"))))
    rows = rows.repartition(parts, *[F.col(f"`{c}`") for c in cols], "_b")  # a content that many rows have is dealt out in blocks
    rows = rows.withColumn("_k", F.explode(F.sequence(F.col("_b") * BLOCK + 1, F.least("_n", (F.col("_b") + 1) * BLOCK))))
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]))
    return rows.withColumn(name, F.md5(F.concat_ws(":", content, "_k"))).select(*[F.col(f"`{c}`") for c in cols], name)


def prepared(df: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """df with sample_id, and the features: those named, or every number but target, id and rules.

    Without an id column the id is made from the row's content (see `numbered`)."""
    features = s.features or [c for c, t in df.dtypes if t in NUMBERS and c not in (s.target, s.id_column, "sample_id", "dataset", *s.rules)]
    gone = [c for c in (s.target, *features, *s.rules) if c not in df.columns]
    if gone:
        raise ValueError(f"no columns {gone}")
    rows = clean.nan_to_null(df)
    if s.id_column:
        rows = rows.withColumn("sample_id", F.col(s.id_column))
    elif "sample_id" not in df.columns:
        rows = numbered(rows)
    rows = rows.where(F.col(s.target).isNotNull())
    return (clean.drop_missing(rows, features) if s.missing == "drop" else rows), features


def written(df: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """As `prepared`, with the rows written once, for every model, rule and interval of a run reads them."""
    rows, features = prepared(df, s)
    return kept(rows), features


def plan(name: str, s: Settings) -> models.Plan:
    """How the settings have a model made; searches choose inside the training rows of each fold, from the settings' own grid
    of the model where they have one."""
    own = [dict(zip(s.grids[name], v)) for v in product(*s.grids[name].values())] if name in s.grids else models.REGISTRY[name][1]
    grid = own if s.search or s.search_budget or name in s.grids else None
    return models.Plan(name, s.parameters.get(name, {}), grid, s.inner, s.search_budget, s.search_seconds, None if s.missing == "drop" else s.missing, s.scale, s.calibration_folds if s.calibrate else 0, s.calibration, True, s.seed)


def compare(df: DataFrame, s: Settings, out: str) -> dict[str, DataFrame]:
    """Out-of-fold predictions of each model and of each rule, held against each other."""
    rows, features = written(df, s)
    key, store = run_key(vars(s), df), PredictionStore(df.sparkSession, f"{out}/predictions")
    for name in s.models:
        missing = sorted(set(range(s.outer)) - store.have(key, "all", name))
        if missing:
            fitted: dict = {}
            for i, part in models.out_of_fold_parts(rows, features, s.target, plan(name, s), s.outer, s.seed, missing, fitted):
                store.put_fold(part, key, "all", name, i, None if name == "knn" else fitted.pop(i))
    pred = store.get(key).withColumn("entity_type", F.lit("model"))
    found = learned(rows, features, s, store, key, f"{out}/explanations")
    if s.rules:
        rules.validate(rows, s.rules, s.target)
        expressions = [*(rules.defaults(s.rules) if s.default_combinations and len(s.rules) > 1 else []), *s.combinations]
        dealt = folds.stratified(rows, s.outer, s.target, "sample_id", seed=s.seed).withColumn("y_true", F.col(s.target).cast("int"))
        pred = pred.unionByName(rules.predictions(dealt, s.rules, expressions, ["sample_id", "fold", "y_true"]), allowMissingColumns=True)
    names = [*metrics.scores(), "auroc", "brier", "ece", "mce"]
    by_fold = metrics.all_metrics(pred, ["entity", "fold"])
    long = metrics.long(by_fold, ["entity", "fold"], [n for n in names if n in by_fold.columns])
    summary = metrics.summary(long)
    bounds = intervals.all_intervals(pred, ["entity"], s.bootstrap, s.level, seed=s.seed)
    wrong = errors.misclassified(pred.where("y_prob is not null"))
    return {
        "metrics": metrics.all_metrics(pred, ["entity"]),
        "metrics_by_fold": summary.join(bounds.select("entity", "metric", F.col("mean").alias("mean_bootstrap"), "lower", "upper"), ["entity", "metric"], "left"),
        "summary_text": metrics.summary_text(summary),
        "intervals": bounds,
        "forest": intervals.forest(bounds, s.primary),
        "pairwise": paired.compare(pred, s.correction, 1 - s.level, s.level),
        "errors": errors.fold_report(pred.where("y_prob is not null")),
        "error_detail": errors.detail(pred.where("y_prob is not null")),
        "misclassified": wrong.select("entity", "fold", "sample_id", "y_true", "y_pred", "y_prob", "confidence"),
        "best_parameters": pred.where("parameters is not null").select("entity", "fold", "parameters", "threshold").distinct(),
        "profile": profile.continuous(rows, features),
        "correlations": profile.correlation_matrix(rows, features),
        "best": summary.where(F.col("metric") == s.primary).select("entity", F.col("mean").alias(s.primary)).orderBy(F.desc(s.primary), "entity").limit(1),
    } | found


def learned(rows: DataFrame, features: list[str], s: Settings, store: PredictionStore, key: str, folder: str) -> dict[str, DataFrame]:
    """What the models of the folds have learned: importances by fold and their ranks; and, where settings ask for it, the
    shares of the features in each score (of tree and linear models), kept in a cache that later runs read."""
    spark, each, shares = rows.sparkSession, [], []
    cache = explain.Cache(spark, folder)
    dealt = folds.stratified(rows, s.outer, s.target, "sample_id", seed=s.seed) if s.explain else None
    for name in s.models:
        for i in sorted(store.have(key, "all", name)):
            model = None if name == "knn" else store.model(key, "all", name, i)
            if model is None:
                continue
            each += [(name, i, f, float(v)) for f, v in models.importances(model, features)]
            if s.explain and explain.explained_stage(model) is not None:
                test = dealt.where(F.col("fold") == i)
                digest = cache.digest(test, features, key)
                got = cache.get(name, i, digest)
                if got is None:
                    got = cache.put(explain.explain(model, test, features, dealt.where(F.col("fold") != i)), name, i, digest)
                shares.append(got.select(F.lit(name).alias("entity"), F.lit(i).alias("fold"), "sample_id", "base", "phi", "score"))
    by_fold = spark.createDataFrame(each, "entity string, fold int, feature string, value double")
    out = {"importances_by_fold": by_fold, "importances": transfer.importance_ranks(by_fold)}
    if shares:
        every = reduce(DataFrame.unionByName, shares)
        out |= {"explanations": every, "mean_shares": explain.mean_shares(every, ["entity"])}
    if s.explain:
        out["explanation_cache"] = spark.createDataFrame([(cache.hits, cache.misses)], "read int, computed int")
    return out


def cross(df: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Each dataset's model on every dataset by all metrics, gaps, models without one dataset, class priors and shift; folds
    that failed are listed and left out."""
    rows, features = written(df, s)
    failed: list[tuple] = []
    cut: list[tuple] = []
    values = []
    for name in s.models:
        gone, at = [], []
        values.append(models.cross(rows, features, s.target, plan(name, s), s.outer, s.seed, metrics=replicates.BUILT_IN, failures=gone, thresholds=at))
        failed += [(name, *f) for f in gone]
        cut += [(name, *t) for t in sorted(at)]
    values = reduce(DataFrame.unionByName, values)
    cells, spark = transfer.cells(values), df.sparkSession
    out = {"fold_values": values, "cells": cells, "gap": transfer.gap_interval(values, s.bootstrap, s.level), "group_gap": transfer.group_gap_interval(cells, s.bootstrap, s.level), "same_and_cross": transfer.same_and_cross(cells), "difficulty": transfer.difficulty(cells), "stability": transfer.stability(cells)}
    if rows.select("dataset").distinct().count() >= 3:
        held = []
        for name in s.models:
            gone = []
            pred = models.held_out_predictions(rows, features, s.target, plan(name, s), gone).persist()
            failed += [(name, *f) for f in gone]
            bounds = intervals.all_intervals(pred, ["entity"], s.bootstrap, s.level, seed=s.seed).where("metric != 'cliffs_delta'")
            held.append(bounds.select(F.lit(name).alias("model"), F.col("entity").alias("held_out"), "metric", F.col("point").alias("value"), "lower", "upper"))
        pairwise = transfer.difficulty(cells).select("model", "metric", F.col("target").alias("held_out"), F.col("mean").alias("pairwise_mean"))
        out["held_out"] = reduce(DataFrame.unionByName, held).join(pairwise, ["model", "metric", "held_out"], "left").withColumn("delta", F.col("value") - F.col("pairwise_mean"))
    out["failed"] = spark.createDataFrame(failed, "model string, source string, fold int, error string")
    out["thresholds"] = spark.createDataFrame(cut, "model string, source string, fold int, threshold double")
    return out | {"priors": profile.class_priors(rows, s.target), "shift": shift.ks(rows, features)}


def train(df: DataFrame, s: Settings, name: str, path: str) -> dict:
    """Fits one model to all rows, with the threshold of out-of-fold scores, and saves it; its search and its importances
    are saved beside it."""
    if name == "knn":
        raise ValueError("knn keeps its training rows and cannot be saved; it can be compared")
    rows, features = written(df, s)
    p, spark = plan(name, s), df.sparkSession
    best, trials = models.chosen_with_history(rows, features, s.target, p)
    oof = models.out_of_fold(rows, features, s.target, models.replace(p, tune=False), s.outer, s.seed)
    method = metrics.method_for(rows.count())
    threshold = metrics.threshold_of(oof, method)
    model = models.trained(rows, features, s.target, p, best)
    meta = {"name": name, "features": features, "target": s.target, "parameters": best, "threshold": threshold, "threshold_method": method, "calibrated": bool(p.calibrate), "settings": vars(s)}
    artifacts.save_model(spark, model, path, **meta)
    if trials:
        transfer.search_summary(models.history_table(spark, trials)).write.mode("overwrite").parquet(f"{path}/cv_results")
    table = models.importances(model, features)
    spark.createDataFrame(table, "feature string, importance double").write.mode("overwrite").parquet(f"{path}/importances")
    return meta


def predict(df: DataFrame, path: str, id_column: str | None = None, threshold: float | None = None, proba: bool = True) -> DataFrame:
    """[id,] prediction, or with `proba` [id,] prob_class_0, prob_class_1, predicted_class, optimal_threshold,
    prob_diff_to_threshold; rows with nulls in features are scored only by models that fill them."""
    model, meta = artifacts.load_model(df.sparkSession, path)
    scored = models.score(model, clean.nan_to_null(df), meta["features"])
    return laid_out(scored, meta["threshold"] if threshold is None else threshold, [id_column] if id_column else [], proba)


def laid_out(scored: DataFrame, threshold: float, keep: list[str], proba: bool = True) -> DataFrame:
    """The columns that `predict` gives, of rows with y_prob."""
    p, positive = F.col("y_prob"), (F.col("y_prob") >= threshold).cast("int")
    if not proba:
        return scored.select(*keep, positive.alias("prediction"))
    return scored.select(*keep, (1 - p).alias("prob_class_0"), p.alias("prob_class_1"), positive.alias("predicted_class"), F.lit(float(threshold)).alias("optimal_threshold"), (p - threshold).alias("prob_diff_to_threshold"))


def evaluate(df: DataFrame, path: str, threshold: float | None = None) -> dict[str, DataFrame]:
    """Metrics of a saved model on labelled rows at 0.5 and at its own threshold (or the one given), their difference,
    confusion and per-class report at the latter."""
    _, meta = artifacts.load_model(df.sparkSession, path)
    own = meta["threshold"] if threshold is None else threshold
    rows = df.where(F.col(meta["target"]).isNotNull()).withColumn("y_true", F.col(meta["target"]).cast("int"))
    scored = predict(rows, path, "y_true", own).select("y_true", F.col("prob_class_1").alias("y_prob"))
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("entity"), F.lit(float(t)).alias("threshold")) for n, t in (("default", 0.5), ("own", own))]))
    pred = scored.select("y_true", "y_prob", both.alias("e")).select("e.entity", "e.threshold", "y_true", "y_prob", (F.col("y_prob") >= F.col("e.threshold")).cast("int").alias("y_pred"))
    table = metrics.all_metrics(pred, ["entity"])
    values = metrics.long(table, ["entity"], [c for c in table.columns if c != "entity"])
    mine = pred.where("entity = 'own'").withColumn("entity", F.lit(meta["name"]))
    return {"metrics": metrics.all_metrics(mine, ["entity"]), "thresholds": metrics.default_against_own(values), "confusion": metrics.confusion(mine, ["entity"]), "report": metrics.class_report(metrics.confusion(mine, ["entity"]), ["entity"])}


def ablation(df: DataFrame, s: Settings, name: str, groups: dict[str, list[str]] | None = None, steps: bool = False) -> dict[str, DataFrame]:
    """Metrics without each feature, or each group of features, and, with `steps`, without scaling, calibration and
    threshold; tests are corrected by metric."""
    rows, features = written(df, s)
    p = plan(name, s)
    names = tuple(s.metrics) or models.METRICS
    scores = models.leave_out(rows, features, groups or {f: [f] for f in features}, s.target, p, s.outer, s.seed, names)
    out = {"ablation": transfer.ablation_tests(scores, 1 - s.level)}
    if steps:
        out["steps"] = transfer.ablation_tests(models.step_ablation(rows, features, s.target, p, s.outer, s.seed, names), 1 - s.level)
    return out


def described(meta: dict) -> str:
    """A saved model's record as text."""
    return json.dumps(meta, indent=2, sort_keys=True, default=str)
