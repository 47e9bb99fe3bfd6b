"""Training: classifiers of the ML library, nested search, calibration, out-of-fold predictions, ablation, Shapley values.

The two boosted models are those of `boosting`: `gbt` splits each node by itself, `gbt_balanced` weighs classes alike
and grows symmetric trees.  Whatever is chosen or fitted for the rows of a
fold (parameters, fill values, scales, calibration, threshold) sees the other folds only.
"""

from __future__ import annotations

import json
import random
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.storage import kept, let_go
from plumbline.operators import folds as fold_ops
from plumbline.operators import logistic, tuning
from plumbline.operators.boosting import Boosting
from plumbline.operators.calibration import Sigmoid
from plumbline.operators.metrics import all_metrics, area, scores, youden
from plumbline.operators.neighbours import Neighbours, nearest
from plumbline.operators.perceptron import Perceptron
from plumbline.operators.replicates import metric_values

Factory = Callable[..., object]
_IO = {"featuresCol": "features", "labelCol": "label"}
REGISTRY: dict[str, tuple[Factory, list[dict]]] = {
    "logistic": (lambda **p: LogisticRegression(**_IO, weightCol="weight", **p), [{"regParam": r, "elasticNetParam": e} for r in (0.1, 0.01, 0.001, 0.0001) for e in (0.0, 1.0)]),
    "forest": (lambda **p: RandomForestClassifier(**_IO, weightCol="weight", **{"seed": 42} | p), [{"numTrees": t, "maxDepth": d} for t in (50, 100, 200) for d in (3, 5)]),
    "gbt": (lambda **p: Boosting(**{"weightCol": "", "l2": 1.0} | p), [{"maxIter": n, "maxDepth": d, "stepSize": s} for n in (50, 100, 200) for d in (3, 5) for s in (0.01, 0.1)]),
    "gbt_balanced": (lambda **p: Boosting(**{"symmetric": True, "l2": 3.0} | p), [{"maxIter": n, "maxDepth": d, "stepSize": s} for n in (100, 200, 500) for d in (4, 6, 8) for s in (0.01, 0.05, 0.1)]),
    "mlp": (lambda **p: Perceptron(**p), [{"layers": x, "activation": a, "alpha": l2} for x in ((50,), (100,), (50, 50)) for a in ("relu", "tanh") for l2 in (1e-4, 1e-3)]),
    "knn": (lambda **p: Neighbours(**p), [{"k": k, "weights": w, "leafSize": n} for k in (3, 5, 7, 9) for w in ("uniform", "distance") for n in (20, 30, 40)]),
}
SEEDED = ("forest", "mlp")
_LIBRARY_LOGISTIC = REGISTRY["logistic"][0]
METRICS = ("balanced_accuracy", "f1_1", "mcc", "auroc")


@dataclass
class Plan:
    """How a model is made: its name and parameters, a grid to choose from inside the training rows, and the steps around it."""

    name: str
    params: dict = field(default_factory=dict)
    grid: list[dict] | None = None
    inner: int = 3
    budget: int | None = None
    seconds: float | None = None
    missing: str | None = None
    scale: bool = True
    calibrate: int = 0
    calibration: str = "isotonic"
    tune: bool = True
    seed: int = 42


def register(name: str, factory: Factory, grid: list[dict]) -> None:
    REGISTRY[name] = (factory, grid)


def estimator(name: str, **params):
    if name not in REGISTRY:
        raise KeyError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name][0](**params)


def fold_seeds(seed: int, k: int) -> list[int]:
    """Independent seeds of k folds."""
    draw = random.Random(seed)
    return [draw.randrange(1 << 31) for _ in range(k)]


def weighted(df: DataFrame, target: str, counts: dict | None = None) -> DataFrame:
    """df with `label` and balancing `weight`, from counts of its classes that are taken once: every later pass only maps its rows."""
    if counts is None:
        counts = {r.y: r.n for r in df.groupBy(F.col(target).alias("y")).agg(F.count("*").alias("n")).collect()}
    total, weight = sum(counts.values()), F.lit(None).cast("double")
    for y, n in counts.items():
        if y is not None:
            weight = F.when(F.col(target) == F.lit(y), F.lit(total / (2 * n))).otherwise(weight)
    return df.where(F.col(target).isNotNull()).withColumn("weight", weight).withColumn("label", F.col(target).cast("double"))


def _others(rows: DataFrame, fold: str, target: str, k: int) -> list[dict]:
    """For each of k folds, the counts of classes in the other folds."""
    n = rows.groupBy(F.col(fold).alias("f"), F.col(target).alias("y")).agg(F.count("*").alias("n")).collect()
    out: list[dict] = [{} for _ in range(k)]
    for i, r in ((i, r) for i in range(k) for r in n if r.f != i):
        out[i][r.y] = out[i].get(r.y, 0) + r.n
    return out


def _dealt(df: DataFrame, columns: list[str], k: int, target: str, seed: int, name: str = "fold", within: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the fold of each, written once: folds take two shuffles of all rows, and what is fitted passes over them often."""
    rows = df.select(*dict.fromkeys(["sample_id", *within, *columns, target]))
    return kept(fold_ops.stratified(rows, k, target, "sample_id", seed=seed, within=within, name=name))


class _Alike:
    """The rows of a written table, those alike in features, class and part as one with their number: made and written when a model
    first asks, for all that follow."""

    def __init__(self, rows: DataFrame, features: list[str], target: str, part: Column) -> None:
        self.rows, self.features, self.target, self.part = rows, list(features), target, part
        self.lock, self.made = Lock(), None

    def table(self) -> DataFrame:
        with self.lock:
            if self.made is None:
                self.made = kept(logistic.rows_of(self.rows, self.features, self.target, self.part), by=("part",))
        return self.made

    def named(self, parts: list[int]) -> DataFrame:
        """part, the features and the target by their names, n."""
        d = len(self.features)
        return self.table().where(F.col("part").isin(parts)).select("part", *[F.col(f"f{i}").alias(self.features[i]) for i in range(d)], F.col("y").alias(self.target), "n")

    def let_go(self) -> None:
        if self.made is not None:
            let_go(self.made)


def _of(rows: DataFrame, condition: Column, alike: _Alike | None = None, parts: set[int] | None = None) -> DataFrame:
    """Some rows of a written table, known as such; `alike` has the same rows under these parts."""
    part = rows.where(condition)
    part.kept_at = rows.kept_at
    if alike is not None:
        part.alike, part.parts = alike, frozenset(parts)
    return part


def _newton(name: str, missing: str | None, params: dict) -> bool:
    """Whether a model is the library's logistic one with a penalty, which `logistic` fits to the same minimum in fewer passes."""
    return name == "logistic" and not missing and REGISTRY[name][0] is _LIBRARY_LOGISTIC and logistic.takes(params)


def _job(parts: frozenset[int] | set[int], used: list[int], params: dict) -> logistic.Job:
    return logistic.Job(frozenset(parts), tuple(used), params["regParam"], params.get("elasticNetParam", 0.0))


def _linear(df: DataFrame, features: list[str], target: str, scale: bool, params: dict) -> PipelineModel | None:
    """The logistic model of these rows, or None where the library has to see to them."""
    if hasattr(df, "parts") and set(features) <= set(df.alike.features) and target == df.alike.target:
        rows, columns, parts = df.alike.table(), df.alike.features, df.parts
    else:
        rows, columns, parts = logistic.rows_of(df, features, target, F.lit(0), together=False), features, frozenset({0})
    used = [columns.index(f) for f in features]
    found = logistic.fit_all(rows.where(F.col("part").isin(sorted(parts))), len(columns), [_job(parts, used, params)])
    return found and logistic.pipeline(found[0], used, columns, scale, estimator("logistic", **params))


@contextmanager
def _at_hand(df: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
    """df as a written table of these columns, for as long as it is needed; df itself where it is part of one."""
    if getattr(df, "kept_at", None):
        yield df
        return
    rows = kept(df.select(*dict.fromkeys(columns)))
    try:
        yield rows
    finally:
        let_go(rows)


def _stages(features: list[str], name: str, missing: str | None, scale: bool, params: dict, tag: str = "") -> list:
    """Fill (if `missing`), assemble, scale, classify; `tag` keeps the columns of several such rows of stages apart."""
    used, stages, raw = features, [], f"_raw{tag}" if scale else f"features{tag}"
    if missing:
        used = [f"_full{tag}_{f}" for f in features]
        stages.append(Imputer(strategy=missing, inputCols=features, outputCols=used))
    stages.append(VectorAssembler(inputCols=used, outputCol=raw))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=f"features{tag}", withMean=True, withStd=True))
    last = estimator(name, **params)
    if tag:
        last.setFeaturesCol(f"features{tag}").setProbabilityCol(f"probability{tag}").setRawPredictionCol(f"rawPrediction{tag}").setPredictionCol(f"prediction{tag}")
    return [*stages, last]


#: Rows of a partition that trees are grown over: each keeps a number for every tree beside its bins.
ROWS_A_TASK = 500_000


def _spread(rows: DataFrame, name: str) -> DataFrame:
    """For a forest, which caches its rows by partition, rows in as many partitions as their number asks for; files hold many rows
    in few bytes, and are read many to a task."""
    if name != "forest":
        return rows
    parts = -(-rows.count() // ROWS_A_TASK)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def fit(df: DataFrame, features: list[str], target: str, name: str, missing: str | None = None, scale: bool = True, **params) -> PipelineModel:
    """The fitted pipeline; with `missing` (median, mean, mode) nulls are filled, with `scale` features are standardised,
    both by what these rows hold, which are written once for all passes."""
    with _at_hand(df, [*features, target]) as rows:
        if _newton(name, missing, params) and (model := _linear(rows, features, target, scale, params)):
            return model
        return Pipeline(stages=_stages(features, name, missing, scale, params)).fit(weighted(_spread(rows, name), target))


def fit_calibrated(df: DataFrame, features: list[str], target: str, name: str, k: int = 3, missing: str | None = None, scale: bool = True, seed: int = 42, calibration: str = "isotonic", **params) -> PipelineModel:
    """One pipeline of k models, each with an isotonic curve or a sigmoid fitted to the fold it has not seen; y_prob is their mean."""
    if name == "knn":
        raise ValueError("neighbours give shares, which are not calibrated")
    rows = _dealt(df, features, k, target, seed, "_cal")
    try:
        stages = _calibrated_stages(rows, features, target, name, k, missing, scale, calibration, params)
    finally:
        let_go(rows)
    mean = " + ".join(f"_p_{i}" for i in range(k))
    stages.append(SQLTransformer(statement=f"SELECT *, ({mean}) / {float(k)}D AS y_prob FROM __THIS__"))
    return PipelineModel(stages=stages)


def _calibrated_stages(rows: DataFrame, features: list[str], target: str, name: str, k: int, missing: str | None, scale: bool, calibration: str, params: dict) -> list:
    stages, counts, found, used = [], None, None, list(range(len(features)))
    if _newton(name, missing, params):
        alike = _Alike(rows, features, target, F.col("_cal"))
        found = logistic.fit_all(alike.table(), len(features), [_job(set(range(k)) - {i}, used, params) for i in range(k)])
        alike.let_go()
    for i in range(k):
        if found:
            last = _stages(features, name, missing, scale, params, f"_{i}")[-1]
            model = logistic.pipeline(found[i], used, features, scale, last, f"_{i}")
        else:
            counts = counts or _others(rows, "_cal", target, k)
            model = Pipeline(stages=_stages(features, name, missing, scale, params, f"_{i}")).fit(weighted(_spread(rows.where(F.col("_cal") != i), name), target, counts[i]))
        held = model.transform(rows.where(F.col("_cal") == i)).withColumn("label", F.col(target).cast("double"))
        if calibration == "sigmoid":
            curve = Sigmoid(featuresCol=f"probability_{i}", labelCol="label", predictionCol=f"_p_{i}").fit(held)
        elif calibration == "isotonic":
            by = held.groupBy(vector_to_array(f"probability_{i}")[1].alias("_p")).agg(F.avg("label").alias("label"), F.count("label").cast("double").alias("weight"))
            by = by.select(array_to_vector(F.array(1 - F.col("_p"), "_p")).alias(f"probability_{i}"), "label", "weight")  # a score's rows weigh together
            curve = IsotonicRegression(featuresCol=f"probability_{i}", featureIndex=1, labelCol="label", weightCol="weight", predictionCol=f"_p_{i}").fit(by)
        else:
            raise ValueError(f"unknown calibration {calibration!r}")
        stages += [*model.stages, curve]
    return stages


def score(model: PipelineModel, df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """df with y_prob; a narrow transformation."""
    rows = model.transform(df.drop("y_prob"))
    p = F.col("y_prob") if "y_prob" in rows.columns else vector_to_array("probability")[1]
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != "y_prob"], p.alias("y_prob"))


def search(df: DataFrame, features: list[str], target: str, name: str, grid: list[dict] | None = None, k: int = 3, budget: int | None = None, seed: int = 42, seconds: float | None = None) -> list[tuple[dict, float]]:
    """(parameters, mean AUROC over inner folds), best first, of the grid or, with a budget, of so many trials of it."""
    return [(p, mean) for p, mean, _ in search_history(df, features, target, name, grid, k, budget, seed, seconds)]


def search_history(df: DataFrame, features: list[str], target: str, name: str, grid: list[dict] | None = None, k: int = 3, budget: int | None = None, seed: int = 42, seconds: float | None = None) -> list[tuning.Trial]:
    """(parameters, mean AUROC, AUROC of each inner fold), best first, as `tuning.search` finds them."""
    grid = REGISTRY[name][1] if grid is None else grid
    rows = _dealt(df, features, k, target, seed, "_inner")
    if (budget is None or budget >= len(grid)) and seconds is None and grid and all(_newton(name, p.get("missing"), _plain(p)) for p in grid):
        if trials := _searched(rows, features, target, grid, k):
            let_go(rows)
            return trials
    measure = BinaryClassificationEvaluator(rawPredictionCol="y_prob", labelCol=target, numBins=0)

    def one(p: dict) -> tuning.Trial:
        each = [measure.evaluate(score(fit(_of(rows, F.col("_inner") != i), features, target, name, **p), rows.where(F.col("_inner") == i), features)) for i in range(k)]
        return p, sum(each) / k, each

    try:
        return tuning.search(one, grid, budget, seconds, seed)
    finally:
        let_go(rows)


def _plain(params: dict) -> dict:
    return {p: v for p, v in params.items() if p not in ("missing", "scale")}


def _measured(alike: _Alike, jobs: list[logistic.Job], held: list[int]) -> list[dict] | None:
    """Confusion counts and auroc of each job's model on its held-out part; None where the library has to fit the models."""
    d = len(alike.features)
    found = logistic.fit_all(alike.table(), d, jobs)
    return found and logistic.measured(alike.table(), d, found, held)


def _searched(rows: DataFrame, features: list[str], target: str, grid: list[dict], k: int) -> list[tuning.Trial] | None:
    """All trials of a grid of logistic models: fitted in the same passes, and measured together."""
    alike, used = _Alike(rows, features, target, F.col("_inner")), list(range(len(features)))
    places = [(g, i) for g in range(len(grid)) for i in range(k)]
    try:
        got = _measured(alike, [_job(set(range(k)) - {i}, used, _plain(grid[g])) for g, i in places], [i for _, i in places])
    finally:
        alike.let_go()
    if not got or any(v["auroc"] is None for v in got):
        return None
    each = [[got[g * k + i]["auroc"] for i in range(k)] for g in range(len(grid))]
    return tuning.best_first([(p, sum(e) / k, e) for p, e in zip(grid, each)])


def history_table(spark, history: list[tuple[dict, float, list[float]]]) -> DataFrame:
    """rank, parameters, fold, value: the search as rows, for the summaries of `transfer.search_summary`."""
    rows = [(n + 1, json.dumps(p, sort_keys=True), i, float(v)) for n, (p, _, each) in enumerate(history) for i, v in enumerate(each)]
    return spark.createDataFrame(rows, "rank int, parameters string, fold int, value double")


def chosen(train: DataFrame, features: list[str], target: str, plan: Plan) -> dict:
    """The plan's parameters, or the best of its grid by inner folds of these rows."""
    fixed = {"missing": plan.missing, "scale": plan.scale}
    if plan.grid is None:
        return fixed | plan.params
    return fixed | search(train, features, target, plan.name, _grid(plan), plan.inner, plan.budget, plan.seed, plan.seconds)[0][0]


def chosen_with_history(train: DataFrame, features: list[str], target: str, plan: Plan) -> tuple[dict, list[tuning.Trial]]:
    """As `chosen`, with the trials; none without a grid."""
    if plan.grid is None:
        return chosen(train, features, target, plan), []
    history = search_history(train, features, target, plan.name, _grid(plan), plan.inner, plan.budget, plan.seed, plan.seconds)
    return {"missing": plan.missing, "scale": plan.scale} | history[0][0], history


def _grid(plan: Plan) -> list[dict]:
    fixed = plan.params | {"missing": plan.missing, "scale": plan.scale}
    return [fixed | p for p in plan.grid or [{}]]


def trained(train: DataFrame, features: list[str], target: str, plan: Plan, params: dict) -> PipelineModel:
    if plan.calibrate and plan.name != "knn":
        return fit_calibrated(train, features, target, plan.name, plan.calibrate, seed=plan.seed, calibration=plan.calibration, **params)
    return fit(train, features, target, plan.name, **params)


def tuned(train: DataFrame, features: list[str], target: str, plan: Plan, params: dict) -> float:
    """The Youden threshold of inner out-of-fold scores of these rows; 0.5 if it has none."""
    if not plan.tune:
        return 0.5
    inner = _dealt(train, [*features, *[c for c in ("dataset",) if c in train.columns]], plan.inner, target, plan.seed, "_inner")
    try:
        alike = _Alike(inner, features, target, F.col("_inner"))
        parts = [score(trained(_of(inner, F.col("_inner") != j, alike, set(range(plan.inner)) - {j}), features, target, plan, params), inner.where(F.col("_inner") == j), features) for j in range(plan.inner)]
        held = reduce(DataFrame.unionByName, parts)
        t = youden(held.select(F.lit(plan.name).alias("entity"), F.col(target).alias("y_true"), "y_prob"), ["entity"]).first()
    finally:
        let_go(inner)
        alike.let_go()
    return float(t.threshold) if t and t.j > 0 else 0.5


def calibrated(train: DataFrame, test: DataFrame, features: list[str], target: str, name: str, k: int = 3, **params) -> DataFrame:
    """test with y_prob the mean of k calibrations (`calibration` isotonic or sigmoid), each fitted on rows its model has not seen."""
    return score(fit_calibrated(train, features, target, name, k, **params), test, features)


def out_of_fold_parts(df: DataFrame, features: list[str], target: str, name: str | Plan, k: int, seed: int = 42, only: list[int] | None = None, fitted: dict[int, PipelineModel] | None = None, **params) -> Iterator[tuple[int, DataFrame]]:
    """Each fold's number and its predictions: sample_id, fold, entity, y_true, y_prob, threshold, y_pred, parameters (JSON),
    by models of the other folds; search, calibration and threshold happen inside them.  `only` names the folds wanted;
    `fitted`, if given, gets the model of each."""
    plan = name if isinstance(name, Plan) else Plan(name, {p: v for p, v in params.items() if p not in ("missing", "scale")}, missing=params.get("missing"), scale=params.get("scale", True), seed=seed)
    rows = _dealt(df, features, k, target, seed)  # what is returned reads them
    seeds = fold_seeds(seed, k)
    alike = _Alike(rows, features, target, F.col("fold"))

    def one(i: int) -> DataFrame:
        train, test = _of(rows, F.col("fold") != i, alike, set(range(k)) - {i}), rows.where(F.col("fold") == i)
        best = chosen(train, features, target, plan)
        if plan.name in SEEDED:
            best = {"seed": seeds[i]} | best
        threshold = tuned(train, features, target, plan, best)
        model = trained(train, features, target, plan, best)
        if fitted is not None:
            fitted[i] = model
        out = score(model, test, features)
        return out.select(
            "sample_id", "fold", F.lit(plan.name).alias("entity"), F.col(target).cast("int").alias("y_true"), "y_prob", F.lit(threshold).alias("threshold"),
            (F.col("y_prob") >= threshold).cast("int").alias("y_pred"), F.lit(json.dumps(best, sort_keys=True)).alias("parameters"),
        )

    wanted = list(range(k)) if only is None else only
    with ThreadPoolExecutor(3) as pool:
        yield from zip(wanted, pool.map(one, wanted))
    alike.let_go()


def out_of_fold(df: DataFrame, features: list[str], target: str, name: str | Plan, k: int, seed: int = 42, **params) -> DataFrame:
    """The predictions of every row, by models of the other folds, as `out_of_fold_parts` gives them."""
    out = None
    for _, part in out_of_fold_parts(df, features, target, name, k, seed, **params):
        out = part if out is None else out.unionByName(part)
    return out


def _once() -> Callable[[str, Callable[[], object]], object]:
    """A function that makes what a key stands for the first time it is asked, while others who ask for the same wait."""
    made: dict[str, tuple[Lock, list]] = {}
    door = Lock()

    def get(key: str, make: Callable[[], object]) -> object:
        with door:
            mine, out = made.setdefault(key, (Lock(), []))
        with mine:
            if not out:
                out.append(make())
        return out[0]

    return get


def _variants_together(df: DataFrame, alike: _Alike, variants: dict[str, tuple[list[str], Plan]], k: int, metrics: tuple[str, ...]) -> list[tuple] | None:
    """name, fold, metric, value of variants that are logistic models and no more, fitted in the same passes and measured together;
    None if one of them has a search, a calibration or a threshold, or a metric is not of counts or auroc."""
    simple = lambda p: not (p.tune or p.calibrate or p.grid) and _newton(p.name, p.missing, _plain(p.params))
    if not all(simple(p) for _, p in variants.values()) or not set(metrics) <= {*scores(), "auroc"}:
        return None
    places = [(name, i) for name in variants for i in range(k)]
    jobs = [_job(set(range(k)) - {i}, [alike.features.index(f) for f in variants[name][0]], _plain(variants[name][1].params)) for name, i in places]
    got = _measured(alike, jobs, [i for _, i in places])
    if not got:
        return None
    counts = df.sparkSession.createDataFrame([(j, *[v[c] for c in ("tp", "fp", "tn", "fn")]) for j, v in enumerate(got)], "job int, tp double, fp double, tn double, fn double")
    wide = counts.select("job", *[c.alias(n) for n, c in scores().items()]).collect()
    return [(*places[r.job], m, got[r.job]["auroc"] if m == "auroc" else r[m]) for r in wide for m in metrics]


def variant_scores(df: DataFrame, target: str, variants: dict[str, tuple[list[str], Plan]], k: int = 3, seed: int = 42, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """name, fold, metric, value of each variant (features, plan) over the same folds; one job measures all folds of a variant.
    A model is fitted once for all variants that differ in the threshold only."""
    rows = _dealt(df, [f for used, _ in variants.values() for f in used], k, target, seed)
    columns = list(dict.fromkeys(f for used, _ in variants.values() for f in used))
    once, alike = _once(), _Alike(rows, columns, target, F.col("fold"))
    if out := _variants_together(df, alike, variants, k, metrics):
        alike.let_go()
        let_go(rows)
        return df.sparkSession.createDataFrame(out, "name string, fold int, metric string, value double")

    def one(job: tuple[str, int]) -> DataFrame:
        (features, plan), i = variants[job[0]], job[1]
        train, test = _of(rows, F.col("fold") != i, alike, set(range(k)) - {i}), rows.where(F.col("fold") == i)
        best = chosen(train, features, target, plan)
        threshold = tuned(train, features, target, plan, best)
        same = json.dumps([i, features, plan.name, plan.calibrate, plan.calibration, plan.seed, best], sort_keys=True, default=repr)
        part = score(once(same, lambda: trained(train, features, target, plan, best)), test, features)
        return part.select(F.lit(job[0]).alias("name"), "fold", F.col(target).cast("int").alias("y_true"), "y_prob", (F.col("y_prob") >= threshold).cast("int").alias("y_pred"))

    out = []
    with ThreadPoolExecutor(6) as pool:
        jobs = {name: [pool.submit(one, (name, i)) for i in range(k)] for name in variants}
        for name, parts in jobs.items():
            pred = None
            for part in (p.result() for p in parts):
                pred = part if pred is None else pred.unionByName(part)
            found = metric_values(pred, ["name", "fold"], list(metrics)).collect()
            out += [(r.name, r.fold, r.metric, r.value) for r in found]
    alike.let_go()
    let_go(rows)
    return df.sparkSession.createDataFrame(out, "name string, fold int, metric string, value double")


def against(scores: DataFrame, baseline: str) -> DataFrame:
    """name, fold, metric, baseline, ablated: each variant beside the one called `baseline`."""
    base = scores.where(F.col("name") == baseline).select("fold", "metric", F.col("value").alias("baseline"))
    return scores.where(F.col("name") != baseline).join(base, ["fold", "metric"]).select("name", "fold", "metric", "baseline", F.col("value").alias("ablated"))


def leave_out(df: DataFrame, features: list[str], groups: dict[str, list[str]], target: str, name: str | Plan, k: int = 3, seed: int = 42, metrics: tuple[str, ...] = METRICS, **params) -> DataFrame:
    """name, fold, metric, baseline, ablated: with all features and without each group; groups that hold none, or all, are left."""
    plan = name if isinstance(name, Plan) else Plan(name, params, tune=False, seed=seed)
    left = {g: [f for f in features if f not in gone] for g, gone in groups.items() if set(features) - set(gone) and set(gone) & set(features)}
    return against(variant_scores(df, target, {"": (features, plan)} | {g: (used, plan) for g, used in left.items()}, k, seed, metrics), "")


def component_ablation(df: DataFrame, features: list[str], target: str, plans: dict[str, Plan], baseline: str, k: int = 3, seed: int = 42, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """name, fold, metric, baseline, ablated: named ways to make a model beside one of them."""
    if baseline not in plans:
        raise ValueError(f"no plan is called {baseline!r}")
    return against(variant_scores(df, target, {n: (features, p) for n, p in plans.items()}, k, seed, metrics), baseline)


def step_ablation(df: DataFrame, features: list[str], target: str, plan: Plan, k: int = 3, seed: int = 42, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """name, fold, metric, baseline, ablated: the whole plan beside itself without scaling, calibration and threshold."""
    steps = {"full": plan, "no_scaling": replace(plan, scale=False), "no_calibration": replace(plan, calibrate=0), "no_threshold": replace(plan, tune=False)}
    return component_ablation(df, features, target, {n: p for n, p in steps.items() if n == "full" or p != plan}, "full", k, seed, metrics)


def _tried(what: str, do: Callable[[], object], failures: list[tuple] | None, strict: bool, *key):
    """What `do` gives; None if it fails, with a warning and, where a list is given, (*key, error) added to it.  `strict` lets the
    error through: whoever cannot say beside the result what is missing from it needs that."""
    try:
        return do()
    except Exception as e:  # one cell is no reason to lose the others
        if strict:
            raise RuntimeError(f"{what} failed: {type(e).__name__}: {str(e)[:200]}") from e
        warnings.warn(f"{what} left out: {type(e).__name__}: {str(e)[:200]}", stacklevel=2)
        if failures is not None:
            failures.append((*key, f"{type(e).__name__}: {str(e)[:200]}"))
        return None


def cross(df: DataFrame, features: list[str], target: str, name: str | Plan, k: int, seed: int = 42, metrics: tuple[str, ...] = ("auroc",), failures: list[tuple] | None = None, thresholds: list[tuple] | None = None, strict: bool = False, **params) -> DataFrame:
    """model, metric, source, target, fold, value: one fit for each source and fold, which scores every dataset's test fold.
    Parameters and, where a metric needs one, the threshold are chosen on the source's own training rows.

    A fold whose training fails is left out with a warning, and so is what it would have given: cells are then those of the
    other folds.  `failures` gets (source, fold, error), `thresholds` (source, fold, threshold).  With `strict` it is an error."""
    plan = name if isinstance(name, Plan) else Plan(name, {p: v for p, v in params.items() if p not in ("missing", "scale")}, missing=params.get("missing"), scale=params.get("scale", True), seed=seed)
    rows = _dealt(df, features, k, target, seed, within=("dataset",))
    names = [r.dataset for r in rows.select("dataset").distinct().orderBy("dataset").collect()]
    jobs = [(d, i) for d in names for i in range(k)]
    place = F.lit(-1)
    for n, d in enumerate(names):
        place = F.when(F.col("dataset").eqNullSafe(F.lit(d)), F.lit(n)).otherwise(place)
    alike = _Alike(rows, features, target, place * k + F.col("fold"))
    cut = any(m not in ("auroc", "brier", "ece", "mce") for m in metrics)

    def one(job: tuple[str, int]) -> list[tuple]:
        source, i = job
        at = names.index(source)
        train = _of(rows, (F.col("dataset") == source) & (F.col("fold") != i), alike, {at * k + j for j in range(k) if j != i})
        best = chosen(train, features, target, plan)
        model = trained(train, features, target, plan, best)
        if tuple(metrics) == ("auroc",) and alike.made is not None:  # the model was fitted to rows put together, and so they are scored
            s = score(model, alike.named([n * k + i for n in range(len(names))]), features).groupBy((F.col("part") - i).alias("part"), "y_prob")
            found = area(s.agg(F.sum(F.col(target) * F.col("n")).alias("pos"), F.sum("n").alias("n")), ["part"]).collect()
            if thresholds is not None:
                thresholds.append((source, i, 0.5))
            return [(plan.name, "auroc", source, names[r.part // k], i, r.auroc) for r in found]
        t = tuned(train, features, target, plan, best) if cut else 0.5
        s = score(model, rows.where(F.col("fold") == i), features).select("dataset", F.col(target).cast("int").alias("y_true"), "y_prob", (F.col("y_prob") >= t).cast("int").alias("y_pred"))
        found = metric_values(s, ["dataset"], list(metrics)).collect()
        if thresholds is not None:
            thresholds.append((source, i, t))
        return [(plan.name, r.metric, source, r.dataset, i, r.value) for r in found]

    try:
        with ThreadPoolExecutor(3) as pool:
            parts = list(pool.map(lambda j: _tried(f"{plan.name} of {j[0]}, fold {j[1]},", lambda: one(j), failures, strict, *j), jobs))
    finally:
        let_go(rows)
        alike.let_go()
    return df.sparkSession.createDataFrame([r for part in parts for r in part or []], "model string, metric string, source string, target string, fold int, value double")


def held_out_predictions(df: DataFrame, features: list[str], target: str, name: str | Plan, failures: list[tuple] | None = None, strict: bool = False, **params) -> DataFrame:
    """entity (the dataset held out), sample_id, y_true, y_prob, threshold, y_pred by a model of all other datasets, with parameters
    and threshold of theirs; at least three are needed.  A dataset whose training fails is left out with a warning; with `strict` it is an error."""
    plan = name if isinstance(name, Plan) else Plan(name, params)
    names = [r.dataset for r in df.select("dataset").distinct().orderBy("dataset").collect()]
    if len(names) < 3:
        raise ValueError("at least three datasets are needed")
    df = kept(df.select(*dict.fromkeys(["sample_id", "dataset", *features, target])))  # what is returned reads them

    def one(d: str) -> DataFrame:
        train = _of(df, F.col("dataset") != d)
        best = chosen(train, features, target, plan)
        t = tuned(train, features, target, plan, best)
        s = score(trained(train, features, target, plan, best), df.where(F.col("dataset") == d), features)
        return s.select(F.lit(d).alias("entity"), "sample_id", F.col(target).cast("int").alias("y_true"), "y_prob", F.lit(t).alias("threshold"), (F.col("y_prob") >= t).cast("int").alias("y_pred"))

    with ThreadPoolExecutor(3) as pool:
        parts = [p for p in pool.map(lambda d: _tried(f"{plan.name} without {d}", lambda: one(d), failures, strict, d, None), names) if p is not None]
    if not parts:
        raise ValueError("no dataset could be held out")
    return reduce(DataFrame.unionByName, parts)


def held_out_datasets(df: DataFrame, features: list[str], target: str, name: str | Plan, metrics: tuple[str, ...] = ("auroc",), **params) -> DataFrame:
    """held_out and metrics of a model trained on all other datasets."""
    pred = held_out_predictions(df, features, target, name, **params)
    return all_metrics(pred, ["entity"]).select(F.col("entity").alias("held_out"), *metrics)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Of the last stage that has them; of a calibrated pipeline that is asked for, its first model."""
    for last in [s for s in model.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficients")]:
        if hasattr(last, "featureImportances"):
            return list(zip(features, map(float, last.featureImportances.toArray())))
        return list(zip(features, map(abs, map(float, last.coefficients))))
    return []


def shapley_linear(df: DataFrame, features: list[str], target: str, **params) -> DataFrame:
    """sample_id, base, phi (feature -> value), margin: exact for the linear model's log-odds; base + sum(phi) = margin."""
    last = fit(df, features, target, "logistic", scale=False, **params).stages[-1]
    w = dict(zip(features, map(float, last.coefficients)))
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    rows = df.crossJoin(F.broadcast(means))  # one row
    base = F.lit(float(last.intercept)) + sum(F.lit(w[f]) * F.col(f"_m_{f}") for f in features)
    margin = F.lit(float(last.intercept)) + sum(F.lit(w[f]) * F.col(f) for f in features)
    phi = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(w[f]) * (F.col(f) - F.col(f"_m_{f}")))])
    return rows.select("sample_id", base.alias("base"), phi.alias("phi"), margin.alias("margin"))


def shapley_sampled(model: PipelineModel, df: DataFrame, features: list[str], orders: int = 8, seed: int = 42) -> DataFrame:
    """sample_id, base, phi (feature -> value), y_prob for any model: along `orders` random orders of the features, each is
    switched from its mean to its value, and what the score changes by is its share; base + sum(phi) = y_prob exactly.

    Rows become orders x (features + 1) rows for scoring, which stay together and in order, so shares are added up in the task
    that holds them, without a shuffle."""
    draw = random.Random(seed)
    means = df.agg(*[F.avg(f).cast("double").alias(f) for f in features]).first()
    steps = []
    for o in range(orders):
        order = draw.sample(features, len(features))
        steps += [(o, n, order[:n]) for n in range(len(features) + 1)]
    mask = F.array(*[F.array(*map(F.lit, on)).cast("array<string>") for _, _, on in steps])
    rows = df.select("sample_id", *features).select("*", F.posexplode(mask).alias("_n", "_on"))
    rows = rows.select("sample_id", "_n", *[F.when(F.array_contains("_on", f), F.col(f).cast("double")).otherwise(F.lit(means[f])).alias(f) for f in features])
    kind = df.schema["sample_id"].dataType.simpleString()
    got = score(model, rows, features).select("sample_id", "_n", "y_prob")
    wide = got.mapInArrow(_shares([(n, on[-1] if on else "") for _, n, on in steps], features, orders), f"sample_id {kind}, base double, y_prob double, phi array<double>")
    return wide.select("sample_id", "base", F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.col("phi")[i])]).alias("phi"), "y_prob")


def _shares(steps: list[tuple[int, str]], features: list[str], orders: int):
    """A row for each run of scores along all steps (number in its order, feature switched last): first and last score of the first
    order, and what each feature changed, divided by the orders."""
    size = len(steps)
    switch = np.array([n > 0 for n, _ in steps])
    place = {f: [j for j, (n, last) in enumerate(steps) if n and last == f] for f in features}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table])
            n = len(left) // size
            if not n:
                continue
            whole, left = left.slice(0, n * size), left.slice(n * size)
            if not (np.asarray(whole.column(1)).reshape(n, size) == np.arange(size)).all():
                raise ValueError("the steps of a row were parted")
            p = np.asarray(whole.column(2), float).reshape(n, size)
            change = np.where(switch, np.diff(p, axis=1, prepend=p[:, :1]), 0.0)
            phi = np.stack([change[:, place[f]].sum(1) / orders for f in features], 1)
            ids = whole.column(0).combine_chunks().take(pa.array(np.arange(n) * size))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(features) + 1, len(features)), pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(p[:, 0]), pa.array(p[:, len(features)]), lists], names=["sample_id", "base", "y_prob", "phi"])
        if left is not None and len(left):
            raise ValueError("the steps of a row were parted")

    return work


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """query_id, n1, id_sum: how many of the k nearest others have label 1, by exact distances, ties to the smaller id."""
    q = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).cast("array<double>").alias("q"))
    v = vectors.select(F.col(id_col).alias("vid"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("double").alias("y"))
    near = nearest(q, v, k, other=True)
    return near.groupBy(F.col("qid").alias("query_id")).agg(F.count_if(F.col("y") == 1).cast("long").alias("n1"), F.sum("vid").alias("id_sum"))
