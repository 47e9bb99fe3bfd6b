"""Shapley values of trees against all subsets of features, and the cache of explanations and folds."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import explain, metrics, models
from plumbline.plans import experiments
from plumbline.settings import Settings
from plumbline.sources.files import PredictionStore

NAMES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(150, 4)), 1)
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.4 * (x[:, 2] > 0.5) + 0.3 * r.normal(size=150) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "sample_id long, f0 double, f1 double, f2 double, f3 double, y int").repartition(3).cache()


def set_value(nodes, x, known):
    """The score when only the features in `known` are followed: by walking every tree both ways by cover."""
    by = {(r.tree, r.node): r for r in nodes}
    children = {(r.tree, c) for r in nodes if r.feature >= 0 for c in (r.left, r.right)}

    def at(t, n):
        r = by[t, n]
        if r.feature < 0:
            return r.value
        left, right = by[t, r.left], by[t, r.right]
        if r.feature in known:
            return at(t, r.left if x[r.feature] <= r.threshold else r.right)
        return sum(c.cover * at(t, c.node) for c in (left, right)) / r.cover if r.cover else 0.0

    return sum(at(*k) for k in by if k not in children)


@pytest.mark.parametrize("name,params", [("forest", {"numTrees": 4, "maxDepth": 4}), ("gbt", {"maxIter": 4, "maxDepth": 3}), ("gbt_balanced", {"maxIter": 3, "maxDepth": 3})])
def test_equals_all_subsets(spark, rows, name, params):
    model = models.fit(rows, NAMES, "y", name, scale=False, **params)
    got = {r.sample_id: r for r in explain.explain(model, rows, NAMES).collect()}
    assert len(got) == 150
    nodes = explain.tree_nodes(explain.explained_stage(model), spark).collect()
    for r in rows.where("sample_id < 8").collect():
        x = [r[f] for f in NAMES]
        value = {s: set_value(nodes, x, s) for k in range(5) for s in itertools.combinations(range(4), k)}
        assert got[r.sample_id].base == pytest.approx(value[()], abs=1e-9)
        for i in range(4):
            others = [s for s in value if i not in s]
            phi = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[tuple(sorted((*s, i)))] - value[s]) for s in others)
            assert got[r.sample_id].phi[f"f{i}"] == pytest.approx(phi, abs=1e-9)
    scored = model.transform(rows)
    want = {r.sample_id: r.s for r in scored.select("sample_id", F.element_at(models.vector_to_array("probability" if name == "forest" else "rawPrediction"), 2).alias("s")).collect()}
    for i, r in got.items():
        assert r.base + sum(r.phi.values()) == pytest.approx(want[i], abs=1e-9) and r.score == pytest.approx(want[i], abs=1e-9)
    means = {r.feature: r.value for r in explain.mean_shares(explain.explain(model, rows, NAMES), []).collect()}
    assert max(means, key=means.get) == "f0"


def test_linear_and_others(rows):
    for scale in (True, False):
        model = models.fit(rows, NAMES, "y", "logistic", regParam=0.01, scale=scale)
        got = {r.sample_id: r for r in explain.explain(model, rows, NAMES, rows).collect()}
        p = {r.sample_id: r.y_prob for r in models.score(model, rows).collect()}
        assert all(1 / (1 + math.exp(-r.score)) == pytest.approx(p[i]) and r.base + sum(r.phi.values()) == pytest.approx(r.score) for i, r in got.items())
        assert abs(sum(r.phi["f0"] for r in got.values())) < 1e-6
    with pytest.raises(ValueError, match="sampled"):
        explain.explain(models.fit(rows, NAMES, "y", "mlp", layers=(3,), maxIter=5), rows, NAMES)


def test_compare_keeps_explanations_and_folds(spark, rows, tmp_path, monkeypatch):
    s = Settings(target="y", id_column="sample_id", features=NAMES, models=["logistic", "gbt"], parameters={"gbt": {"maxIter": 2, "maxDepth": 2}}, outer=2, inner=2, bootstrap=100, explain=True)
    calls, trained = [], models.trained
    monkeypatch.setattr(models, "trained", lambda *a: calls.append(1) or trained(*a))
    first = experiments.compare(rows, s, str(tmp_path))
    assert tuple(first["explanation_cache"].first()) == (0, 4)
    assert first["explanations"].count() == 300 and {r.entity for r in first["mean_shares"].collect()} == {"logistic", "gbt"}
    assert {(r.entity, r["rank"]) for r in first["importances"].where("feature = 'f0'").collect()} == {("logistic", 1), ("gbt", 1)}
    n = len(calls)
    again = experiments.compare(rows, s, str(tmp_path))
    assert tuple(again["explanation_cache"].first()) == (4, 0) and len(calls) == n
    store = PredictionStore(spark, f"{tmp_path}/predictions")
    key = store.summary().first().run_key
    record = store.record(key, "all", "gbt", 1)
    assert record["model"] and record["metrics"]["auroc"] > 0.7 and set(record["metrics"]) >= {"mcc", "brier", "ece"} and record["n"] in (74, 75, 76)
    one = models.score(store.model(key, "all", "gbt", 1), rows)
    kept = {r.sample_id: r.y_prob for r in store.get(key).where("entity = 'gbt' and fold = 1").collect()}
    assert all(abs(r.y_prob - kept[r.sample_id]) < 1e-12 for r in one.collect() if r.sample_id in kept) and len(kept) == record["n"]
    cache = explain.Cache(spark, f"{tmp_path}/explanations")
    assert cache.clear() == 4 and cache.clear() == 0
    assert tuple(experiments.compare(rows, s, str(tmp_path))["explanation_cache"].first()) == (0, 4) and len(calls) == n


def test_a_fold_without_its_marker_is_done_again(spark, rows, tmp_path, monkeypatch):
    """A run that dies between predictions and marker leaves a fold that is not there, and that the next run redoes."""
    s = Settings(target="y", id_column="sample_id", features=NAMES, models=["logistic"], outer=3, inner=2, bootstrap=100)
    commit, marked = PredictionStore.commit, []

    def dies(self, key, dataset, entity, fold, record):
        if fold == 1 and not marked:
            marked.append(fold)
            raise KeyboardInterrupt
        commit(self, key, dataset, entity, fold, record)

    monkeypatch.setattr(PredictionStore, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        experiments.compare(rows, s, str(tmp_path))
    store = PredictionStore(spark, f"{tmp_path}/predictions")
    key = store.summary().first().run_key
    assert store.have(key, "all", "logistic") == {0} and store.get(key).select("fold").distinct().count() == 1
    assert spark.read.parquet(store.root).select("fold").distinct().count() == 2
    out = experiments.compare(rows, s, str(tmp_path))
    assert store.have(key, "all", "logistic") == {0, 1, 2} and out["metrics"].count() == 1 and store.get(key).count() == 150
    assert metrics.auroc(store.get(key), ["entity"]).first().auroc > 0.9
