"""Runs: nothing that is chosen or fitted for a fold sees it; ids, resuming, neighbours, Shapley shares, ablations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics, models, transfer
from plumbline.plans import experiments
from plumbline.settings import Settings
from plumbline.sources.files import PredictionStore


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(240).selectExpr("id as sample_id", "(id * 37 % 101) / 101.0D as a", "(id * 53 % 97) / 97.0D as b", "pmod(xxhash64(id), 2) as noise")
    return df.selectExpr("*", "cast(a + 0.3D * b > 0.65D as int) as y").cache()


def test_search_sees_training_rows_only(rows, monkeypatch):
    """Every search, fit and threshold of a fold gets rows of the other folds; scores of pure noise stay near 0.5."""
    seen, search = [], models.search

    def watched(df, *args, **more):
        seen.append({r.sample_id for r in df.select("sample_id").collect()})
        return search(df, *args, **more)

    monkeypatch.setattr(models, "search", watched)
    plan = models.Plan("logistic", grid=[{"regParam": r} for r in (10.0, 0.001)], inner=2)
    oof = models.out_of_fold(rows, ["a", "b"], "noise", plan, 3).cache()
    folds = {i: {r.sample_id for r in oof.where(f"fold = {i}").collect()} for i in range(3)}
    assert sorted(map(len, seen)) == sorted(240 - len(f) for f in folds.values())
    assert all(any(not s & f for s in seen) for f in folds.values()) and all(len(s) < 240 for s in seen)
    assert abs(metrics.auroc(oof, ["entity"]).first().auroc - 0.5) < 0.1
    assert oof.select("parameters").distinct().count() >= 1 and "regParam" in oof.first().parameters


def test_search_of_datasets_stays_with_the_source(rows, monkeypatch):
    df = rows.selectExpr("*", "concat('d', sample_id % 3) as dataset")
    seen, search = [], models.search

    def watched(df, *args, **more):
        seen.append({r.dataset for r in df.select("dataset").collect()})
        return search(df, *args, **more)

    monkeypatch.setattr(models, "search", watched)
    plan = models.Plan("logistic", grid=[{"regParam": 0.1}, {"regParam": 0.01}], inner=2)
    assert models.cross(df, ["a", "b"], "y", plan, 2).count() == 18
    assert len(seen) == 6 and all(len(s) == 1 for s in seen)
    seen.clear()
    assert models.held_out_datasets(df, ["a", "b"], "y", plan).count() == 3
    assert sorted(map(tuple, map(sorted, seen))) == [("d0", "d1"), ("d0", "d2"), ("d1", "d2")]


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(1.5, "x", None), (1.5, "x", None), (2.0, "y", 3), (None, None, None)], "a double, b string, c int")
    one, two = (sorted(map(str, experiments.numbered(d).collect())) for d in (df.coalesce(1), df.repartition(4, "b").sort("c")))
    assert one == two and len(set(one)) == 4
    s = Settings(target="c", features=["a"], missing="median")
    assert experiments.prepared(df, s)[0].count() == 1


def test_calibration_and_seed_are_honoured(rows):
    s = Settings(target="y", calibrate=True, calibration_folds=2, seed=7)
    plan = experiments.plan("logistic", s)
    assert plan.calibrate == 2 and plan.seed == 7 and experiments.plan("logistic", Settings()).calibrate == 0
    model = models.trained(rows, ["a", "b"], "y", plan, {"regParam": 0.01})
    got = models.score(model, rows)
    assert got.columns == [*rows.columns, "y_prob"] and got.where("y_prob < 0 or y_prob > 1").count() == 0
    assert metrics.auroc(got.selectExpr("1 as g", "y as y_true", "y_prob"), ["g"]).first().auroc > 0.9
    folds = [{(r.sample_id, r.fold) for r in models.out_of_fold(rows, ["a"], "y", models.Plan("logistic", tune=False), 2, seed=k).select("sample_id", "fold").collect()} for k in (1, 1, 2)]
    assert folds[0] == folds[1] != folds[2]
    assert len(set(models.fold_seeds(1, 10))) == 10 and models.fold_seeds(1, 3) == models.fold_seeds(1, 10)[:3]


def test_saved_calibrated_model(spark, rows, tmp_path):
    s = Settings(target="y", id_column="sample_id", features=["a", "b"], calibrate=True, calibration_folds=2, outer=2, inner=2, search_budget=2)
    meta = experiments.train(rows, s, "logistic", str(tmp_path / "m"))
    assert meta["calibrated"] and 0 < meta["threshold"] < 1 and meta["threshold_method"] == "oof"
    assert spark.read.parquet(str(tmp_path / "m" / "cv_results")).count() == 2
    got = experiments.predict(rows, str(tmp_path / "m"), "sample_id")
    assert got.count() == 240 and experiments.predict(rows, str(tmp_path / "m"), proba=False).columns == ["prediction"]
    found = experiments.evaluate(rows, str(tmp_path / "m"))
    assert {r.label for r in found["report"].collect()} == {"0", "1", "macro", "weighted"}


def test_resume_trains_missing_folds_only(spark, rows, tmp_path, monkeypatch):
    s = Settings(target="y", id_column="sample_id", features=["a", "b"], models=["logistic"], outer=3, inner=2, bootstrap=100)
    calls, trained = [], models.trained
    monkeypatch.setattr(models, "trained", lambda *a: calls.append(1) or trained(*a))
    first = experiments.compare(rows, s, str(tmp_path))["metrics"].first()
    n = len(calls)
    store = PredictionStore(spark, f"{tmp_path}/predictions")
    key = store.summary().first().run_key
    assert store.have(key, "all", "logistic") == {0, 1, 2} and store.summary().first().folds == [0, 1, 2] and store.summary().first().n == 240
    assert experiments.compare(rows, s, str(tmp_path))["metrics"].first() == first and len(calls) == n
    import shutil

    shutil.rmtree(tmp_path / "predictions" / f"run_key={key}" / "dataset=all" / "entity=logistic" / "fold=1")
    assert store.have(key, "all", "logistic") == {0, 2}
    assert experiments.compare(rows, s, str(tmp_path))["metrics"].first() == first and len(calls) == n + n // 3
    assert store.cleanup(dry_run=True) == [key] and store.have(key, "all", "logistic") == {0, 1, 2}
    assert store.cleanup() == [key] and store.have(key, "all", "logistic") == set()


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours(rows, weights):
    rows = rows.selectExpr("sample_id", "a + pow(sample_id, 1.5D) * 1e-6D as a", "b + sqrt(sample_id) * 1e-5D as b", "y")  # no ties
    train, test = rows.where("sample_id % 4 != 0"), rows.where("sample_id % 4 = 0")
    got = {r.sample_id: r.y_prob for r in models.score(models.fit(train, ["a", "b"], "y", "knn", k=5, weights=weights, scale=False), test).collect()}
    x = np.array([(r.a, r.b) for r in train.collect()])
    y = np.array([r.y for r in train.collect()])
    for r in test.collect():
        d = np.sqrt(((x - [r.a, r.b]) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:5]
        w = np.ones(5) if weights == "uniform" else 1 / d[near]
        assert abs(got[r.sample_id] - (w * y[near]).sum() / w.sum()) < 1e-9
    oof = models.out_of_fold(rows, ["a", "b"], "y", models.Plan("knn", {"k": 3}, tune=False), 2)
    assert oof.count() == 240 and metrics.auroc(oof, ["entity"]).first().auroc > 0.9


def test_shapley_shares_add_up(rows):
    for name, more in (("forest", {"numTrees": 5}), ("mlp", {"layers": (4,), "maxIter": 20})):
        model = models.fit(rows, ["a", "b"], "y", name, **more)
        got = models.shapley_sampled(model, rows, ["a", "b"], orders=4)
        e = got.selectExpr("max(abs(base + phi['a'] + phi['b'] - y_prob)) as e", "avg(abs(phi['a'])) as a", "avg(abs(phi['b'])) as b").first()
        assert e.e < 1e-9 and e.a > e.b
        p = {r.sample_id: r.y_prob for r in models.score(model, rows).collect()}
        assert all(abs(p[r.sample_id] - r.y_prob) < 1e-9 for r in got.collect())


def test_steps_and_components(rows):
    plan = models.Plan("logistic", {"regParam": 0.01}, calibrate=2, inner=2)
    got = transfer.ablation_tests(models.step_ablation(rows, ["a", "b"], "y", plan, 2))
    assert {r.name for r in got.collect()} == {"no_scaling", "no_calibration", "no_threshold"} and got.count() == 12
    plans = {"base": models.Plan("logistic", {"regParam": 0.01}, tune=False), "weak": models.Plan("logistic", {"regParam": 100.0, "elasticNetParam": 1.0}, tune=False)}
    got = transfer.ablation_tests(models.component_ablation(rows, ["a", "b"], "y", plans, "base", 3))
    r = got.where("metric = 'auroc'").first()
    assert r.name == "weak" and r.delta > 0.3 and r.p is not None and r.p_holm >= r.p
    with pytest.raises(ValueError):
        models.component_ablation(rows, ["a"], "y", plans, "nope")


def test_quantiles_of_many_values(spark):
    """Brackets of large keys against numpy, with ties, negative numbers and nulls."""
    from plumbline.functions.quantiles import exact

    df = spark.range(30_000).selectExpr("id % 2 as g", "case when id % 11 = 0 then null when id % 3 = 0 then 5.0D else pmod(xxhash64(id), 100000) / 7.0D - 3000 end as v")
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r.q for r in exact(df, ["g"], "v", qs).collect()}
    for g in (0, 1):
        v = [r.v for r in df.where(f"g = {g}").collect() if r.v is not None]
        assert np.allclose(got[g], np.quantile(v, qs), rtol=0, atol=1e-9)


def test_counts_of_a_stream(spark, tmp_path):
    """The windowed counts of a stream of files, in two batches, are those of the whole table."""
    from plumbline.streaming import counts

    df = spark.range(200).selectExpr("timestamp_seconds(id * 600) as ts", "concat('e', id % 2) as entity", "id % 3 % 2 as y_true", "id % 5 % 2 as y_pred")
    for i, part in enumerate((df.where("ts < '1970-01-01 16:00:00'"), df.where("ts >= '1970-01-01 16:00:00'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = counts.windowed(stream, width="6 hours").writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(spark.table("counted")) == key(counts.windowed(df, width="6 hours"))


def test_rows_of_a_forest_are_spread_by_number(rows, monkeypatch):
    """However many rows a file holds, a partition that a forest caches holds a bounded number; no row is lost."""
    monkeypatch.setattr(models, "ROWS_A_TASK", 50)
    packed, n = rows.coalesce(1), rows.count()
    spread = models._spread(packed, "forest")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // 50) and max(sizes) <= 55
    assert models._spread(packed, "logistic") is packed and models._spread(spread, "forest") is spread
    assert models.score(models.fit(packed, ["a", "b"], "y", "forest", numTrees=5), packed).count() == n
