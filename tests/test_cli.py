import json

import pytest

from plumbline import cli
from plumbline.settings import Settings
from plumbline.sources import artifacts


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    lines = ["id,a,b,r1,r2,state"]
    for i in range(240):
        a, b = (i * 37 % 101) / 101, (i * 53 % 97) / 97
        y = int(a + 0.3 * b > 0.65)
        lines.append(f"{i},{a if i % 17 else ''},{b},{y if i % 9 else 1 - y},{y if i % 5 else 1 - y},{y}")
    for name in ("x", "y", "z"):
        (root / f"{name}.csv").write_text("\n".join(lines))
    return root


def test_settings(tmp_path):
    with pytest.warns(UserWarning, match="nope"):
        s = Settings.from_dict({"cv": {"outer": 3, "nope": 1}, "rules": ["A", "B"], "combinations": ["A AND B"]})
    assert s.outer == 3 and not s.problems()
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")) == s
    assert len(s.merged(models=["nope"], outer=1, missing="x", level=2.0, combinations=["A AND C"]).problems()) == 5


def test_compare(spark, table, tmp_path):
    out = str(tmp_path / "out")
    argv = ["compare-models", str(table / "x.csv"), "--out", out, "--id-column", "id", "--models", "logistic", "--rules", "r1,r2", "--outer", "2", "--inner", "2", "--bootstrap", "100"]
    assert cli.main([*argv, "--dry-run"], spark) == 0 and not (tmp_path / "out").exists()
    assert cli.main(argv, spark) == 0
    got = {r.entity for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert {"logistic", "r1", "r2"} <= got and len(got) > 3
    assert "pairwise" in (tmp_path / "out" / "report.html").read_text()
    assert "right alone on" in (tmp_path / "out" / "report.txt").read_text()
    assert any("metrics" in f["path"] for f in json.loads((tmp_path / "out" / "manifest.json").read_text()))


def test_train_predict_evaluate(spark, table, tmp_path):
    model, data = str(tmp_path / "m"), str(table / "x.csv")
    assert cli.main(["train", data, "--out", model, "--id-column", "id", "--features", "a,b", "--models", "logistic", "--outer", "2"], spark) == 0
    _, meta = artifacts.load_model(spark, model)
    assert meta["features"] == ["a", "b"] and 0 < meta["threshold"] < 1
    assert cli.main(["predict", data, "--model", model, "--out", str(tmp_path / "p"), "--id-column", "id", "--proba"], spark) == 0
    got = spark.read.csv(str(tmp_path / "p"), header=True)
    assert got.count() == 240 and got.columns == ["id", "prob_class_0", "prob_class_1", "predicted_class", "optimal_threshold", "prob_diff_to_threshold"]
    assert cli.main(["predict", data, "--model", model, "--out", str(tmp_path / "q"), "--id-column", "id"], spark) == 0
    assert spark.read.csv(str(tmp_path / "q"), header=True).columns == ["id", "prediction"]
    assert dict(spark.read.parquet(f"{model}/importances").collect()).keys() == {"a", "b"}
    assert cli.main(["evaluate", data, "--model", model, "--out", str(tmp_path / "e")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "e" / "metrics")).first().auroc > 0.9
    assert spark.read.parquet(str(tmp_path / "e" / "thresholds")).where("metric = 'auroc'").first().difference == 0
    assert {r.label: r.support for r in spark.read.parquet(str(tmp_path / "e" / "report")).collect()}["macro"] == 240


def test_cross_and_ablation(spark, table, tmp_path):
    common = ["--id-column", "id", "--features", "a,b", "--models", "logistic", "--outer", "2"]
    assert cli.main(["cross-dataset", *(str(table / f"{n}.csv") for n in "xyz"), "--out", str(tmp_path / "c"), *common], spark) == 0
    cells = spark.read.parquet(str(tmp_path / "c" / "cells"))
    assert cells.where("metric = 'auroc'").count() == 9 and cells.count() == 9 * 13
    assert spark.read.parquet(str(tmp_path / "c" / "thresholds")).count() == 6 and spark.read.parquet(str(tmp_path / "c" / "failed")).count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"one": ["a"], "two": ["b"]}))
    assert cli.main(["ablation", str(table / "x.csv"), "--out", str(tmp_path / "a"), *common, "--feature-groups", str(tmp_path / "g.json")], spark) == 0
    assert cli.main(["ablation", str(table / "x.csv"), "--out", str(tmp_path / "m"), *common, "--feature-groups", str(tmp_path / "g.json"), "--metric", "brier"], spark) == 0
    assert {r.metric for r in spark.read.parquet(str(tmp_path / "m" / "ablation")).collect()} == {"brier"}
    run = json.loads((tmp_path / "c" / "run.json").read_text())
    assert run["settings"]["outer"] == 2 and len(run["environment"]["seeds"]) == 2 and run["environment"]["cpus"] and run["environment"]["versions"]["spark"]
    assert cli.main(["ablation", str(table / "x.csv"), "--out", str(tmp_path / "m"), *common, "--metric", "nope"], spark) == cli.INVALID
    got = spark.read.parquet(str(tmp_path / "a" / "ablation"))
    assert got.count() == 8 and got.where("metric = 'auroc' and name = 'one'").first().delta > 0.1


def test_param_config(spark, table, tmp_path):
    from plumbline.plans import experiments
    from plumbline.settings import Settings

    (tmp_path / "p.json").write_text(json.dumps({"logistic": {"regParam": [0.1, 0.001], "elasticNetParam": [0.0]}}))
    a = cli._parser().parse_args(["train", "x.csv", "--out", "o", "--models", "logistic", "--param-config", str(tmp_path / "p.json")])
    s = cli._settings(a)
    assert experiments.plan("logistic", s).grid == [{"regParam": 0.1, "elasticNetParam": 0.0}, {"regParam": 0.001, "elasticNetParam": 0.0}]
    assert experiments.plan("forest", s).grid is None
    assert Settings(grids={"nope": {"a": [1]}}).problems() and Settings(grids={"logistic": {"a": 1}}).problems() and not Settings(grids={"logistic": {"a": [1]}}).problems()


def test_names_of_the_package():
    import plumbline

    for name in plumbline.__all__:
        assert getattr(plumbline, name) is not None
    assert "auroc" in dir(plumbline)


def test_small_commands_and_exit_codes(spark, table, tmp_path, capsys):
    assert cli.main(["list-models"], spark) == 0 and cli.main(["version"], spark) == 0 and cli.main(["smoke-test"], spark) == 0
    assert cli.main(["validate", str(table / "x.csv")], spark) == 0
    assert cli.main(["validate", str(table / "x.csv"), "--target", "nope"], spark) == cli.INVALID
    assert cli.main(["validate", str(table / "none.csv")], spark) == cli.INVALID
    assert cli.main(["train", str(table / "x.csv"), "--out", str(tmp_path), "--models", "nope"], spark) == cli.INVALID
    assert "unknown model" in capsys.readouterr().err
