"""Values known in closed form, files, and training on a learnable label."""

import math

import pytest

from plumbline.functions import stats
from plumbline.operators import clean, folds, intervals, metrics, models, paired, rules
from plumbline.sources import files


def test_distributions():
    assert stats.mcnemar(0, 0) == (0.0, 1.0) and stats.mcnemar(1, 0) == (1.0, 1.0)
    assert abs(stats.chi2_1_sf(3.841458821) - 0.05) < 1e-9 and abs(stats.normal_two_sided(1.959963985) - 0.05) < 1e-9
    assert abs(stats.student_two_sided(2.228138852, 10) - 0.05) < 1e-8 and abs(stats.student_two_sided(0.5, 4) - 0.643330) < 1e-5
    assert abs(stats.binomial_two_sided(3, 10) - 0.34375) < 1e-12
    assert stats.sample_size(0.5) == 63 and stats.sample_size(0.5, test="wilcoxon") == 66
    assert [folds.minority_needed(*x) for x in ((10, 5), (2, 2), (3, 10))] == [10, 4, 15]
    lo, hi = stats.bca_levels(500, 1000, 0.0)
    assert abs(lo - 0.025) < 1e-12 and abs(hi - 0.975) < 1e-12 and stats.bca_levels(0, 10, 0.1) is None


def test_effects(spark):
    rows = [("a", "b", 1000, 80, 20), ("a", "c", 1000, 50, 50), ("a", "d", 100, 30, 0), ("a", "e", 10, 0, 0)]
    got = {r.name_b: r for r in paired.effects(spark.createDataFrame(rows, "name_a string, name_b string, n long, b_count long, c_count long")).collect()}
    assert abs(got["b"].acc_diff - 0.06) < 1e-12 and got["c"].acc_diff == 0 and abs(got["d"].odds - 61) < 1e-9 and got["e"].odds is None


def test_perfect_scores(spark):
    y, p = [0] * 5 + [1] * 5, [0.1, 0.1, 0.2, 0.1, 0.2, 0.9, 0.9, 0.8, 0.9, 0.8]
    df = spark.createDataFrame([("x", i, "model", a, b, int(b >= 0.5)) for i, (a, b) in enumerate(zip(y, p))], "entity string, sample_id long, entity_type string, y_true int, y_prob double, y_pred int")
    best = metrics.youden(df, ["entity"]).first()
    assert best.threshold == 0.8 and best.j == 1.0
    assert metrics.auroc(df, ["entity"]).first().auroc == 1.0
    one = metrics.auroc(df.where("y_true = 1"), ["entity"]).first()
    assert one.auroc is None
    ci = {r.metric: r for r in intervals.count_intervals(df, ["entity"], b=100).collect()}
    assert ci["mcc"].point == 1.0 and ci["mcc"].method == "percentile" and ci["mcc"].lower == 1.0
    assert [metrics.method_for(n) for n in (999, 1000)] == ["oof", "cv"]


def test_rules_and_flags(spark):
    assert rules.parse("A AND B AND C") == (["A", "B", "C"], "AND")
    for bad in ("A", "A AND B OR C", "A and B"):
        with pytest.raises(ValueError):
            rules.parse(bad)
    assert rules.defaults(["A", "B"]) == ["A AND B", "A OR B"] and len(rules.defaults(["A", "B", "C"])) == 8
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 3)], "id int, x double, z int")
    assert clean.nan_to_null(df).where("x is null").count() == 1
    assert clean.drop_missing(clean.nan_to_null(df), ["x"]).count() == 1


def test_files(spark, tmp_path):
    rows = "feature1,feature2,state\n1.0,0.5,0\n2.0,NA,1\n1.0,0.5,0\n"
    (tmp_path / "a.csv").write_text(rows)
    (tmp_path / "b.tsv").write_text(rows.replace(",", "\t"))
    (tmp_path / "c.txt").write_text(rows.replace(",", ";"))
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.any").write_text("x")
    for n in ("a.csv", "b.tsv", "c.txt"):
        df = files.read(spark, str(tmp_path), n, distinct=True)
        assert df.dtypes == [("feature1", "double"), ("feature2", "double"), ("state", "bigint")] and df.count() == 2
    assert files.read_mixed(spark, str(tmp_path / "a.csv")).count() == 3
    for n, e in (("d.txt", ValueError), ("e.any", ValueError), ("no.csv", FileNotFoundError), ("../x.csv", ValueError), ("f.xls", NotImplementedError)):
        with pytest.raises(e):
            files.read(spark, str(tmp_path), n)
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "a.csv", id_column="nope")
    both = files.read_many(spark, str(tmp_path), [{"filename": "a.csv", "name": "x"}, {"filename": "b.tsv", "name": "y", "drop_duplicates": False}])
    assert {r.dataset: r["count"] for r in both.groupBy("dataset").count().collect()} == {"x": 2, "y": 3}
    assert files.run_key({"a": 1}, both) == files.run_key({"a": 1}, both.repartition(3)) != files.run_key({"a": 2}, both)
    store = files.PredictionStore(spark, str(tmp_path / "oof"))
    pred = spark.createDataFrame([("d", "m", 0, 1, 0.4), ("d", "m", 1, 2, 0.6)], "dataset string, entity string, fold int, sample_id long, y_prob double")
    store.put(pred, "k1")
    store.put(pred.where("fold = 1"), "k1")
    assert store.get("k1").count() == 2 and store.folds().count() == 2
    assert files.manifest(spark, str(tmp_path / "oof")).count() >= 2
    assert files.listed("a, b,,c") == ["a", "b", "c"]


def test_training(spark):
    rows = spark.range(600).selectExpr("id as sample_id", "(id * 37 % 101) / 101.0D as a", "(id * 53 % 97) / 97.0D as b").selectExpr("*", "cast(a + 0.3D * b > 0.65D as int) as y")
    oof = models.out_of_fold(rows, ["a", "b"], "y", "logistic", 3, regParam=0.001)
    assert oof.count() == 600 and metrics.auroc(oof, ["entity"]).first().auroc > 0.95
    s = models.shapley_linear(rows, ["a", "b"], "y", regParam=0.01).selectExpr("max(abs(base + phi['a'] + phi['b'] - margin)) as e").first()
    assert s.e < 1e-9
    with pytest.raises(KeyError):
        models.estimator("nope")
    assert math.isclose(sum(v for _, v in models.importances(models.fit(rows, ["a", "b"], "y", "forest", numTrees=5), ["a", "b"])), 1.0)


def test_score_intervals(spark):
    """Against a bootstrap of the rows and the values without each block, in plain code."""
    import numpy as np

    rng = np.random.default_rng(1)
    y = (rng.random(300) < 0.4).astype(int)
    p = np.round(np.clip(0.35 * y + rng.normal(0.3, 0.25, 300), 0, 1), 2)
    rows = [("x", i, "model", int(a), float(q), int(q >= 0.5)) for i, (a, q) in enumerate(zip(y, p))] + [("r", i, "rule", int(a), None, int(a)) for i, a in enumerate(y)]
    df = spark.createDataFrame(rows, "entity string, sample_id long, entity_type string, y_true int, y_prob double, y_pred int")
    whole = metrics.all_metrics(df.where("entity = 'x'"), ["entity"]).first().asDict()
    got = {r.metric: r for r in intervals.all_intervals(df, ["entity"], b=1000).where("entity = 'x'").collect()}
    assert set(got) == {*metrics.scores(), "auroc", "brier", "ece", "mce", "cliffs_delta"}
    assert all(abs(got[m].point - whole[m]) < 1e-9 for m in got if m != "cliffs_delta") and abs(got["cliffs_delta"].point - 2 * whole["auroc"] + 1) < 1e-9
    assert all(r.valid for r in got.values())

    def values(y, p):
        pos, neg = p[y == 1], p[y == 0]
        edge = np.searchsorted(metrics.EDGES, p, "left").clip(1) - 1
        gap = np.array([[(y[edge == i] - p[edge == i]).sum(), (edge == i).sum()] for i in range(10) if (edge == i).any()])
        auroc = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
        return {"auroc": auroc, "brier": ((p - y) ** 2).mean(), "ece": abs(gap[:, 0]).sum() / len(y), "mce": (abs(gap[:, 0]) / gap[:, 1]).max(), "cliffs_delta": 2 * auroc - 1}

    drawn = [values(y[i], p[i]) for i in rng.integers(0, 300, (2000, 300))]
    left = {r.sample_id: r.k for r in df.where("entity = 'x'").selectExpr("sample_id", "pmod(xxhash64(sample_id), 200) as k").collect()}
    k = np.array([left[i] for i in range(300)])
    jack = [values(y[k != i], p[k != i]) for i in set(k.tolist())]
    for m in drawn[0]:
        v, d = np.array([x[m] for x in drawn]), np.array([x[m] for x in jack])
        d = d.mean() - d
        found = stats.bca_levels(int((v < got[m].point).sum()), len(v), float((d**3).sum() / (6 * (d * d).sum() ** 1.5)), 0.95)
        assert got[m].method == ("bca" if found else "percentile")
        assert abs(got[m].std / v.std() - 1) < 0.1 and abs(got[m].mean - v.mean()) < 0.15 * v.std()
        for bound, want in zip((got[m].lower, got[m].upper), np.quantile(v, found or (0.025, 0.975))):
            assert abs(bound - want) < 0.5 * v.std(), m


def test_bootstrap_of_all_predictions(spark, monkeypatch):
    """All datasets, against plain code with the same hashes."""
    import hashlib

    import numpy as np

    from plumbline import catalog

    rows = [(e, f"{i % 5}-X", i, int(i % 3 == 0), int(i % k < 2)) for e, k in (("A", 5), ("B", 6)) for i in range(30)]
    monkeypatch.setattr(catalog, "predictions", lambda s, d: s.createDataFrame(rows, "entity string, dataset string, sample_id long, y_true int, y_pred int"))
    got = {r.entity: r for r in catalog.queries()["bootstrap_percentile"](spark, "").collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    prime = 2**31 - 1
    steps = [int(prime * sum(2.718281828459045**-1 / m for m in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)[: k + 1])) for k in range(10)]
    x = [int(md5(f"boot:{i}")[:8], 16) % prime for i in range(30)]
    for e in "AB":
        own = [r for r in rows if r[0] == e]
        values = []
        for rep in range(catalog.REPLICATES):
            cells = np.zeros((2, 2))
            ra, rb, rc = (int(md5(f"boot|{rep}")[8 * k : 8 * k + 8], 16) % prime for k in range(3))
            for r in own:
                h = ((ra * x[r[2]] + rb) % prime * x[r[2]] + rc) % prime
                cells[r[3], r[4]] += sum(h >= t for t in steps)
            (tn, fp), (fn, tp) = cells
            if tp + fn and fp + tn:
                below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
                values.append((tp * tn - fp * fn) / below**0.5 if below else 0.0)
        want = [np.mean(values), *np.quantile(values, [0.025, 0.975])]
        assert np.allclose([got[e].mean, got[e].lower, got[e].upper], want, rtol=0, atol=2e-6)


def test_confined_on_stores():
    assert files.confined("s3a://bucket/a/", "b/../c.csv") == "s3a://bucket/a/c.csv"
    assert files.confined("file:///tmp/x", "c.csv") == "file:///tmp/x/c.csv"
    assert files.confined(".", "c.csv") == "c.csv" and files.confined("/", "c.csv") == "/c.csv"
    for root, name in (("s3a://bucket/a", "../c.csv"), ("s3a://bucket/a", "s3a://other/c.csv"), (".", "../c.csv"), ("/a", "/b/c.csv"), ("/a", "../ab/c.csv")):
        with pytest.raises(ValueError):
            files.confined(root, name)


def test_texts_through_csv(spark, tmp_path):
    """Quotes, line ends, blanks and delimiters inside values come back; a comma in a value is none in a table of tabs."""
    rows = [(1, ' a "b", c '), (2, "x\ny"), (3, ""), (4, "NA"), (5, 'tab\tand ""'), (6, "back\\slash"), (7, "\\"), (8, '"')]
    for name, sep in (("t.csv", ","), ("t.tsv", "\t")):
        files.write_csv(spark.createDataFrame(rows, "k long, v string"), str(tmp_path / name), sep)
        got = {r.k: r.v for r in files.read(spark, f"file://{tmp_path}", name, multiline=True).collect()}
        assert got == {k: None if v in ("", "NA") else v for k, v in rows}
    (tmp_path / "q.csv").write_text('k,v\n1,"say ""no"" twice"\n')
    assert files.read(spark, str(tmp_path), "q.csv").first().v == 'say "no" twice'


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.warns(UserWarning, match="gone"):
        assert files.read(spark, str(tmp_path), "a.csv", ["y", "gone", "x"]).columns == ["y", "x"]
