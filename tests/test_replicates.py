"""Weights, replicates and metrics of one's own; datasets against each other when folds fail."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import windows
from plumbline.operators import metrics, models, paired, replicates, transfer
from plumbline.operators.metrics import ratio


@pytest.fixture(scope="module")
def pred(spark):
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 500)
    p = np.round(np.clip(0.3 * y + 0.7 * r.random(500), 0, 1), 2)
    rows = [(e, i, int(a), float(b) if e != "R" else None, int(b >= t)) for e, t in (("A", 0.5), ("B", 0.7), ("R", 0.4)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "entity string, sample_id long, y_true int, y_prob double, y_pred int").repartition(4).cache()


def rows_of(pred, entity, b, seed="boot"):
    got = pred.where(F.col("entity") == entity).select("y_true", "y_prob", "y_pred", replicates.row_number_of(seed).alias("x")).collect()
    w = replicates.weights(np.array([r.x for r in got]), replicates.replicate_numbers(seed, b))
    return [np.array([r[c] for r in got], float) for c in ("y_true", "y_prob", "y_pred")], w.astype(float)


def test_weights_are_poisson():
    w = replicates.weights(np.random.default_rng(0).integers(0, replicates.PRIME, 4000), replicates.replicate_numbers("s", 500)).astype(float)
    share = np.bincount(w.astype(int).ravel(), minlength=11) / w.size
    assert np.allclose(share[:4], [0.3679, 0.3679, 0.1839, 0.0613], atol=0.002)
    assert abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.01
    total = w.sum(0)  # of independent weights: mean and variance 4,000
    assert abs(total.mean() - 4000) < 15 and 0.8 < total.var() / 4000 < 1.2
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


@pytest.mark.parametrize("slab", [2_000_000, 700])
def test_against_plain_sums(pred, monkeypatch, slab):
    """Each replicate by sums over rows; also with slabs of seven rows, so that equal scores lie in several."""
    monkeypatch.setattr(replicates, "SLAB", slab)
    (y, p, hard), w = rows_of(pred, "A", 100)
    counts = {r.replicate: r for r in replicates.count_replicates(pred, 100).where("entity = 'A'").collect()}
    got = {r.replicate: r for r in replicates.score_replicates(pred, 100, parts=4).where("entity = 'A'").collect()}
    assert len(got) == len(counts) == 100
    for r in range(0, 100, 9):
        v = w[:, r]
        tp, fp, fn = (v * y * hard).sum(), (v * (1 - y) * hard).sum(), (v * y * (1 - hard)).sum()
        assert counts[r].f1_1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
        above = (p[:, None] > p[None]) + 0.5 * (p[:, None] == p[None])
        auc = ((v * y)[:, None] * (v * (1 - y))[None] * above).sum() / ((v * y).sum() * (v * (1 - y)).sum())
        assert got[r].auroc == pytest.approx(auc) and got[r].cliffs_delta == pytest.approx(2 * auc - 1)
        assert got[r].brier == pytest.approx((v * (p - y) ** 2).sum() / v.sum())
        b = np.searchsorted(np.array(metrics.EDGES[1:]), p, "left")
        gaps = [(abs((v * (y - p))[b == i].sum()), v[b == i].sum()) for i in range(10)]
        assert got[r].ece == pytest.approx(sum(g for g, _ in gaps) / v.sum()) and got[r].mce == pytest.approx(max(g / n for g, n in gaps if n))


def test_rows_are_not_multiplied(pred):
    """No operator makes rows times replicates: what is shuffled is rows, and replicates times tasks or ranges."""
    plan = replicates.score_replicates(pred, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert "Generate" not in replicates.count_replicates(pred, 1000)._jdf.queryExecution().executedPlan().toString()


def test_a_metric_of_ones_own(pred):
    """Copies of built-in metrics get their values and intervals, by expression and by function."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))

    def brier(p, n1, n0):
        return float((n1 * (1 - p) ** 2 + n0 * p**2).sum() / (n1 + n0).sum())

    def area(p, n1, n0):
        return float((n1 * (np.cumsum(n0) - n0 / 2)).sum() / (n1.sum() * n0.sum()))

    replicates.register_metric("my_f1", expression=lambda: ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    replicates.register_metric("my_brier", function=brier)
    replicates.register_metric("my_area", function=area)
    try:
        for own, built in (("my_f1", "f1_1"), ("my_brier", "brier"), ("my_area", "auroc")):
            a, b = ({r.entity: r for r in replicates.intervals(pred, m, 200).collect()} for m in (own, built))
            assert set(a) == set(b) and len(a) == (3 if own == "my_f1" else 2)
            for e in a:
                assert [a[e].mean, a[e].lower, a[e].upper, a[e].n] == pytest.approx([b[e].mean, b[e].lower, b[e].upper, b[e].n])
            x, z = ({r.entity: r.value for r in replicates.metric_values(pred, ["entity"], [m]).collect()} for m in (own, built))
            assert {e: v for e, v in x.items()} == pytest.approx({e: v for e, v in z.items() if e in x})
        rows = pred.where("entity = 'A'").selectExpr("sample_id", "y_prob as a", "pmod(sample_id * 37, 11) / 11.0D as b", "y_true as y")
        got = models.leave_out(rows, ["a", "b"], {"a": ["a"], "b": ["b"]}, "y", "logistic", 2, metrics=("my_area", "auroc", "my_f1"))
        by = {(r.name, r.fold, r.metric): (r.baseline, r.ablated) for r in got.collect()}
        assert len(by) == 12 and all(by[n, f, "my_area"] == pytest.approx(by[n, f, "auroc"]) for n in "ab" for f in (0, 1))
        assert transfer.ablation_tests(got).where("name = 'a' and metric = 'my_area'").first().delta > 0.1
        with pytest.raises(KeyError):
            replicates.metric_values(pred, ["entity"], ["none"])
        for wrong in ({}, {"expression": lambda: tp, "function": brier}):
            with pytest.raises(ValueError):
                replicates.register_metric("x", **wrong)
        with pytest.raises(ValueError, match="built in"):
            replicates.register_metric("mcc", function=brier)
    finally:
        for n in ("my_f1", "my_brier", "my_area"):
            replicates.REGISTRY.pop(n, None)


def test_ranges_from_a_sketch(spark):
    """Ranges of lognormal, negative and tied values: none holds twice the mean, unless one value does."""
    df = spark.range(20_000).selectExpr("id % 2 as g", "case when id % 2 = 0 then exp(3 * randn(5)) * 1e6 else -exp(2 * randn(6)) end as v").cache()
    both = df.join(windows.range_cuts(df, ["g"], "v", 64), "g").withColumn("part", windows.range_bucket(F.col("v"), F.col("_cuts")))
    sizes = {(r.g, r.part): r["count"] for r in both.groupBy("g", "part").count().collect()}
    assert len(sizes) == 128 and max(sizes.values()) < 2 * 10_000 / 64
    wrong = both.where(F.col("part") != F.size(F.filter("_cuts", lambda c: c < F.col("v")))).count()
    assert wrong == 0


def test_a_failing_fold_leaves_its_cells_absent(spark, monkeypatch):
    rows = spark.range(240).selectExpr("id as sample_id", "concat('d', id % 3) as dataset", "(id * 37 % 101) / 101.0D as a", "(id * 53 % 97) / 97.0D as b").selectExpr("*", "cast(a + 0.3D * b > 0.65D as int) as y").cache()
    trained = models.trained

    def fails(train, *more):
        if train.select("dataset").distinct().count() == 1 and train.first().dataset == "d1" and (train.count() < 54 or fails.always):
            raise RuntimeError("planted")
        return trained(train, *more)

    fails.always = True
    monkeypatch.setattr(models, "trained", fails)
    failures, cuts = [], []
    plan = models.Plan("logistic", {"regParam": 0.01}, inner=2)
    with pytest.warns(UserWarning, match="planted"):
        got = models.cross(rows, ["a", "b"], "y", plan, 2, metrics=replicates.BUILT_IN, failures=failures, thresholds=cuts)
    cells = transfer.cells(got).collect()
    assert {(c.source, c.target) for c in cells} == {(s, t) for s in ("d0", "d2") for t in ("d0", "d1", "d2")}
    assert len(cells) == 6 * 13 and all(c.n_folds == 2 for c in cells)
    assert sorted(f[:2] for f in failures) == [("d1", 0), ("d1", 1)] and len(cuts) == 4 and all(0 < t < 1 for _, _, t in cuts)
    calls = []

    def once(train, *more):
        names = sorted(r.dataset for r in train.select("dataset").distinct().collect())
        if names == ["d2"] and not calls:
            calls.append(1)
            raise RuntimeError("planted")
        return trained(train, *more)

    monkeypatch.setattr(models, "trained", once)
    with pytest.warns(UserWarning, match="planted"):
        cells = {(c.source, c.target): c.n_folds for c in transfer.cells(models.cross(rows, ["a", "b"], "y", plan, 2)).collect()}
    assert cells["d2", "d0"] == 1 and cells["d0", "d2"] == 2
    monkeypatch.setattr(models, "trained", trained)
    held = models.held_out_datasets(rows, ["a", "b"], "y", plan, metrics=("auroc", "mcc", "brier")).collect()
    assert {r.held_out for r in held} == {"d0", "d1", "d2"} and all(r.auroc > 0.9 and r.mcc > 0.5 for r in held)


def test_order_of_any_numbers(spark):
    """Running sums, areas and distances over scores far outside [0, 1] equal plain ones."""
    from plumbline.operators import shift

    df = spark.range(6000).selectExpr("id as sample_id", "'m' as entity", "exp(4 * randn(7)) * 1e3 - 50 as y_prob", "cast(id % 3 = 0 as int) as y_true", "concat('d', id % 2) as dataset").selectExpr("sample_id", "entity", "y_prob + 100 * y_true as y_prob", "y_true", "dataset").cache()
    rows = df.collect()
    p, y = np.array([r.y_prob for r in rows]), np.array([r.y_true for r in rows])
    rank = np.empty(6000)
    rank[np.argsort(p, kind="stable")] = np.arange(1, 6001)
    n1 = y.sum()
    assert metrics.auroc(df, ["entity"]).first().auroc == pytest.approx((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (6000 - n1)))
    one = df.groupBy("entity", "y_prob").agg(F.count("*").alias("n"))
    for down in (False, True):
        got = {r.y_prob: r.upto for r in windows.running(one, ["entity"], "y_prob", {"upto": "n"}, down).collect()}
        order = np.sort(p)[::-1] if down else np.sort(p)
        assert all(got[v] == i + 1 for i, v in enumerate(order.tolist()))
    d = np.array([r.dataset for r in rows])
    at = np.sort(p)
    share = [np.searchsorted(np.sort(p[d == k]), at, "right") / (d == k).sum() for k in ("d0", "d1")]
    assert shift.ks(df, ["y_prob"]).first().distance == pytest.approx(np.abs(share[0] - share[1]).max())


def test_entities_of_a_sample_share_weights(monkeypatch):
    """A batch works out the weights of each sample once, whatever the number of its entities; sums are those of each row."""
    r, seen = np.random.default_rng(2), []
    x, names = np.repeat(r.integers(0, replicates.PRIME, 300), 5), ["A", "B", None, "R1", "R2"] * 300
    cell = r.integers(0, 4, 1500)
    w = replicates.weights(x, replicates.replicate_numbers("s", 40)).astype(np.int64)
    plain = replicates.weights
    monkeypatch.setattr(replicates, "weights", lambda x, numbers: seen.append(len(x)) or plain(x, numbers))
    monkeypatch.setattr(replicates, "SLAB", 40 * 70)
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(cell), pa.array(x)], names=["k0", "_c", "_x"])
    got = {b.column(0)[0].as_py(): b for b in replicates._counted(40, "s", 1)(iter([batch]))}
    assert sum(seen) == 300 and set(got) == {"A", "B", None, "R1", "R2"}
    for k, name in enumerate(["tp", "fp", "tn", "fn"]):
        for e in got:
            assert got[e].column(name).to_pylist() == w[[n == e and c == k for n, c in zip(names, cell)]].sum(0).tolist()


def test_weights_at_the_ends_of_steps():
    """Hashes at, below and above multiples of the prime and every step, against whole numbers."""
    r, p = np.random.default_rng(3), replicates.PRIME
    for h in [0, 1, p - 1] + [s + d for s in replicates.STEPS for d in (-1, 0, 1)]:
        x, a, b = (r.integers(0, p, 60).tolist() for _ in range(3))
        numbers = np.array([[i, j, (h - i * v * v - j * v) % p] for v, i, j in zip(x, a, b)])
        got = replicates.weights(np.array(x), numbers).diagonal()
        assert (got == sum(h >= s for s in replicates.STEPS)).all()


def test_buckets_by_halving(spark):
    """The bucket of a value among many cuts is found by halving, and is that of bisection; nothing is below null."""
    cuts = [float(c) for c in np.unique(np.random.default_rng(4).normal(size=255))]
    bucket = windows.range_bucket(F.col("v"), F.col("c"), 8)
    assert "filter" not in str(bucket)
    df = spark.createDataFrame([(v, cuts[:n]) for n in (0, 1, 2, 63, 64, 254, 255) for v in [*cuts[::9], -9.0, 0.1, 9.0, float("nan"), None]] + [(1.0, None)], "v double, c array<double>")
    for r in df.withColumn("b", bucket).withColumn("any", windows.range_bucket(F.col("v"), F.col("c"))).collect():
        want = 0 if r.v is None or r.c is None else len(r.c) if r.v != r.v else int(np.searchsorted(r.c, r.v, "left"))
        assert r.b == r["any"] == want


def test_comparison_meets_by_sample_once(spark, monkeypatch):
    """Samples that some entity lacks and entities with other labels play no part; rows are aligned once, not again for each test."""
    r, rows = np.random.default_rng(5), []
    for i in range(400):
        y = int(r.integers(0, 2))
        for e, scored in (("A", True), ("B", True), ("R", False), ("X", False)):
            if e != "R" or i % 9:
                p = float(np.round(0.4 * y + 0.6 * r.random(), 2))
                rows.append((i, e, "model" if scored else "rule", 1 - y if e == "X" and i == 10 else y, p if scored else None, int(p > 0.5)))
    pred = spark.createDataFrame(rows, "sample_id long, entity string, entity_type string, y_true int, y_prob double, y_pred int")
    aligned = paired.align(pred)
    auroc = {e.entity: e.auroc for e in metrics.auroc(aligned.where("y_prob is not null"), ["entity"]).collect()}
    monkeypatch.setattr(paired, "align", None)
    got = {(t.name_a, t.name_b, t.test): t for t in paired.compare(pred).collect()}
    assert set(got) == {("A", "B", "mcnemar"), ("A", "R", "mcnemar"), ("B", "R", "mcnemar"), ("A", "B", "delong")}
    ok = {(i, e): y == c for i, e, _, y, _, c in rows if i % 9}
    for a, b, test in got:
        t, both = got[a, b, test], [(ok[i, a], ok[i, b]) for i in range(400) if i % 9]
        assert t.n_total == len(both)
        if test == "mcnemar":
            assert (t.discordant_b, t.discordant_c) == (both.count((True, False)), both.count((False, True)))
        else:
            assert t.auroc_a == pytest.approx(auroc["A"]) and t.auroc_b == pytest.approx(auroc["B"])
