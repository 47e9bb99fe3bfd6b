"""What larger tables showed: results that do not depend on how rows are dealt, and work that is done once."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.functions import storage, windows
from plumbline.functions.rounding import rounded
from plumbline.operators import boosting, metric_tree, models
from plumbline.plans import experiments


def test_halves_round_as_the_sql_does(spark):
    values = [0.5156135, 0.5117725, -0.5156135, 0.0000005, 1.0000015, 2.5, 0.0, 1e300, float("inf"), 123456.1234565]
    db = duckdb.connect()
    want = [db.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.v for r in catalog.tidy(rows.orderBy("i")).collect()] == want
    assert rows.select(rounded(F.lit(None).cast("double"), 6).alias("v")).first().v is None
    assert np.isnan(rows.select(rounded(F.lit(float("nan")), 6).alias("v")).first().v)

def test_cuts_of_running_sums_do_not_depend_on_partitions(spark):
    rows = spark.range(60_000).select(F.lit("a").alias("k"), (F.xxhash64("id") / F.lit(2.0**63)).alias("v"), F.lit(1).alias("n")).localCheckpoint()
    cuts = [windows.sampled_cuts(rows.repartition(p, F.xxhash64("v", F.lit(p))), ["k"], "v").first()["_cuts"] for p in (3, 7, 16)]
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) == 63
    bucket = rows.withColumn("_cuts", F.array(*map(F.lit, cuts[0]))).groupBy(windows.range_bucket(F.col("v"), F.col("_cuts")).alias("b")).count().collect()
    assert len(bucket) == 64 and max(r["count"] for r in bucket) < 4 * 60_000 / 64
    got = {r.v: r.upto for r in windows.running(rows, ["k"], "v", {"upto": "n"}).collect()}
    assert [got[v] for v in sorted(got)] == list(range(1, 60_001))


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.range(600).selectExpr("id as sample_id", "cast(id % 10 as double) as a", "cast(id % 7 as double) as b", "cast(case when id % 10 + id % 7 > 8 then 1 else 0 end as int) as y")
    return df.localCheckpoint()


def test_folds_are_dealt_once(labelled, monkeypatch):
    dealt = []
    monkeypatch.setattr(models, "kept", lambda df: dealt.append(df.columns) or storage.kept(df))
    model = models.fit_calibrated(labelled, ["a", "b"], "y", "logistic", 2, regParam=0.01)
    assert len(dealt) == 1 and models.score(model, labelled).where("y_prob is null").count() == 0
    dealt.clear()
    assert models.tuned(labelled, ["a", "b"], "y", models.Plan("logistic", inner=2), {"regParam": 0.01}) < 1
    assert len(dealt) == 1  # the fits inside read what was written


def test_rows_alike_are_boosted_as_one(spark, labelled):
    rows = labelled.selectExpr("cast(concat(a, b) as binary) as b", "cast(y as double) as y", "1.5D as w", "0D as margin")
    got = boosting.alike(rows)
    assert got.count() == 70 and got.agg(F.sum("w")).first()[0] == 900.0


def test_shares_by_orders_need_no_shuffle(spark, labelled):
    model = models.fit(labelled, ["a", "b"], "y", "logistic", regParam=0.01)
    twice = labelled.unionAll(labelled.limit(1))
    got = models.shapley_sampled(model, twice, ["a", "b"], orders=3)
    assert "Exchange" not in models.shapley_sampled(model, labelled, ["a", "b"], orders=3)._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 601
    assert got.selectExpr("max(abs(base + phi['a'] + phi['b'] - y_prob)) as e").first().e < 1e-9
    want = {r.sample_id: r.y_prob for r in models.score(model, labelled).collect()}
    assert all(abs(want[r.sample_id] - r.y_prob) < 1e-12 for r in got.collect())


def test_a_step_of_distances_holds_a_slab(monkeypatch):
    x, y = np.random.default_rng(1).normal(size=(50, 8)), np.random.default_rng(2).normal(size=(37, 8))
    want = ((x[:, None, :] - y[None]) ** 2).sum(2)
    for slab in (1, 8, 100, 10**6):
        monkeypatch.setattr(metric_tree, "SLAB", slab)
        assert (metric_tree.squared(x, y) == want).all()
    monkeypatch.setattr(metric_tree, "SLAB", 64)
    copies = np.concatenate([np.zeros((40, 8)), y])
    d2, at = metric_tree.Balls(copies, 5).nearest(np.zeros((9, 8)), 3, np.full(9, np.inf))
    assert (d2 == 0).all() and (at == [0, 1, 2]).all()


def test_equal_rows_are_numbered_in_blocks(spark):
    rows = spark.range(20_000).selectExpr("'x' as a", "if(id < 3, 'p', 'q') as b")
    got = experiments.numbered(rows)
    assert got.agg(F.count_distinct("sample_id")).first()[0] == got.count() == 20_000
    most = got.where("b = 'q'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 19_997


def test_a_mini_batch_reads_its_own_folder(spark):
    rows = spark.range(400).selectExpr("array(cast(id % 5 as double)) as x", "cast(id % 2 as double) as y", "1D as w", "cast(id % 4 as int) - 1 as part")
    data = storage.kept(rows, by=("part",))
    assert data.where("part = 2").count() == 100 and len({f.rsplit("/", 2)[1] for f in data.inputFiles()}) == 4
    plan = data.where(F.col("part").isin([-1, 0])).select("x", "y", "w", "part")
    assert {r.part for r in plan.collect()} == {-1, 0} and "PartitionFilters: [part" in plan._jdf.queryExecution().executedPlan().toString()
    storage.let_go(data)
