"""Paired comparison of entities on the same samples: alignment, McNemar, DeLong, corrections, effect sizes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions.storage import kept, let_go
from plumbline.functions.windows import running

P_FLOOR = 1e-10


def align(pred: DataFrame) -> DataFrame:
    """Rows of samples that every entity has, without entities whose labels differ from those of the first (by name)."""
    k = pred.select("entity").distinct().count()
    ids = pred.groupBy("sample_id").agg(F.count_distinct("entity").alias("k")).where(F.col("k") == k).select("sample_id")
    rows = pred.join(ids, "sample_id", "left_semi")
    first = F.min_by("y_true", "entity").over(Window.partitionBy("sample_id"))
    bad = rows.withColumn("y0", first).where("y_true != y0").select("entity").distinct()
    return rows.join(bad, "entity", "left_anti")


def pairs(pred: DataFrame) -> DataFrame:
    """entity a, b (a < b), n and the discordant counts: b_count a right and b wrong, c_count the reverse.

    Entities become a list in one row for each sample, so there is one shuffle by sample whatever their number; pairs are made of
    each list that differs, once."""
    right = pred.select("sample_id", F.struct("entity", (F.col("y_pred") == F.col("y_true")).alias("ok")).alias("e"))
    return _pairs_of(right.groupBy("sample_id").agg(F.sort_array(F.collect_list("e")).alias("es")))


def _pairs_of(each: DataFrame) -> DataFrame:
    """Pairs of samples' lists `es` of entity and ok, by the number of samples that have a list."""
    some = each.groupBy("es").agg(F.count("*").alias("_k"))
    a, b = some.select("_k", "es", F.explode("es").alias("a")), F.explode(F.filter("es", lambda x: x["entity"] > F.col("a.entity"))).alias("b")
    both = a.select("_k", "a", b)
    of = lambda c: F.sum(F.when(c, F.col("_k")).otherwise(0))
    return both.groupBy(F.col("a.entity").alias("name_a"), F.col("b.entity").alias("name_b")).agg(
        F.sum("_k").alias("n"), of(F.col("a.ok") & ~F.col("b.ok")).alias("b_count"), of(~F.col("a.ok") & F.col("b.ok")).alias("c_count")
    )


def mcnemar_statistic(discordant: DataFrame) -> DataFrame:
    """Adds the statistic: b if exact (under 25 discordant samples), else with continuity correction."""
    b, c = F.col("b_count").cast("double"), F.col("c_count").cast("double")
    return discordant.withColumn("exact", b + c < 25).withColumn("statistic", F.when(b + c < 25, b).otherwise(F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2.0)), b + c)))


def effects(discordant: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds accuracy difference and odds ratio with Wald intervals; both counts 0 give a null odds ratio."""
    z = F.lit(NormalDist().inv_cdf((1 + level) / 2))
    b, c, n = (F.col(x).cast("double") for x in ("b_count", "c_count", "n"))
    d = F.try_divide(b - c, n)
    se = F.try_divide(F.sqrt(b + c - F.try_divide((b - c) * (b - c), n)), n)
    h = F.when((b == 0) | (c == 0), 0.5).otherwise(0.0)
    odds = F.when(b + c > 0, (b + h) / (c + h))
    se_log = F.sqrt(F.try_divide(F.lit(1.0), b + h) + F.try_divide(F.lit(1.0), c + h))
    return discordant.select("*", d.alias("acc_diff"), (d - z * se).alias("acc_lo"), (d + z * se).alias("acc_hi"), odds.alias("odds"), (odds * F.exp(-z * se_log)).alias("odds_lo"), (odds * F.exp(z * se_log)).alias("odds_hi"))


def placements(pred: DataFrame) -> DataFrame:
    """entity, sample_id, y_true, v: the share of the other class that a sample outscores, ties half."""
    rows = pred.where("y_prob is not null")
    by = rows.groupBy("entity", "y_prob").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    by = running(by, ["entity"], "y_prob", {"pos_upto": "pos", "neg_upto": "neg"})
    n = rows.groupBy("entity").agg(F.sum("y_true").cast("double").alias("n1"), F.sum(1 - F.col("y_true")).cast("double").alias("n0"))
    by = by.join(F.broadcast(n), "entity")
    above = F.try_divide(F.col("neg_upto") - F.col("neg") / 2.0, F.col("n0"))
    below = 1 - F.try_divide(F.col("pos_upto") - F.col("pos") / 2.0, F.col("n1"))
    by = by.select("entity", "y_prob", above.alias("v1"), below.alias("v0"))
    return rows.select("entity", "sample_id", "y_true", "y_prob").join(by, ["entity", "y_prob"]).select("entity", "sample_id", "y_true", F.when(F.col("y_true") == 1, F.col("v1")).otherwise(F.col("v0")).alias("v"))


def delong_pairs(pred: DataFrame) -> DataFrame:
    """name_a, name_b (a < b), auroc_a, auroc_b, diff, variance, z, n of every pair of entities with scores, over the samples
    that both have: placements once, then one row for each sample with its entities, as in `pairs`."""
    v = placements(pred)
    each = v.groupBy("sample_id", "y_true").agg(F.sort_array(F.collect_list(F.struct("entity", "v"))).alias("es"))
    one = each.select("y_true", "es", F.explode("es").alias("a"))
    both = one.select("y_true", "a", F.explode(F.filter("es", lambda x: x["entity"] > F.col("a.entity"))).alias("b"))
    both = both.select(F.col("a.entity").alias("name_a"), F.col("b.entity").alias("name_b"), "y_true", F.col("a.v").alias("va"), F.col("b.v").alias("vb"))
    per = both.groupBy("name_a", "name_b", "y_true").agg(F.count("*").alias("n"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"), (F.var_samp("va") + F.var_samp("vb") - 2 * F.covar_samp("va", "vb")).alias("s"))
    pos = lambda c: F.max(F.when(F.col("y_true") == 1, F.col(c)))
    out = per.groupBy("name_a", "name_b").agg(pos("ma").alias("auroc_a"), pos("mb").alias("auroc_b"), F.sum(F.col("s") / F.col("n")).alias("variance"), F.sum("n").alias("n"))
    diff = F.col("auroc_a") - F.col("auroc_b")
    return out.select("name_a", "name_b", "auroc_a", "auroc_b", diff.alias("diff"), "variance", F.when(F.col("variance") > 0, F.try_divide(diff, F.sqrt("variance"))).alias("z"), "n")


def delong(pred: DataFrame, a: str, b: str) -> DataFrame:
    """auroc_a, auroc_b, diff, variance, z of one pair."""
    out = delong_pairs(pred.where(F.col("entity").isin(a, b))).select("auroc_a", "auroc_b", "diff", "variance", "z")
    swapped = out.select(F.col("auroc_b").alias("auroc_a"), F.col("auroc_a").alias("auroc_b"), (-F.col("diff")).alias("diff"), "variance", (-F.col("z")).alias("z"))
    return out if a < b else swapped


def holm(tests: DataFrame, family: str = "family", p: str = "p", tie: str = "name") -> DataFrame:
    """Adds p_holm. Families are small: one row for each test."""
    w = Window.partitionBy(family).orderBy(p, tie)
    n = F.count("*").over(Window.partitionBy(family))
    raw = F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("_r", raw).withColumn("p_holm", F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")


def benjamini_hochberg(tests: DataFrame, family: str = "family", p: str = "p", tie: str = "name") -> DataFrame:
    w = Window.partitionBy(family).orderBy(p, tie)
    n = F.count("*").over(Window.partitionBy(family))
    raw = F.least(F.lit(1.0), F.col(p) * n / F.row_number().over(w))
    back = Window.partitionBy(family).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_r", raw).withColumn("p_bh", F.min("_r").over(back)).drop("_r")


def compare(pred: DataFrame, method: str = "holm", alpha: float = 0.05, level: float = 0.95) -> DataFrame:
    """Every pair with a model in it: McNemar (and DeLong between models with scores), corrected by family, with effect sizes.

    `better` is the one with more right predictions, or the larger AUROC; null for a draw.  p values need functions that
    Spark lacks; they are computed on the driver from one row for each pair."""
    kinds = {r.entity: (r.entity_type, r.scored) for r in pred.groupBy("entity").agg(F.first("entity_type").alias("entity_type"), F.max(F.col("y_prob").isNotNull()).alias("scored")).collect()}
    each = kept(_aligned(pred, len(kinds)))  # read by all tests
    try:
        bad = [r.entity for r in each.select(F.explode("bad").alias("entity")).distinct().collect()]
        tests = _tests(each, {e: kind for e, kind in kinds.items() if e not in bad}, bad, level)
    finally:
        let_go(each)
    tests = pred.sparkSession.createDataFrame(tests, TESTS).withColumn("name", F.concat_ws("|", "name_a", "name_b"))
    corrected = holm(tests, p="p_value") if method == "holm" else benjamini_hochberg(tests, p="p_value")
    c = "p_holm" if method == "holm" else "p_bh"
    return corrected.withColumnRenamed(c, "p_value_corrected").withColumn("significant", F.col("p_value_corrected") <= alpha).drop("name")


def _aligned(pred: DataFrame, k: int) -> DataFrame:
    """sample_id, es (entity, y_true, ok, y_prob) and bad (entities whose label is not that of the first) of the samples that all k
    entities have: rows meet by sample once."""
    e = F.struct("entity", "y_true", (F.col("y_pred") == F.col("y_true")).alias("ok"), F.col("y_prob").cast("double").alias("y_prob"))
    each = pred.groupBy("sample_id").agg(F.sort_array(F.collect_list(e)).alias("es"))
    each = each.where(F.size(F.array_distinct(F.col("es.entity"))) == k)
    bad = F.transform(F.filter("es", lambda x: x["y_true"] != F.col("es")[0]["y_true"]), lambda x: x["entity"])
    return each.select("sample_id", "es", bad.alias("bad"))


TESTS = "name_a string, name_b string, comparison_type string, test string, family string, better string, statistic double, p_value double, n_total long, discordant_b long, discordant_c long, acc_diff double, acc_lo double, acc_hi double, odds double, odds_lo double, odds_hi double, auroc_a double, auroc_b double, auroc_diff double"


def _tests(each: DataFrame, kinds: dict[str, tuple[str, bool]], bad: list[str], level: float) -> list[tuple]:
    """A row for each test, as in `TESTS`, over the samples of `_aligned` without the entities that are bad."""
    better = lambda r, d: None if not d else r.name_a if d > 0 else r.name_b
    out = []
    right = F.transform(F.filter("es", lambda x: ~x["entity"].isin(bad)) if bad else "es", lambda x: F.struct(x["entity"].alias("entity"), x["ok"].alias("ok")))
    for r in effects(mcnemar_statistic(_pairs_of(each.select(right.alias("es")))), level).collect():
        types = {kinds[r.name_a][0], kinds[r.name_b][0]}
        if "model" not in types:
            continue
        x, p = stats.mcnemar(r.b_count, r.c_count)
        kind = "model vs model" if types == {"model"} else "model vs rule"
        out.append((r.name_a, r.name_b, kind, "mcnemar", "point", better(r, r.b_count - r.c_count), x, p, r.n, r.b_count, r.c_count, r.acc_diff, r.acc_lo, r.acc_hi, r.odds, r.odds_lo, r.odds_hi, None, None, None))
    scored = [e for e, (t, has) in kinds.items() if t == "model" and has]
    with_scores = each.select("sample_id", F.explode(F.filter("es", lambda x: x["entity"].isin(scored))).alias("e")).select("sample_id", "e.*")
    for r in delong_pairs(with_scores).collect() if len(scored) > 1 else []:
        p = 1.0 if r.z is None else stats.normal_two_sided(r.z)
        out.append((r.name_a, r.name_b, "model vs model", "delong", "auroc", better(r, r["diff"]), r.z, p, r.n, None, None, None, None, None, None, None, None, r.auroc_a, r.auroc_b, r["diff"]))
    return out


def q_matrix(tests: DataFrame, names: list[str]) -> DataFrame:
    """name_a and, for each name_b, -log10 of the least corrected p of the pair (of at least 1e-10)."""
    return tests.groupBy("name_a").pivot("name_b", names).agg(F.min(-F.log10(F.greatest("p_value_corrected", F.lit(P_FLOOR)))))
