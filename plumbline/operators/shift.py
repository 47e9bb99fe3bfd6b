"""Distribution shift between datasets: two-sample KS distance, gaps of proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import range_bucket, range_cuts
from plumbline.operators.profile import unpivot


def feature_types(df: DataFrame, columns: list[str], continuous: tuple[str, ...] = ()) -> DataFrame:
    """feature, type: binary if 0 or 1 wherever not null, unless named continuous."""
    out = unpivot(df, [], columns).groupBy("feature").agg(F.coalesce(F.bool_and(F.col("value").isNull() | F.col("value").isin(0.0, 1.0)), F.lit(True)).alias("binary"))
    return out.select("feature", F.when(F.col("binary") & ~F.col("feature").isin(*continuous or ("",)), "binary").otherwise("continuous").alias("type"))


def ks(df: DataFrame, columns: list[str], dataset: str = "dataset") -> DataFrame:
    """a, b, feature, distance for every pair of datasets.

    Values become counts by (feature, value, dataset) first; running sums are taken in ranges of a feature's values that
    hold about as many rows each, whatever their distribution (equal values always share a range)."""
    rows = unpivot(df, [dataset], columns).where("value is not null")
    names = rows.groupBy("feature", dataset).agg(F.count("*").alias("total"))
    cuts = range_cuts(rows, ["feature"], "value", 256)  # a row for each feature
    counts = rows.groupBy("feature", "value", dataset).agg(F.count("*").alias("n")).join(F.broadcast(cuts), "feature")
    part = range_bucket(F.col("value"), F.col("_cuts"))
    points = counts.groupBy("feature", "value", part.alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(dataset, "n"))).alias("m"))
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col(f"a.{dataset}") < F.col(f"b.{dataset}")))
    pairs = pairs.select(F.col("a.feature").alias("feature"), F.col(f"a.{dataset}").alias("a"), F.col(f"b.{dataset}").alias("b"), F.col("a.total").alias("ta"), F.col("b.total").alias("tb"))
    both = points.join(pairs, "feature")  # pairs grow with datasets squared: no hint, AQE broadcasts them by the size they turn out to have
    step = F.coalesce(F.try_element_at("m", F.col("a")), F.lit(0)) / F.col("ta") - F.coalesce(F.try_element_at("m", F.col("b")), F.lit(0)) / F.col("tb")
    both = both.select("feature", "a", "b", "part", "value", step.alias("step"))
    before = both.groupBy("feature", "a", "b", "part").agg(F.sum("step").alias("s"))
    w = Window.partitionBy("feature", "a", "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("feature", "a", "b", "part", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("offset"))
    inner = Window.partitionBy("feature", "a", "b", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("run", F.sum("step").over(inner)).join(before, ["feature", "a", "b", "part"])
    return both.groupBy("a", "b", "feature").agg(F.max(F.abs(F.col("run") + F.col("offset"))).alias("distance"))


def proportion(df: DataFrame, columns: list[str], dataset: str = "dataset") -> DataFrame:
    means = unpivot(df, [dataset], columns).where("value is not null").groupBy("feature", dataset).agg(F.avg("value").alias("m"))
    a, b = means.alias("a"), means.alias("b")
    out = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col(f"a.{dataset}") < F.col(f"b.{dataset}")))
    return out.select(F.col(f"a.{dataset}").alias("a"), F.col(f"b.{dataset}").alias("b"), F.col("a.feature").alias("feature"), F.abs(F.col("a.m") - F.col("b.m")).alias("distance"))
