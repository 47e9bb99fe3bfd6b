"""Exact quantiles without bringing all values of a key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far, as a share of the ranks, the brackets reach to either side; the accuracy of the sketch that places them; and
#: numbers of values below which a bracket holds them all.
MARGIN, ACCURACY, FEW = 0.001, 10_000, 5_000


def exact(df: DataFrame, keys: list[str], value: str, qs: list[float], name: str = "q") -> DataFrame:
    """keys, `name`: the quantiles of the values that are not null, linear between neighbours, as an array.

    A sketch brackets each quantile; values below a bracket are counted, those inside are counted by value, and only
    these, a five-hundredth of the ranks, are put in order.  `keys` have few values (features, entities, folds)."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = [max(q - MARGIN, 0.0) for q in qs] + [min(q + MARGIN, 1.0) for q in qs]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), ACCURACY).alias("_e"))
    at = [F.lit(q) * (F.col("_n") - 1) for q in qs]
    edge = lambda i, open_: F.when(F.col("_n") < FEW, F.lit(float(open_))).otherwise(F.col("_e")[i])
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), edge(i, "-inf").alias("lo"), edge(len(qs) + i, "inf").alias("hi"), F.floor(at[i]).alias("k"), (at[i] - F.floor(at[i])).alias("part")) for i in range(len(qs))])
    sketch = F.broadcast(sketch.select(*keys, "_n", brackets.alias("_b")))
    both = rows.join(sketch, keys) if keys else rows.crossJoin(sketch)
    both = both.select(*keys, "_v", "_n", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["hi"])).alias("b"))
    inside = F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_in")
    counts = both.groupBy(*keys, F.col("b.i").alias("i"), F.col("b.k").alias("k"), F.col("b.part").alias("part"), "_n", inside).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "i").orderBy(F.col("_in").asc_nulls_first()))
    counts = counts.withColumn("_upto", upto).where("_in is not null")
    reach = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_in")))
    found = counts.groupBy(*keys, "i", "part").agg(reach(F.col("k")).alias("a"), reach(F.least(F.col("k") + 1, F.col("_n") - 1)).alias("b"))
    found = found.select(*keys, "i", (F.col("a") + F.col("part") * (F.coalesce("b", "a") - F.col("a"))).alias("_x"))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "_x"))).alias("_all")).select(*keys, F.transform("_all", lambda x: x["_x"]).alias(name))
