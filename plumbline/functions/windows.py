"""Row numbers and running sums over a whole key, without bringing a key into one task.

Rows are put into buckets that follow the order; inside a bucket a window does, and what lies before a bucket
comes from a table with a row for each key and bucket, joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_row_number(df: DataFrame, keys: list[str], hashed: Column, tie: list[str], name: str = "rn") -> DataFrame:
    """1, 2, ... within keys by a hex hash and then tie columns; buckets are the first three digits."""
    df = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, 3))
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_b").orderBy("_h", *tie)
    return df.withColumn(name, F.row_number().over(inner)).join(sizes, [*keys, "_b"]).withColumn(name, F.col(name) + F.col("_o")).drop("_h", "_b", "_o")


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], descending: bool = False, parts: int = 64) -> DataFrame:
    """Adds, for each of `sums` (new name -> column), the sum over the rows of the key up to this one in the order.

    `order` is a number, distinct within the key; buckets are ranges of it that hold about as many rows each.  The rows and
    the sums before them are bucketed apart, so cuts may not depend on the order in which partial results meet."""
    cols = df.columns
    df = df.join(sampled_cuts(df, keys, order, parts), keys).withColumn("_b", range_bucket(F.col(order), F.col("_cuts"), parts.bit_length())).drop("_cuts")
    sign = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    per = df.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(sign(F.col("_b"))).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inner = Window.partitionBy(*keys, "_b").orderBy(sign(F.col(order))).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("*", *[F.sum(c).over(inner).alias(f"_i_{n}") for n, c in sums.items()]).join(per, [*keys, "_b"])
    return out.select(*cols, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def range_cuts(df: DataFrame, keys: list[str], value: str, parts: int = 64, accuracy: int = 10_000) -> DataFrame:
    """keys, _cuts: the values that cut each key's rows into about `parts` ranges of equal size, from a sketch; a row for each key."""
    at = [(k + 1) / parts for k in range(parts - 1)]
    return df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, F.array(*map(F.lit, at)), accuracy)).alias("_cuts"))


def sampled_cuts(df: DataFrame, keys: list[str], value: str, parts: int = 64, sampled: int = 64) -> DataFrame:
    """As `range_cuts`, of values distinct within the key and the same however often it is worked out: cuts come from the value of
    least hash in each of parts x `sampled` classes of hashes."""
    h = F.xxhash64(value)
    drawn = df.where(F.col(value).isNotNull()).groupBy(*keys, F.pmod(h, F.lit(parts * sampled)).alias("_c")).agg(F.min_by(value, h).alias("_v"))
    ordered = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    at = lambda k: F.get("_s", F.floor(F.size("_s") * (k + 1) / parts).cast("int"))
    return ordered.select(*keys, F.array_distinct(F.array(*[at(k) for k in range(parts - 1)])).alias("_cuts"))


def range_bucket(value: Column, cuts: Column, levels: int = 16) -> Column:
    """The number of cuts below a value, by halving: a step for each level, up to 2^levels - 1 cuts."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])
    return F.aggregate(steps, F.lit(0), lambda below, step: F.when(F.get(cuts, below + step - 1) < value, below + step).otherwise(below))
