"""Seeded stratified folds and hold-outs, by a hash of the row's id; the same row always gets the same fold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.windows import hashed_row_number


def key(seed: int | str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified(df: DataFrame, k: int, label: str, id_col: str, seed: int = 42, within: tuple[str, ...] = (), name: str = "fold") -> DataFrame:
    out = hashed_row_number(df, [*within, label], key(seed, id_col), [id_col], "_rn")
    return out.withColumn(name, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def holdout(df: DataFrame, size: float, label: str, id_col: str, seed: int = 42, name: str = "test") -> DataFrame:
    """Adds a flag for round(size * n) rows of each class."""
    n = df.groupBy(label).agg(F.round(F.count("*") * F.lit(size)).alias("_t"))
    out = hashed_row_number(df, [label], key(seed, id_col), [id_col], "_rn").join(F.broadcast(n), label)
    return out.withColumn(name, (F.col("_rn") <= F.col("_t")).cast("int")).drop("_rn", "_t")


def minority_needed(outer: int, inner: int) -> int:
    """Rows of the smaller class that nested cross-validation needs."""
    return max(outer, math.ceil(outer * inner / (outer - 1)))


def check(df: DataFrame, label: str, outer: int, inner: int) -> DataFrame:
    """rows, classes, minority, missing, needed, ok."""
    counts = df.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("y").alias("classes"), F.min(F.when(F.col("y").isNotNull(), F.col("n"))).alias("minority"), F.coalesce(F.sum(F.when(F.col("y").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    need = minority_needed(outer, inner)
    return seen.withColumn("needed", F.lit(need).cast("long")).withColumn("ok", (F.col("classes") >= 2) & (F.col("missing") == 0) & (F.col("minority") >= need))
