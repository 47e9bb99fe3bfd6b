"""Cleaning: missing values, duplicates, partitions by flag, imputation and scaling fitted on training folds only."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from plumbline.functions.quantiles import exact

MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "NULL", "<NA>")


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema])


def subset(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there; those that are not are warned of."""
    if gone := [c for c in wanted if c not in df.columns]:
        warnings.warn(f"no columns {gone}", stacklevel=2)
    return df.select(*[c for c in wanted if c in df.columns])


def numeric(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, NumericType)])


def distinct_first(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """The row of least id for each combination of columns, nulls equal."""
    rest = [c for c in df.columns if c not in columns]
    return df.groupBy(*columns).agg(F.min(F.struct(id_col, *[c for c in rest if c != id_col])).alias("_m")).select(*[F.col(f"_m.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def drop_missing(df: DataFrame, features: list[str]) -> DataFrame:
    return df.na.drop(subset=features)


def by_flag(df: DataFrame, flags: dict[str, str], name: str = "kind") -> DataFrame:
    """One row for each flag (column -> name) that is 1; the flags go. A row may come out several times or never."""
    hit = F.filter(F.array(*[F.when(F.expr(f"try_cast(`{c}` AS DOUBLE)") == 1, F.lit(v)) for c, v in flags.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(hit)).drop(*flags)


def pooled(frames: list[tuple[DataFrame, str]], name: str = "dataset") -> DataFrame:
    """Union by name with a dataset column; absent columns are null."""
    out = None
    for df, n in frames:
        df = df.withColumn(name, F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def others(df: DataFrame, held_out: str, name: str = "dataset") -> DataFrame:
    return df.where(F.col(name) != held_out)


def _mode(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v")))["v"].alias(f"_{c}"))


def fold_statistics(df: DataFrame, columns: list[str], strategy: str, folds: int, fold: str = "fold") -> DataFrame:
    """fold, _column: the fill value of each column over the rows that train for that fold (all others)."""
    others_of = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold)))
    rows = df.select(*columns, others_of.alias(fold))
    if strategy == "most_frequent":
        out = _mode(rows, [fold], columns[0])
        for c in columns[1:]:
            out = out.join(_mode(rows, [fold], c), fold)
        return out
    if strategy == "median":
        out = rows.select(fold).distinct()
        for c in columns:
            out = out.join(exact(rows, [fold], c, [0.5]).select(fold, F.col("q")[0].alias(f"_{c}")), fold, "left")
        return out
    return rows.groupBy(fold).agg(*[F.avg(c).alias(f"_{c}") for c in columns])


def imputed(df: DataFrame, columns: list[str], strategy: str, folds: int, fold: str = "fold") -> DataFrame:
    """df with the nulls of each row filled from the training rows of its fold. The joined table has `folds` rows."""
    fill = fold_statistics(df, columns, strategy, folds, fold)
    out = df.join(F.broadcast(fill), fold)
    return out.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def scaled(df: DataFrame, columns: list[str], folds: int, fold: str = "fold") -> DataFrame:
    """Standard scores from training rows; population deviation, 1 where that is 0."""
    others_of = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold)))
    stats = df.select(*columns, others_of.alias(fold)).groupBy(fold).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
    return df.join(F.broadcast(stats), fold).select(*[z(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def share_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return df.agg((100.0 * cells / F.nullif(F.count("*") * len(columns), F.lit(0))).alias("missing_pct"))
