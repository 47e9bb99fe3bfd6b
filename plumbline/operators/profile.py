"""Feature profiles, correlations, class balance and compatibility of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.quantiles import exact


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, value (double): a narrow explode."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.feature", "c.value")


def continuous(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, counts, moments, ends and exact quartiles."""
    cells = unpivot(df, [], columns)
    out = cells.groupBy("feature").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).cast("long").alias("n_null"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return out.join(exact(cells, ["feature"], "value", [0.25, 0.5, 0.75]), "feature", "left").select("feature", "n", "n_null", "mean", "std", "least", "most", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n_unique, top (the least of the most frequent values), top_count."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("c")).select("c.*").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    return counts.groupBy("feature").agg(F.count("*").alias("n_unique"), best.alias("b")).select("feature", "n_unique", F.col("b.value").alias("top"), (-F.col("b.m")).alias("top_count"))


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    out = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return unpivot(out, [], columns).where("value is not null").select("feature", F.col("value").alias("corr"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b (a before b in `columns`), corr: every pair in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return out.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def balance(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """keys, y, n, share."""
    counts = df.groupBy(*keys, F.col(target).alias("y")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def imbalance(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """keys, n, n_missing (rows without a class), majority, minority, ratio of both."""
    counts = balance(df, keys, target)
    known = F.col("y").isNotNull()
    big, small = F.max(F.when(known, F.col("n"))), F.min(F.when(known, F.col("n")))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"), big.alias("majority"), small.alias("minority"))
    return out.withColumn("ratio", F.col("majority") / F.col("minority"))


def length_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, n, mean, median (exact), std, least, most of a length; give one type's rows for it across datasets."""
    v = F.col(column).cast("double")
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    return out.join(exact(df, keys, column, [0.5]), keys, "left").select(*keys, "n", "mean", F.col("q")[0].alias("median"), "std", "least", "most")


def columns_report(df: DataFrame) -> DataFrame:
    """column, type, n_null, null_pct of every column, in one aggregation."""
    n = F.count("*")
    one = df.agg(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(F.col(f"`{f.name}`").isNull()).cast("long").alias("n_null"), F.coalesce(100.0 * F.try_divide(F.count_if(F.col(f"`{f.name}`").isNull()), n), F.lit(0.0)).alias("null_pct")) for f in df.schema]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


def support(df: DataFrame, rules: list[str]) -> DataFrame:
    """rule, n, pct: how many rows each 0/1 rule supports, of all."""
    n = F.count("*")
    one = df.agg(F.array(*[F.struct(F.lit(r).alias("rule"), F.count_if(F.col(r) == 1).cast("long").alias("n"), F.coalesce(100.0 * F.try_divide(F.count_if(F.col(r) == 1), n), F.lit(0.0)).alias("pct")) for r in rules]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


def common_features(first: list[str], others: list[list[str]], target: str) -> list[str]:
    """The features of the first table that all others have, in its order."""
    return [c for c in first if c != target and all(c in o for o in others)]


def verdict(df: DataFrame, target: str, least: int = 10, missing: float = 50.0) -> DataFrame:
    """level (error, warning), finding: what is wrong with a table; no rows if nothing is."""
    spark = df.sparkSession
    if target not in df.columns:
        return spark.createDataFrame([("error", f"no column {target}")], "level string, finding string")
    cells = [c for c in df.columns if c != target]
    share = 100.0 * sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cells), F.lit(0)) / F.nullif(F.count("*") * len(cells), F.lit(0))
    classes = df.groupBy(F.col(target).alias("y")).agg(F.count("*").alias("n"))
    seen = classes.agg(F.count("y").alias("k"), F.coalesce(F.min(F.when(F.col("y").isNotNull(), F.col("n"))), F.lit(0)).alias("minority"), F.coalesce(F.sum(F.when(F.col("y").isNull(), F.col("n"))), F.lit(0)).alias("gone"))
    seen = seen.crossJoin(df.agg(F.coalesce(share, F.lit(0.0)).alias("missing"), F.count("*").alias("rows")))  # one row each
    checks = [
        ("error", F.col("rows") == 0, F.lit("no rows")), ("error", (F.col("rows") > 0) & (F.col("k") != 2), F.concat(F.col("k"), F.lit(" classes, not 2"))), ("error", F.col("gone") > 0, F.concat(F.col("gone"), F.lit(" rows without a label"))),
        ("warning", (F.col("k") == 2) & (F.col("minority") < least), F.concat(F.col("minority"), F.lit(" rows of the smaller class"))), ("warning", F.col("missing") > missing, F.concat(F.round("missing", 1), F.lit("% of cells missing"))),
    ]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(level).alias("level"), text.alias("finding"))) for level, hit, text in checks]))
    return seen.select(F.explode(found).alias("f")).select("f.*")


def compatibility(df: DataFrame, features: dict[str, list[str]], target: str, least: int = 5, dataset: str = "dataset") -> DataFrame:
    """dataset, classes, n_features, n_common, ok: equal sorted classes and enough common features."""
    common = len(set.intersection(*map(set, features.values())))
    counts = F.create_map(*[F.lit(x) for k, v in features.items() for x in (k, len(v))])
    per = df.groupBy(dataset).agg(F.array_join(F.array_sort(F.collect_set(F.col(target).cast("string"))), ",").alias("classes"))
    same = F.size(F.collect_set("classes").over(Window.partitionBy())) == 1
    return per.select(dataset, "classes", F.element_at(counts, F.col(dataset)).cast("long").alias("n_features"), F.lit(common).cast("long").alias("n_common"), (same & F.lit(common >= least)).alias("ok"))


def class_priors(df: DataFrame, target: str, dataset: str = "dataset") -> DataFrame:
    y = F.col(target)
    return df.groupBy(dataset).agg(F.count(y).alias("n"), F.count_if(y == 1).cast("long").alias("n_pos"), F.count_if(y == 0).cast("long").alias("n_neg"), F.avg(y.cast("double")).alias("positive_rate"))
