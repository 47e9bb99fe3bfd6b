"""Connected components of an edge table, by alternating large and small stars; no step gathers a component in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, written


def _mins(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m): m the least of u and all its neighbours; and the written table of (u, m).  Reduced before the shuffle;
    written, for Spark splits the join back of a node with very many neighbours only if both sides are shuffled for it."""
    low = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return edges.join(low, "u"), low


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): each node that has an edge to another, and the least node reachable from it."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, low = _mins(both)
        large = written(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        discard(e, low)
        small, low = _mins(large)
        e = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        discard(large, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(roots.select("v", F.col("v").alias("label")))
