"""Mixing sources to target weights.

Sizes (words) are summed per source; sources in code point order, null last, get the weights in turn.
A budget of `percent` of all words is shared by weight, no source above `most` times its size, the excess
shared anew by weight.  The fixpoint has one water level: target = min(most * size, level * weight), and the
level is the largest that any number of capped sources gives, so two running sums over the sources find it.

Each document is then taken floor(rate) times, and once more with probability equal to the fraction, as a Bernoulli
variable that a hash decides.  The draws of a source are systematic, so that sources of few or very uneven
documents come near their targets too: its documents are put in order of size (then of a hash of their id), and the one
at place i gets the extra copy if a whole number lies in (u + (i - 1) * fraction, u + i * fraction], where u in [0, 1) is
a hash of the seed and the source.  Over seeds each document has exactly that probability; neighbours in size
share copies evenly, so the words of a source miss its target by less than its largest document has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import hashed_row_number
from plumbline.llm.common import written

WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2


def _uniform(name: F.Column) -> F.Column:
    """A number in [0, 1) from 8 hex digits of an md5, alike in other SQL engines."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size); a source without words has target 0."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by_need = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    capped, used = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    everything = Window.partitionBy()
    total, all_w = F.sum("source_size").over(everything), F.sum("w").over(everything)
    per = per.withColumn("level", (total * percent / F.lit(100.0) - capped * F.lit(float(most))) / (all_w - used))
    level = F.max("level").over(everything)
    return per.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(most)), level * F.col("w")).alias("target"))


def units(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(doc_id, th, source, size, rows, source_size, target, n) for each document, rows alike in id, source and text being
    one: th the hash of the text, `rows` how many there are, n the times each of them is taken."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("source"), size.alias("size"))
    sized = written(sized.groupBy("doc_id", "th", "source", "size").agg(F.count("*").alias("rows")))
    goal = targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, percent, most).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    goal = written(goal.withColumn("rate", rate))
    # places: within a source and size by hash, in buckets; sizes before that from a table with a row for each
    keyed = sized.withColumn("none", F.col("source").isNull()).withColumn("from", F.coalesce("source", F.lit(""))).withColumn("unit", F.col("size") * F.col("rows"))
    keys = ["none", "from", "unit"]
    placed = hashed_row_number(keyed, keys, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), ["th"], "at")
    before = Window.partitionBy("none", "from").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*keys).agg(F.count("*").alias("many")).withColumn("smaller", F.coalesce(F.sum("many").over(before), F.lit(0))).drop("many")
    placed = placed.join(written(offsets).hint("merge"), keys).withColumn("at", F.col("at") + F.col("smaller"))
    rows = placed.join(goal, placed.source.eqNullSafe(goal.of)).drop("of")
    u = _uniform(F.concat(F.lit(f"{seed}|"), F.when(F.col("none"), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("from")))))
    part = F.col("rate") - F.floor("rate")
    extra = F.floor(u + part * F.col("at")) - F.floor(u + part * (F.col("at") - 1))
    return rows.select("doc_id", "th", "source", "size", "rows", "source_size", "target", (F.floor("rate") + extra).cast("long").alias("n"))


def copies(docs: DataFrame, **named) -> DataFrame:
    """(doc_id, th, size, source, source_size, target, n) with th the hash of the text and n the times the document is
    taken, for each row of docs; further arguments as in `units`.

    A null text has size 0, an empty one too; a null source is a source of its own; rows alike in id, source and text
    are taken alike.  Text length and further columns play no part; an empty table gives no rows.
    """
    rows = units(docs, **named).withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return rows.select("doc_id", "th", "size", "source", "source_size", "target", "n")


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs; cases as in `copies`."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def deviations(docs: DataFrame) -> DataFrame:
    """(source, source_size, target, taken) for each source: how near the mix comes."""
    return units(docs).groupBy("source", "source_size", "target").agg(F.sum(F.col("size") * F.col("rows") * F.col("n")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as many times as the mix takes it; a row is known by its id, source and text.

    Rows of size 0 are taken as often as others of their source.  All columns come back as they are, whatever their
    names."""
    new, old = "copies", set(docs.columns)
    while any(c.startswith(new) for c in old):
        new += "_"
    n = units(docs).where("n > 0")
    n = n.select(F.col("doc_id").alias(f"{new}id"), F.col("source").alias(f"{new}source"), F.col("th").alias(f"{new}th"), F.col("n").cast("int").alias(f"{new}n"))
    same = docs["doc_id"].eqNullSafe(n[f"{new}id"]) & docs["source"].eqNullSafe(n[f"{new}source"]) & (F.xxhash64(docs["text"]) == n[f"{new}th"])
    return docs.join(n, same).withColumn(f"{new}k", F.explode(F.sequence(F.lit(1), F.col(f"{new}n")))).select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w FROM per),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150e0 / 100e0 - coalesce(sum(source_size) OVER before, 0)::DOUBLE * 2e0) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0e0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(source_size * 2e0, (max(level) OVER ()) * w) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2e0) ELSE 0e0 END AS rate,
  ('0x' || substr(md5('mix|' || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END), 1, 8))::BIGINT / 4294967296e0 AS u FROM goal),
alike AS (SELECT doc_id, source, text, size, count(*) AS n_rows FROM sized GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size * n_rows, md5('mix:' || coalesce(doc_id::VARCHAR, '')), md5(text)) AS i FROM alike),
drawn AS (SELECT p.*, r.source_size, r.target, floor(rate) + floor(u + (rate - floor(rate)) * i) - floor(u + (rate - floor(rate)) * (i - 1)) AS n FROM placed p JOIN rated r ON p.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken FROM (SELECT *, unnest(range(0, n_rows)) FROM drawn)
"""
