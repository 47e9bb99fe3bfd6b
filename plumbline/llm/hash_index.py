"""Exact duplicates by an extendible-hash index on shared files, with built-in expressions only.

The key of a text is the 64-bit hash of its bytes.  A bucket holds the keys that begin with the same bits, as many as
its depth says; the directory has a slot for each prefix of the greatest depth, and several slots may name one bucket.

* Directory: keys are counted by prefix.  While a bucket is overfull (more distinct keys than its capacity) the
  directory doubles, and only the keys of overfull buckets are counted again, one bit further.  Copies are one key, so
  they never split a bucket; one with very many rows or bytes is dealt over pages instead (by a hash of the id).
* Owners: each text goes to the task that owns its bucket, which is a range of keys, and page.  Within it, texts of
  one key form a chain, and the bytes tell them apart: an entry for each distinct text, with the id that stays, the
  number of rows, and the text itself.  Entries of the pages of a bucket are few and are merged when read.
* The index is a folder of versions, each with its entries and its directory; the directory is written last, and its
  success mark commits the version.  `insert` gives the entries of the newest version and the new texts to the owners of
  the next one.

Texts are shuffled once.  What comes back to the rows is joined by key and sha256, which the bytes have shown to tell
the texts of each chain apart; both sides are shuffled for that join alone, so that Spark can split the key of a hot text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, written

#: Least number of keys that a bucket may hold, buckets from which on it may hold more, bytes of a page, and the
#: greatest depth at which slots (a dozen bytes each) go to every task.
CAPACITY, BUCKETS, PAGE, SHARED_DEPTH = 1024, 1 << 17, 128 << 20, 20


def _prefix(bits: str | int) -> F.Column:
    """The first bits of the key, of which there are 63 at most."""
    return F.expr(f"shiftrightunsigned(shiftrightunsigned(h, 1), cast(63 - {bits} as int))")


def _items(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def directory(keys: DataFrame, capacity: int | None = None) -> DataFrame:
    """(bucket, depth, prefix, n_keys, pages) from keys (h, n, bytes): distinct keys, with the rows and bytes of each."""
    total = keys.count()
    capacity = capacity or max(CAPACITY, total // BUCKETS)
    depth = max(0, int(math.log2(max(total, 1) / capacity)))  # fewer buckets than this cannot do
    rows, found = keys.withColumn("prefix", _prefix(depth)), None
    while True:
        counted = rows.groupBy("prefix").agg(F.count("*").alias("n_keys"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"))
        counted = written(counted.withColumn("depth", F.lit(depth)))
        full = counted.where((F.col("n_keys") > capacity) & (F.col("depth") < 63))
        done = counted.where((F.col("n_keys") <= capacity) | (F.col("depth") == 63))
        found = done if found is None else found.unionByName(done)
        if full.isEmpty():
            break
        split = full.select(F.col("prefix").alias("of"))
        rows = keys.withColumn("of", _prefix(depth)).join(split, "of", "left_semi").withColumn("prefix", _prefix(depth + 1))
        depth += 1
    pages = F.greatest(F.ceil(F.col("rows") / (2 * capacity)), F.ceil(F.col("bytes") / PAGE), F.lit(1))
    return found.select((F.expr("shiftleft(1L, depth)") + F.col("prefix")).alias("bucket"), "depth", "prefix", "n_keys", pages.cast("long").alias("pages"))


def _routed(items: DataFrame, buckets: DataFrame) -> DataFrame:
    """items with bucket, pages and page, by the slots of the directory."""
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    slots = buckets.select("bucket", "pages", F.explode(F.sequence(F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1"))).alias("slot"))
    slots = F.broadcast(slots) if depth <= SHARED_DEPTH else slots
    return items.withColumn("slot", _prefix(depth)).join(slots, "slot").withColumn("page", F.pmod(F.xxhash64("keep_id", "n"), F.col("pages"))).drop("slot")


def build(items: DataFrame, folder: str, capacity: int | None = None) -> DataFrame:
    """Writes the entries and the directory of items (keep_id, n, text, h) to a folder; the entries as `entries` gives them."""
    spark = items.sparkSession
    keys = written(items.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    buckets = written(directory(keys, capacity))
    owned = _routed(items, buckets).repartition("bucket", "page").groupBy("bucket", "page", "pages", "h", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    owned = owned.withColumn("sha", F.unhex(F.sha2("text", 256))).sortWithinPartitions("bucket", "h")
    owned.write.option("compression", "zstd").parquet(f"{folder}/entries")
    buckets.write.parquet(f"{folder}/directory")
    return entries(spark, folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, h, text, sha, keep_id, n) of a version: one for each distinct text, pages merged by key and bytes."""
    rows = spark.read.parquet(f"{folder}/entries")
    alone = rows.where("pages = 1").select("bucket", "h", "text", "sha", "keep_id", "n")
    paged = rows.where("pages > 1").groupBy("bucket", "h", "text").agg(F.first("sha").alias("sha"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return alone.unionByName(paged.select(*alone.columns))


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions of an index."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/directory/_SUCCESS")))


def _answers(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha"))
    short = written(found.select(F.col("h").alias("of"), F.col("sha").alias("sha0"), "keep_id", F.col("n").alias("group_size")))
    same = (rows.h == short.of) & (rows.sha == short.sha0)
    out = rows.join(short.hint("merge"), same)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def insert(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """Adds docs to the index at a shared folder and answers for them, as `copies` does, counting what the index held
    before.  Ids are larger in later batches if what came first is to go, smaller if it is to stay.

    Two writers of one version cannot both commit: the later one fails on the folder that exists."""
    spark, had = docs.sparkSession, versions(docs.sparkSession, root)
    items = _items(docs, id_col, text_col)
    if had:
        items = entries(spark, f"{root}/v{had[-1]}").select("keep_id", "n", "text", "h").unionByName(items)
    return _answers(docs, build(items, f"{root}/v{had[-1] + 1 if had else 1}", capacity), id_col, text_col)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs: of equal texts the largest id stays.

    Texts are equal if their bytes are; a null text counts as an empty one, and no text is shortened.  A null id is
    smaller than any other; rows alike in id and text are kept or dropped alike, and each counts in group_size.
    Further columns play no part, whatever their names; an empty table gives no rows.
    """
    return insert(docs, shared_folder(docs.sparkSession), id_col, text_col, capacity)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text stays under a larger id; all columns come back.  Rows alike in id and text stay alike."""
    new = "copies"
    while any(c.startswith(new) for c in docs.columns):
        new += "_"
    gone = copies(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(f"{new}id"), F.col("text_sha256").alias(f"{new}sha")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(gone, docs[id_col].eqNullSafe(gone[f"{new}id"]) & (F.sha2(text, 256) == gone[f"{new}sha"]), "left_anti")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
