"""From raw documents to token ids, in five stages, each a pass of one operator over all that the last one kept.

A null or empty text fails the quality rules, a null source is a source of its own, repeated rows fall to the
near-duplicate stage; further columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, jaccard, mixing, quality, secrets
from plumbline.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; very long texts are measured whole, columns stay as they are."""
    return quality.keep(docs)


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of rows alike in doc_id and text the one with the least other columns; an aggregation, so repeats meet in their task first."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not others:
        return docs.distinct()
    row = F.struct(*others)
    maps = any("map<" in docs.schema[c].dataType.simpleString() or docs.schema[c].dataType.simpleString() == "variant" for c in others)
    least = F.min_by(row, F.to_json(row)) if maps else F.min(row)
    return docs.groupBy("doc_id", "text").agg(least.alias("_row")).select("doc_id", "text", "_row.*").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one with the least id stays (of several
    texts under that id, the one of least hash).  Documents go by id and text, so another text under the same id, or under
    a null one, is judged by itself; of rows alike in both the one stays whose other columns are least, in their order (null
    before others; columns without an order by their JSON)."""
    classes = jaccard.classes(docs, size=5, threshold=80)
    gone = classes.where("not is_first").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return _one_of_each(docs.join(gone, same, "left_anti"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by <secret>; n_chars follows the text.  No row goes, null texts and other columns stay."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it; its columns stay, repeated rows are taken alike."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of the decoded text; a null text has no tokens, repeated rows
    give repeated results, other columns end here."""
    return bpe.encoded(docs, ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", tokens),
]
#: The shingle join, the trained field and the merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
