"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import ann, bpe, compaction, hash_index, infill, jaccard, licenses, mixing, quality, rlz, secrets, suffix_index, trie
from plumbline.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op2_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.report(table(spark, sf_dir, "documents"))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.digest(table(spark, sf_dir, "documents"), 400)


def op7_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), size=4, threshold=85)


def op10_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.digest(table(spark, sf_dir, "documents"), 20)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rollup(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(table(spark, sf_dir, "documents"))


def op13_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_index.copies(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_bpe, op2_secret_field, op3_source_mix, op4_tiered_shards, op5_license_rules, op6_suffix_index, op7_adaptive_scan, op8_repetition, op9_jaccard_join, op10_relative_lz, op11_prefix_trie, op12_fill_in_middle, op13_hash_index)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mix": mixing.ORACLE, "op4_tiered_shards": compaction.ORACLE, "op5_license_rules": licenses.oracle(),
        "op11_prefix_trie": trie.ORACLE, "op12_fill_in_middle": infill.ORACLE, "op13_hash_index": hash_index.ORACLE,
    }
