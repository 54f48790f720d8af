"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovemill.llm import media_chunks, nnls_packing, perspectives, rule_trees, secret_ledger, separator_scan, simhash_tiles, warc_segments, weighted_mix, zstd_quality
from grovemill.llm.common import table


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.store_and_read(table(spark, sf_dir, "documents"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report(table(spark, sf_dir, "documents"))


def op3_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_segments.archive_and_read(table(spark, sf_dir, "pages"))


def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_mix.mix(table(spark, sf_dir, "documents")).drop("source")


def op7_rule_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_trees.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.count_tokens(table(spark, sf_dir, "documents"))


def op9_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_media_chunks, op2_secret_ledger, op3_zstd_quality, op4_perspectives, op5_warc_segments, op6_weighted_mix, op7_rule_trees, op8_separator_scan, op9_simhash_tiles, op10_nnls_packing)
    }


def oracle_sql() -> dict[str, str]:
    """What DuckDB can express; the others are held against brute force in tests/llm."""
    return {"op2_secret_ledger": secret_ledger.SQL, "op4_perspectives": perspectives.SQL, "op5_warc_segments": warc_segments.SQL, "op6_weighted_mix": weighted_mix.SQL}
