"""From raw documents to packed sequences: five operators, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grovemill.llm import nnls_packing, secret_ledger, simhash_tiles, weighted_mix, zstd_quality
from grovemill.llm.common import discard, swept, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return zstd_quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: that with the smallest id."""
    return simhash_tiles.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return secret_ledger.redacted_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return weighted_mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences."""
    return nnls_packing.pack(docs)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("secret scans", secrets), ("mixing to target weights", mixing), ("packing", packing)]

#: Fingerprints, compression and tokens are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents: the pieces of the last one.

    Each stage's rows are written and read back for the next one; what a stage wrote on its way, and the rows before it, are
    deleted then. Columns of documents may have any name and type; null, empty, very long and repeated texts are defined by
    the operators; an empty table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with swept(spark) as keep:
            docs, path = keep(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
