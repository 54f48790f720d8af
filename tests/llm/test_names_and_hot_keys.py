"""Columns with the names that the operators use themselves, and keys that hold most rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovemill.llm import common, media_chunks, nnls_packing, rule_trees, secret_ledger, separator_scan, simhash_tiles, weighted_mix, zstd_quality
from grovemill.llm.common import join_hot, prefix_sums
from tests.llm.helpers import documents
from tests.llm.test_secret_ledger import SECRETS
from tests.llm.test_zstd_quality import labelled

NAMES = (
    "name has range before times epochs size target taken key begins source_size time row nth spans blob path at lost hash fp root body first missing score predicted good_bytes bad_bytes "
    "own_text own_0 own_2 c0 c1 c2 n m x y a b v u least component_id held_out hit gap one salt bin rank place sequence_id start length ids_crc32 doc_tokens media_id digest data turn stop "
    "part_ parts_ cut_ range_ times_ spans_ blob_ name_ row_ id_ begin_before sum_before exact_key exact_size quality weight cap level capped total a.b a(b"
).split()


def clashing(spark, df):
    """df with a column of each name, whose value tells the name, and one of a map."""
    own = [F.lit(f"{n} of the caller").alias(n) for n in NAMES]
    return df.select("doc_id", "text", "lang", "source", "n_chars", *own, F.create_map(F.lit("k"), F.col("n_chars")).alias("map"))


def shown(df):
    return Counter(str(r) for r in df.collect())


@pytest.fixture
def tables(spark):
    df, rows, labels = labelled(spark, 60)
    rows = [*rows, *((5000 + i, s + " plain words around", "en", "src1", 3, 1, 2, "x") for i, s in enumerate(SECRETS))]
    return spark.createDataFrame(rows, df.schema), labels


def test_stages_give_back_every_column(spark, tables):
    df, labels = tables
    plain, wide = df.select("doc_id", "text", "lang", "source", "n_chars"), clashing(spark, df)
    for stage in (lambda d: zstd_quality.good_documents(d, labels), simhash_tiles.one_of_each, secret_ledger.redacted_documents, weighted_mix.mixed_documents):
        out = stage(wide)
        assert out.columns == wide.columns
        assert shown(out.select(plain.columns)) == shown(stage(plain))
        for r in out.collect():
            assert all(r[n] == f"{n} of the caller" for n in NAMES) and r["map"].keys() == {"k"}


def test_queries_ignore_other_columns(spark, tables):
    df, labels = tables
    plain, wide = df.select("doc_id", "text", "source"), clashing(spark, df)
    for own in (secret_ledger.report, weighted_mix.mix, simhash_tiles.near_duplicates, nnls_packing.pack, media_chunks.store_and_read, lambda d: rule_trees.judge(d, labels), lambda d: zstd_quality.score_documents(d, labels), lambda d: separator_scan.count_tokens(d).select("doc_id", "n_tokens")):
        assert shown(own(wide)) == shown(own(plain))


def sizes_of_tasks(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_one_key_with_most_rows_is_spread(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(40_000).selectExpr("if(id < 30000, 0, id) as k", "id")
        few = many.select("k").distinct().selectExpr("k", "k + 1 as v")
        out = join_hot(many, few, ["k"], many.groupBy("k").agg(F.count("*").alias("n")))
        assert out.count() == 40_000 and out.where("v = k + 1").count() == 40_000
        tasks = sizes_of_tasks(out)
        assert len(tasks) == 4 and tasks[-1] < 2 * tasks[0]

        rows = many.selectExpr("'s' as s", "k % 7 as g", "k", "id", "1L as one", "k as big")
        out = prefix_sums(rows, ["s"], "g", {"k": F.col("k")}, {"nth": "one", "sum": "big"}, [F.col("k")], "id")
        assert [r.nth for r in out.orderBy("nth").select("nth").collect()] == list(range(40_000))
        want = {r.g: r.b for r in rows.groupBy("g").agg(F.sum("big").alias("b")).collect()}
        last = out.groupBy("g").agg(F.max(F.col("sum") + F.col("big")).alias("e")).orderBy("g").collect()
        assert [r.e for r in last] == [sum(want[g] for g in range(k + 1)) for k in range(7)]
        tasks = sizes_of_tasks(out)
        assert tasks[-1] < 3 * tasks[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_and_equal_identifiers(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    df, _ = documents(spark, 20)
    same = spark.createDataFrame([(i if i % 3 else None, SECRETS[2], "en", "src0", 1, 1, 2, "x") for i in range(300)], df.schema)
    df = df.unionByName(same)
    found = simhash_tiles.near_duplicates(df).where("fingerprint is not null").groupBy("component_id").count().collect()
    assert sum(r["count"] for r in found) == df.count() and max(r["count"] for r in found) >= 300
    clean = secret_ledger.redacted_documents(df)
    assert clean.count() == df.count() and clean.where("text like '%[access removed]%'").count() == 300
    out = weighted_mix.mix(df).where("source = 'src0'").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).first()
    assert abs(out.t - out.g) <= 1


def test_scratch_needs_a_shared_folder_on_clusters(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch(Cluster)
    with common.swept(spark) as keep:
        gone = common.scratch(spark)
        spark.range(3).write.parquet(gone)
        kept, path = keep(spark.read.parquet(gone))
    assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone)
    common.discard(spark, path)
