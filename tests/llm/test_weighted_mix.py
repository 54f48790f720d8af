import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from grovemill.llm import common, weighted_mix
from grovemill.llm.weighted_mix import SQL, key_range, mix, mixed_documents
from tests.llm.helpers import documents, empty


def slow_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * size[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize(("steps", "rows"), [(1, 1), (1, 512), (4096, 512)])
def test_against_the_contract(spark, monkeypatch, steps, rows):
    monkeypatch.setattr(weighted_mix, "STEPS", steps)
    monkeypatch.setattr(common, "HOT_ROWS", rows)
    df, own = documents(spark, 120)
    rows = own
    out = mix(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r[3]] += words(r[1])
    target = slow_targets(size)
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[3], words(r[1])) for r in rows)
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, out)) == sorted(map(str, mix(df).collect()))


@pytest.mark.parametrize("hot", [1, 512])
def test_sql_twin(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    df, rows = documents(spark, 120)
    rows = [*rows, *((None, f"{'word ' * (i % 4)}", "en", "b", 1, 1, 2, "x") for i in range(30))]
    df = spark.createDataFrame(rows, df.schema)
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    got = con.sql(f"select doc_id, size, source_size, target, taken from ({SQL})").fetchall()
    assert sorted(map(str, got)) == sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in mix(df).collect())


def test_heavier_weights_are_drawn_more(spark):
    df = spark.createDataFrame([(i, "word", f"s{i % 2}", i % 4 < 2) for i in range(4000)], "doc_id bigint, text string, source string, heavy boolean")
    out = mix(df, weight=F.when(F.col("heavy"), 1.0).otherwise(0.25), whole=True).where("source = 's1'").groupBy("row.heavy").agg(F.sum("taken").alias("n")).collect()
    n = {r.heavy: r.n for r in out}
    assert n[True] > 1.5 * n[False] > 0


def test_rows_of_the_mix(spark):
    df, rows = documents(spark, 60)
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert set(map(str, out.collect())) <= {str(r) for r in df.collect()}
    assert mixed_documents(empty(spark)).collect() == [] and mix(empty(spark)).collect() == []


def test_ranges_are_narrow_whatever_the_weights(spark):
    for weight in (1.0, 0.1, 1e-6):
        key = -F.log(F.rand(1)) / weight
        got = spark.range(40_000).select(key.alias("k")).select("k", key_range(F.col("k")).alias("r"))
        assert got.groupBy("r").count().agg(F.max("count")).first()[0] < 60
        rows = got.orderBy("k").collect()
        assert all(a.r <= b.r for a, b in zip(rows, rows[1:], strict=False))
