import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grovemill.llm import common
from grovemill.llm.simhash_tiles import components, fingerprint_array, links, masks, near_duplicates
from tests.llm.helpers import documents, empty


def slow(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, radius=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("hot", [1, 512])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    df, rows = documents(spark, 80)
    fp = [slow(r[1]) for r in rows]
    assert fingerprint_array([r[1] or "" for r in rows]).tolist() == fp
    of = roots(fp)
    least = {}
    for r, f in zip(rows, fp, strict=True):
        if r[0] is not None:
            least[of[f]] = min(r[0], least.get(of[f], r[0]))
    want = sorted([(r[0], f"{f:016x}", least.get(of[f])) for r, f in zip(rows, fp, strict=True)], key=str)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == want


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_of_clustered_fingerprints(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 12)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(25):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                b ^= 1 << int(bit)
            values.add(b)
    signed = np.array(sorted(values), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "fp bigint")
    got = {r.v: r.root for r in components(links(df, len(values), tile=tile)).collect()}
    groups, want = {}, {}
    for v, s in zip(sorted(values), signed.tolist(), strict=True):
        groups.setdefault(got.get(s, s), set()).add(v)
    for v, r in roots(values).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_a_component_of_thousands_of_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    hub = spark.range(1, 3001).selectExpr("0L as a", "id as b")
    chain = spark.range(5000, 5400).selectExpr("id as a", "id + 1 as b")
    got = components(hub.unionByName(chain).unionByName(spark.range(10_000, 12_000).selectExpr("id as a", "13000L as b")))
    assert {(r.root, r.n) for r in got.groupBy("root").agg(F.count("*").alias("n")).collect()} == {(0, 3000), (5000, 400), (10_000, 2000)}


def test_every_choice_of_blocks_covers_the_radius():
    rng = np.random.default_rng(1)
    for agree in (1, 2, 3):
        every = masks(4, agree)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flips & m for m in every)


def test_empty(spark):
    assert near_duplicates(empty(spark)).collect() == []
