import hashlib
import zlib

import numpy as np
import pytest

from grovemill.llm import media_chunks
from grovemill.llm.media_chunks import GEAR, Filter, cuts, store_and_read, wav_header, write
from tests.llm.helpers import documents, empty


def slow_cuts(payload, least=256, most=8192, bits=10):
    out, start, h = [], 0, 0
    for i, b in enumerate(payload):
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF_FFFF
        n = i + 1 - start
        if n >= most or (n >= least and h >> (32 - bits) == 0):
            out.append(i + 1)
            start = i + 1
    return [*out, len(payload)] if start < len(payload) else out


def test_cuts_equal_a_rolling_hash():
    rng = np.random.default_rng(4)
    payloads = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 64, 255, 256, 257, 5000, 60_000)] + [bytes(30_000)]
    ends = np.cumsum([len(p) for p in payloads])
    found = cuts(np.frombuffer(b"".join(payloads), np.uint8), ends)
    for p, own, end in zip(payloads, found, ends.tolist(), strict=True):
        assert [x - (end - len(p)) for x in own] == slow_cuts(p)


def test_an_insertion_moves_few_cuts():
    rng = np.random.default_rng(5)
    a = bytes(rng.integers(0, 256, 100_000, dtype=np.uint8))
    b = a[:50_000] + b"inserted" + a[50_000:]
    parts = lambda p: {p[s:e] for s, e in zip([0, *slow_cuts(p)], slow_cuts(p), strict=False)}
    assert len(parts(b) - parts(a)) <= 3


def want(row):
    raw = (row[1] or "").encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    media = wav_header(len(payload)) + payload
    crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:], strict=False))
    feature = f"{len(payload)}:{sum(payload)}:{sum(b * b for b in payload)}:{crossings}"
    return (row[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def test_round_trip_and_every_chunk_once(spark, tmp_path):
    df, rows = documents(spark, 80)
    rng = np.random.default_rng(9)
    base = [bytes(rng.integers(97, 123, 5000, dtype=np.uint8)).decode() for _ in range(3)]
    rows = [*rows, *((500 + i, base[i % 3][: 3000 + 7 * i] + base[(i + 1) % 3] + base[2] * 2, "en", "b", 1, 1, 2, "x") for i in range(12))]
    df = spark.createDataFrame(rows, df.schema)
    store = f"file://{tmp_path}/store"
    out = store_and_read(df, store).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(want, rows), key=str)
    recipes, chunks = spark.read.parquet(f"{store}/recipes").collect(), spark.read.parquet(f"{store}/chunks").collect()
    apart = {c.digest for c in chunks}
    assert len(apart) == len(chunks)
    once = [r.digests[32 * k : 32 * k + 32] for r in recipes for k, s in enumerate(r.shared) if not s]
    assert len(once) == len(set(once)) and not apart & set(once)


def test_a_saturated_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(media_chunks, "FILTER_BITS", (64, 64))
    df, rows = documents(spark, 40)
    assert sorted(map(tuple, store_and_read(df).collect()), key=str) == sorted(map(want, rows), key=str)


def test_damage_is_found(spark, tmp_path):
    df, _ = documents(spark, 30)
    store = write(df, f"file://{tmp_path}/store")
    bad = store.recipes().selectExpr("doc_id", "media_id", "n_bytes", "cast('x' as binary) as header", "digests", "sizes", "shared", "own", "mixed")
    store.recipes = lambda: bad
    with pytest.raises(Exception, match="damaged"):
        store.read(lambda h, p: (len(p),), "n bigint").collect()


def test_filter_has_no_false_negatives():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(2000)]
    f = Filter(1 << 16)
    at = f.probes(digests[:1000])
    np.bitwise_or.at(f.words, at.ravel() >> 6, np.uint64(1) << (at.ravel() & 63).astype(np.uint64))
    assert f(digests[:1000]).all() and f(digests[1000:]).mean() < 0.05


def test_empty(spark):
    assert store_and_read(empty(spark)).collect() == []
