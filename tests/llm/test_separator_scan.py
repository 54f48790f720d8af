import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from grovemill.llm import separator_scan
from grovemill.llm.separator_scan import count_tokens, scan, write_shards
from tests.llm.helpers import documents, empty


def blocks(spark, shards, size, end=7):
    rows = []
    for s, tokens in enumerate(shards):
        rows += [(s, b, bytearray(np.array(tokens[i : i + size], "<u2").tobytes()), []) for b, i in enumerate(range(0, len(tokens), size))]
    return spark.createDataFrame(rows, "shard int, block int, tokens binary, ended array<bigint>")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_stitching(spark, size):
    rng = np.random.default_rng(size)
    shards = [[7], [1, 2, 3], [7, 7, 1], [1, 7], [1] * 40 + [7], *(rng.integers(5, 9, n).tolist() for n in (10, 33, 64))]
    want = []
    for s, tokens in enumerate(shards):
        start = nth = 0
        for i, t in enumerate(tokens):
            if t == 7:
                want.append((s, nth, start, i - start, True))
                start, nth = i + 1, nth + 1
        if start < len(tokens):
            want.append((s, nth, start, len(tokens) - start, False))
    got = [(r.shard, r.ordinal, r.start, r.n_tokens, r.terminated) for r in scan(blocks(spark, shards, size), end=7).collect()]
    assert sorted(got) == want


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_documents(spark, block):
    from tokenizers import Tokenizer

    from grovemill.llm.tokens import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    df, rows = documents(spark, 50)
    rows = [*rows, (700, "a <|endoftext|> b", "en", "b", 1, 1, 2, "x")]
    out = count_tokens(spark.createDataFrame(rows, df.schema), block=block).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=str) == sorted(((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)


def test_the_files_hold_the_tokens(spark):
    df, rows = documents(spark, 20)
    files = {}
    for r in write_shards(df, block=64).orderBy("shard", "block").collect():
        files.setdefault(r.shard, []).append(np.frombuffer(r.tokens, "<u2"))
    assert sum((np.concatenate(f) == 49_407).sum() for f in files.values()) == len(rows)


def test_empty(spark):
    assert count_tokens(empty(spark)).collect() == []


def test_a_long_shard_is_written_and_read_in_parts(spark, monkeypatch):
    most, block, seen = 16 << 10, 1 << 10, []
    monkeypatch.setattr(separator_scan, "CHUNK", most, raising=False)
    df = spark.range(0, 400, 1, 1).selectExpr("id doc_id", "repeat(concat('w', id, ' some words 1 2 3 '), 20) text")
    blocks = write_shards(df, block=block)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in blocks.inputFiles()]
    sizes = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(sizes) > 4 * most and max(sizes) < 2 * most

    def probe(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, b.column(2).to_pylist()))], pa.int64())], ["n"])

    def watched(found, *args):
        seen.extend(r.n for r in blocks.select("shard", "block", "tokens").mapInArrow(probe, "n bigint").collect())
        return materialize(found, *args)

    materialize, before = separator_scan.materialize, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    monkeypatch.setattr(separator_scan, "materialize", watched)
    assert scan(blocks).where("terminated").count() == 400
    assert sum(seen) > 4 * most and max(seen) < 2 * most
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
