"""Token counts of flat token files without an index.

A shard is a run of token ids, each document followed by the end-of-document id, cut into blocks wherever the block size
falls. The scan finds the ids' positions in each block with one vectorised comparison. What a block can't know, where its
first document began and how many came before, is stitched by prefix scans over one row per block: sums of lengths and
counts, and the running maximum of the last separator's position. No document, and no shard, is held in one task: blocks
are written in row groups, and read in batches, of about CHUNK bytes, however many a shard has.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemill.llm.common import materialize, slices
from grovemill.llm.tokens import default_vocabulary, shared_encoder

#: Token ids of a block (two bytes each), and the id that ends a document.
BLOCK, END = 1 << 18, 49_407
#: Bytes of blocks in a row group, and in a batch that a scan gets at a time. By default they are 128 MB and 64 MB, in several
#: copies in a task that writes or reads.
CHUNK = 8 << 20
#: What bounds a batch's bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

BLOCKS = "shard int, block int, tokens binary, ended array<bigint>"


def groups() -> dict[str, int]:
    """The Parquet writer's options for row groups of CHUNK. It looks at sizes only each 100 rows if not told otherwise."""
    return {"parquet.block.size": CHUNK, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """A scope in which what is run gets batches of CHUNK."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, CHUNK)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def write_shards(documents: DataFrame, path: str | None = None, vocabulary: str | None = None, block: int = BLOCK, end: int = END) -> DataFrame:
    """A shard per input partition. tokens is the file; ended, which scans don't read, lists the ids of documents in order.

    Special tokens' strings in a text are tokenized as text, so `end` appears after documents only.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held, filled, ended = TaskContext.get().partitionId(), 0, [], 0, []
        encoder = shared_encoder(vocabulary, True)

        def row(tokens: np.ndarray, own: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([tokens.tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64()))], ["shard", "block", "tokens", "ended"])

        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = encoder.encode(part.column(1))
                stops = ends + np.arange(1, len(ends) + 1)
                flat = np.empty(len(ids) + len(ends), "<u2")
                last = stops - 1
                flat[last] = end
                keep = np.ones(len(flat), bool)
                keep[last] = False
                flat[keep] = ids
                held.append(flat)
                ended += zip((last + filled).tolist(), part.column(0).to_pylist(), strict=True)
                filled += len(flat)
                if filled >= block:
                    whole, at, k = np.concatenate(held), 0, 0
                    while filled - at >= block:
                        own = []
                        while k < len(ended) and ended[k][0] < at + block:
                            own.append(ended[k][1])
                            k += 1
                        yield row(whole[at : at + block], own)
                        number, at = number + 1, at + block
                    held, ended, filled = [whole[at:]], [(p - at, d) for p, d in ended[k:]], filled - at
        if filled:
            yield row(np.concatenate(held), [d for _, d in ended])

    return materialize(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS), path, options=groups())


def separators(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """shard, block, its length n, and the places of the separators in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for raw in batch.column(2).to_pylist():
                tokens = np.frombuffer(raw or b"", dtype)
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == end).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["shard", "block", "n", "places"])

    return blocks.select("shard", "block", "tokens").mapInArrow(run, "shard int, block int, n bigint, places array<int>")


def scan(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """shard, block and nth (where the document's separator is), ordinal in the shard, start, n_tokens, terminated.

    Tokens after a shard's last separator are a document that is not terminated, if there are any. An empty shard, and an
    empty table, give no rows.
    """
    with small_batches(blocks.sparkSession):
        found = materialize(separators(blocks, end, dtype))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard").orderBy("block")
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = found.withColumn("base", base).withColumn("count", F.size("places")).withColumn("after", F.when(F.col("count") > 0, F.col("base") + F.element_at("places", -1) + 1))
    placed = placed.withColumns({"ordinal": F.coalesce(F.sum("count").over(before), F.lit(0)), "begun": F.coalesce(F.max("after").over(before), F.lit(0)), "last": F.lead("block").over(whole).isNull()})
    stops = F.expr("transform(places, (p, i) -> named_struct('nth', i, 'stop', base + p, 'start', if(i = 0, begun, base + places[greatest(i - 1, 0)] + 1), 'terminated', true))")
    total, begun = F.col("base") + F.col("n"), F.coalesce("after", "begun")
    tail = F.when(F.col("last") & (total > begun), F.array(F.struct(F.col("count").alias("nth"), total.alias("stop"), begun.alias("start"), F.lit(False).alias("terminated")))).otherwise(F.array().cast("array<struct<nth:int,stop:bigint,start:bigint,terminated:boolean>>"))
    docs = placed.select("shard", "block", "ordinal", F.explode(F.concat(stops, tail)).alias("d"))
    return docs.select("shard", "block", F.col("d.nth").alias("nth"), (F.col("ordinal") + F.col("d.nth")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.col("d.terminated").alias("terminated"))


def count_tokens(documents: DataFrame, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, and shard, ordinal and start of the document in the flat files that were written and scanned.

    Null and empty texts have 0 tokens. Repeated rows are documents of their own; null ids are kept; an empty table gives
    no rows; columns other than doc_id and text are not read.
    """
    blocks = write_shards(documents, None, vocabulary, block)
    names = blocks.select("shard", "block", F.posexplode("ended").alias("nth", "doc_id"))
    return scan(blocks).join(names, ["shard", "block", "nth"], "left").select("doc_id", "n_tokens", "shard", "ordinal", "start")
