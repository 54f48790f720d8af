"""Content-defined chunking of media payloads into a deduplicated store, and verified reconstruction.

A payload's cut points are where a gear hash of the last 32 bytes has its ten highest bits clear, between a least and a
most size; the hash is computed for a whole batch by doubling shifts in numpy. Chunks are named by SHA-256.

The store has two tables. `recipes` has a row per stored row: the ordered chunk list, and in its own compressed blob the
chunks that no other row has. `chunks` has every other chunk once. Which chunks occur more than once is found by a Spark
aggregate over digests; it reaches the scan as a Bloom filter of bounded size. A false positive only sends a chunk to
`chunks` though it has one owner, so the result is exact at any size. Bytes thus move only if they are shared: recipes
without shared chunks are read back in place, the others join `chunks` by digest. Every chunk and every medium is verified.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemill.llm.common import materialize, scratch, slices

LEAST, MOST, BITS, SEED = 256, 8192, 10, 20_240_607
#: Bits of the filter of shared digests: 16 for each, within these bounds (8 MB at most).
FILTER_BITS, PROBES = (1 << 16, 1 << 26), 4
PAD = 64

GEAR = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, ends: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[list[int]]:
    """Chunk ends of each payload; payload i of the buffer ends at ends[i]. A payload's cuts depend on its bytes alone."""
    if least < 32:
        raise ValueError("the hash looks 32 bytes back; a chunk has no fewer")
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint32(shift)
        h = more
    found = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    out, start, k = [], 0, 0
    for end in ends.tolist():
        own, at = [], start
        while end - at > least:
            k = bisect_left(found, at + least, k)
            to = min(found[k] if k < len(found) else end, at + most, end)
            own.append(to)
            at = to
        if at < end:
            own.append(end)
        out.append(own)
        start = end
    return out


def wav_header(n: int) -> bytes:
    """Of 8-bit mono samples at 8 kHz."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n)


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes filled with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % PAD if raw else PAD)


def chunked(texts: list[str | None]) -> Iterator[tuple[int, bytes, list[tuple[bytes, bytes]]]]:
    """Per text: its length, its payload, and the payload's chunks as (digest, bytes)."""
    payloads = [padded(t) for t in texts]
    data = np.frombuffer(b"".join(p for _, p in payloads), np.uint8)
    start = 0
    for (n, payload), own in zip(payloads, cuts(data, np.cumsum([len(p) for _, p in payloads])), strict=True):
        parts, at = [], 0
        for to in own:
            part = payload[at : to - start]
            parts.append((hashlib.sha256(part).digest(), part))
            at = to - start
        start += len(payload)
        yield n, payload, parts


class Filter:
    """A Bloom filter over SHA-256 digests, whose own words serve as hashes."""

    def __init__(self, bits: int, words: np.ndarray | None = None) -> None:
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64) if words is None else words

    def probes(self, digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(digests), "<u4").reshape(-1, 8)[:, :PROBES] & np.uint32(self.bits - 1)

    def __call__(self, digests: list[bytes]) -> np.ndarray:
        at = self.probes(digests)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)


def shared_filter(shared: DataFrame) -> Filter:
    """Of the column digest. The words are or-ed in Spark; at most FILTER_BITS / 64 rows come to the driver."""
    n = shared.count()
    bits = min(max(FILTER_BITS[0], 1 << (16 * n - 1).bit_length() if n else 0), FILTER_BITS[1])
    out = Filter(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = Filter(bits).probes(batch.column(0).to_pylist()).ravel()
                words, which = np.unique(at >> 6, return_inverse=True)
                mask = np.zeros(len(words), np.uint64)
                np.bitwise_or.at(mask, which, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    for row in shared.select("digest").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        out.words[row.word] = row.mask & 0xFFFF_FFFF_FFFF_FFFF
    return out


RECIPE = "doc_id bigint, media_id binary, n_bytes bigint, header binary, digests binary, sizes binary, shared binary, own binary, mixed boolean"


def write(documents: DataFrame, path: str | None = None) -> Store:
    """Store every row's text as the samples of a medium. Null and empty texts are 64 samples of 0."""
    spark, path = documents.sparkSession, path or scratch(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                count: dict[bytes, int] = {}
                for _, _, parts in chunked(part.column(0).to_pylist()):
                    for d, _ in parts:
                        count[d] = count.get(d, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["digest", "n"])

    shared = materialize(source.select("text").mapInArrow(digests, "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"))
    known = shared_filter(shared)

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, (n, payload, parts) in zip(part.column(0).to_pylist(), chunked(part.column(1).to_pylist()), strict=True):
                    names, header = [d for d, _ in parts], wav_header(len(payload))
                    out = known(names)
                    own = b"".join(b for (_, b), s in zip(parts, out, strict=True) if not s)
                    rows.append((doc_id, hashlib.sha256(header + payload).digest(), n, header, b"".join(names), np.array([len(b) for _, b in parts], "<u4").tobytes(), out.astype(np.uint8).tobytes(), pack(own) if own else b"", bool(out.any())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for _, _, parts in chunked(part.column(0).to_pylist()):
                    for (d, b), s in zip(parts, known([d for d, _ in parts]), strict=True):
                        if s and d not in seen:
                            seen.add(d)
                            rows.append((d, pack(b)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["digest", "data"])

    types = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    NAMES, TYPES = [c.split()[0] for c in RECIPE.split(", ")], [types[c.split()[1]] for c in RECIPE.split(", ")]
    source.mapInArrow(recipes, RECIPE).write.option("compression", "uncompressed").parquet(f"{path}/recipes")
    source.select("text").mapInArrow(apart, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data")).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    return Store(spark, path)


class Store:
    """The two tables of a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def recipes(self) -> DataFrame:
        return self.spark.read.schema(RECIPE).parquet(f"{self.path}/recipes")

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("digest binary, data binary").parquet(f"{self.path}/chunks")

    def read(self, describe: Callable[[bytes, bytes], tuple], schema: str) -> DataFrame:
        """doc_id, n_bytes and describe(header, payload) of every row, after all digests have been verified."""
        every, width = self.recipes(), len(schema.split(", "))
        types = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        names, kinds = [c.split()[0] for c in schema.split(", ")], [types[c.split()[1]] for c in schema.split(", ")]

        def rebuilt(row: dict, apart: dict[bytes, bytes], unpack: Callable) -> tuple:
            payload, own, at = [], unpack(row["own"]) if row["own"] else b"", 0
            for k, (size, out) in enumerate(zip(np.frombuffer(row["sizes"], "<u4").tolist(), row["shared"], strict=True)):
                name = row["digests"][32 * k : 32 * k + 32]
                if out:
                    part = apart[name]
                else:
                    part, at = own[at : at + size], at + size
                if len(part) != size or hashlib.sha256(part).digest() != name:
                    raise ValueError(f"chunk {k} of medium {row['media_id'].hex()} is damaged")
                payload.append(part)
            whole = b"".join(payload)
            if hashlib.sha256(row["header"] + whole).digest() != row["media_id"]:
                raise ValueError(f"medium {row['media_id'].hex()} is damaged")
            return describe(row["header"], whole)

        def batch_of(first: list[tuple[str, list, pa.DataType]], found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * width
            return pa.RecordBatch.from_arrays([*(pa.array(v, t) for _, v, t in first), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*(n for n, _, _ in first), *names])

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for part in slices(batch, "own"):
                    rows = part.to_pylist()
                    yield batch_of([("doc_id", [r["doc_id"] for r in rows], pa.int64()), ("n_bytes", [r["n_bytes"] for r in rows], pa.int64())], [rebuilt(r, {}, unpack) for r in rows])

        in_place = every.where("not mixed").mapInArrow(alone, f"doc_id bigint, n_bytes bigint, {schema}")

        # Equal media are rebuilt once: first the recipe, then its shared chunks, by medium.
        mixed = every.where("mixed")
        fields = ["media_id", "header", "digests", "sizes", "shared", "own"]
        once = materialize(mixed.select(*fields).dropDuplicates(["media_id"]), codec="uncompressed")

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                media, digests = [], []
                for r in batch.to_pylist():
                    own = list(dict.fromkeys(r["digests"][32 * k : 32 * k + 32] for k, s in enumerate(r["shared"]) if s))
                    media += [r["media_id"]] * len(own)
                    digests += own
                yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(digests, pa.binary())], ["media_id", "digest"])

        parts = once.select("media_id", "digests", "shared").mapInArrow(wanted, "media_id binary, digest binary").join(self.chunks(), "digest")
        nothing = [F.lit(None).cast("binary").alias(c) for c in fields[1:]]
        stream = once.select(F.lit(0).alias("turn"), *fields, F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("data"))
        stream = stream.unionByName(parts.select(F.lit(1).alias("turn"), "media_id", *nothing, "digest", "data"))
        stream = stream.repartition("media_id").sortWithinPartitions("media_id", "turn")

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack, row, apart = zstandard.ZstdDecompressor().decompress, None, {}
            for batch in batches:
                ids, found = [], []
                for r in batch.to_pylist():
                    if r["turn"] == 0:
                        if row is not None:
                            ids.append(row["media_id"])
                            found.append(rebuilt(row, apart, unpack))
                        row, apart = r, {}
                    else:
                        apart[r["digest"]] = unpack(r["data"])
                yield batch_of([("media_id", ids, pa.binary())], found)
            if row is not None:
                yield batch_of([("media_id", [row["media_id"]], pa.binary())], [rebuilt(row, apart, unpack)])

        media = stream.mapInArrow(together, f"media_id binary, {schema}")
        return in_place.unionByName(mixed.select("doc_id", "n_bytes", "media_id").join(media, "media_id").drop("media_id"))


DESCRIBED = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def described(header: bytes, payload: bytes) -> tuple:
    """What op1 returns of a medium; the feature is samples, sum, sum of squares and crossings of the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    feature = f"{len(x)}:{x.sum()}:{(x * x).sum()}:{np.count_nonzero(np.diff(x >= 128))}"
    whole = hashlib.sha256(header)
    whole.update(payload)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(header) + len(payload), whole.hexdigest(), feature


def store_and_read(documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document row: doc_id, n_bytes and what `described` gives of the medium that was read back.

    Null and empty texts are equal. Repeated rows share all chunks and get equal rows; null ids are kept; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    return write(documents, path).read(described, DESCRIBED)
