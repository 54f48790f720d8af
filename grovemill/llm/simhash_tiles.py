"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Fingerprints are made distinct first, so copies cost nothing. Two fingerprints at radius r or less that are cut into
r + m blocks agree in m blocks at least; so each choice of m blocks gives a grouping, and comparing within all groups finds
every link. Groups are cut into tiles sorted by population count. A tile pair whose counts are further apart than the
radius is never made; the others are compared with numpy exclusive-or and bit counts, and each comparison hands on only the
edges of a spanning forest. m grows with the number of fingerprints, which holds the expected group size. Components are
found by large-star and small-star rounds over DataFrames, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemill.llm.common import discard, join_hot, materialize, row_hash, scratch, slices, swept, texts_of, whole_row

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile, and the group size that the choice of blocks aims at.
TILE, GROUP = 1024, 1024


def fingerprint_array(texts: list[str], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of texts: bit b is set if over half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").lower().split()
        if not own:
            continue
        joined = b" ".join(own)
        n = max(1, len(own) - words + 1)
        if n == 1:
            hashes = np.array([digest(joined, seed)], np.uint64)
        else:
            sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
            ends = np.cumsum(sizes)
            starts = (ends - sizes)[:n].tolist()
            hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 65_536):
            ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(documents: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, body (a hash of the text) and fp (the fingerprint's bits as a signed long), one row per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprint_array(texts_of(part), words, seed).view(np.int64))], ["doc_id", "body", "fp"])

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text")).mapInArrow(run, "doc_id bigint, body bigint, fp bigint")


def blocks_for(count: int, radius: int = RADIUS, group: int = GROUP) -> int:
    """How many blocks must agree: enough that a group is expected to hold no more than `group` of count fingerprints."""
    m = 1
    while m < 6 and count / 2 ** (64 * m // (radius + m)) > group:
        m += 1
    return m


def masks(radius: int, agree: int) -> list[int]:
    """Bit masks of all choices of `agree` of radius + agree blocks."""
    edges = np.linspace(0, 64, radius + agree + 1).astype(int)
    block = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, agree)]


def forest(values: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph whose symmetric boolean matrix is near, by breadth-first search."""
    lefts, rights = [], []
    fresh = near.sum(axis=1) > near.diagonal()
    for start in np.flatnonzero(fresh).tolist():
        if not fresh[start]:
            continue
        fresh[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            if len(found := np.flatnonzero(near[at] & fresh)):
                fresh[found] = False
                queue += found.tolist()
                lefts.append(np.full(len(found), values[at]))
                rights.append(values[found])
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (values[:0], values[:0])


def compare(own: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (spanning forest) within one tile, or between two; each is sorted by population count."""
    values = own if other is None else np.concatenate([own, other])
    second, base = (own, 0) if other is None else (other, len(own))
    ones, their = np.bitwise_count(own).astype(np.int64), np.bitwise_count(second).astype(np.int64)
    near = np.zeros((len(values), len(values)), bool)
    for at in range(0, len(own), 256):
        to = min(len(own), at + 256)
        low, high = np.searchsorted(their, ones[at] - radius), np.searchsorted(their, ones[to - 1] + radius, "right")
        near[at:to, base + low : base + high] = np.bitwise_count(own[at:to, None] ^ second[None, low:high]) <= radius
    if other is not None:
        near[base:, :base] = near[:base, base:].T
    return forest(values, near)


def links(distinct: DataFrame, count: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b), of which the components are those of all pairs at the radius or less.

    distinct: one column fp. Groups of up to `tile` fingerprints are one tile. Larger ones are cut into tiles by population
    count, then by hash, and a tile meets those with a count within the radius; so no group meets in one task.
    """
    every = masks(radius, blocks_for(count, radius))
    signed = [int(np.array([m], np.uint64).view(np.int64)[0]) for m in every]
    keyed = distinct.withColumn("ones", F.bit_count("fp").cast("int")).select("fp", "ones", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "key"))
    # How many rows each population count of a group has: bounded by 65 a group, and summed before it moves.
    sizes = keyed.groupBy("choice", "key", "ones").agg(F.count("*").alias("n"))
    # A tile id is the population count and a part; a group of one tile has the single id -1.
    by_group = Window.partitionBy("choice", "key")
    parts = sizes.withColumn("total", F.sum("n").over(by_group)).where("total > 1").withColumn("parts", F.when(F.col("total") <= tile, F.lit(0)).otherwise(F.ceil(F.col("n") / tile)).cast("int"))
    near = Window.partitionBy("choice", "key").orderBy("ones").rangeBetween(-radius, radius)
    tiles = parts.withColumn("near", F.when(F.col("parts") == 0, F.lit(None)).otherwise(F.collect_list(F.struct("ones", "parts")).over(near))).select("choice", "key", "ones", "parts", "near")
    member = keyed.join(tiles, ["choice", "key", "ones"])
    part = F.pmod(F.xxhash64("fp"), F.greatest("parts", F.lit(1))).cast("int")
    own = F.col("ones").cast("bigint") * 100_000_000 + F.col("part")
    pair = F.expr(
        "transform(flatten(transform(near, t -> transform(sequence(0, t.parts - 1), p -> cast(t.ones as bigint) * 100000000 + p))),"
        " x -> named_struct('low', least(x, own), 'high', greatest(x, own)))"
    )
    small = member.where("parts = 0").select("choice", "key", F.lit(-1).cast("bigint").alias("low"), F.lit(-1).cast("bigint").alias("high"), F.lit(-1).cast("bigint").alias("own"), "fp")
    large = member.where("parts > 0").withColumn("part", part).withColumn("own", own).select("choice", "key", "own", "fp", F.explode(pair).alias("p")).select("choice", "key", "p.low", "p.high", "own", "fp")
    dealt = small.unionByName(large).repartition("choice", "key", "low", "high").sortWithinPartitions("choice", "key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fp = rows["fp"].view(np.uint64)
            fp, owner = fp[order := np.lexsort((fp, np.bitwise_count(fp)))], rows["own"][order]
            if rows["low"][0] == rows["high"][0]:
                return compare(fp, None, radius)
            mine = owner == rows["low"][0]
            return compare(fp[mine], fp[~mine], radius)

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            same = np.ones(len(rows), bool)
            for n in ("choice", "key", "low", "high"):
                same[1:] &= rows[n][1:] == rows[n][:-1]
            cuts = [*np.flatnonzero(~same[1:]) + 1, len(rows)]
            lefts, rights, at = [], [], 0
            for to in cuts:
                if to - at > 1:
                    a, b = edges(rows[at:to])
                    lefts.append(a)
                    rights.append(b)
                at = to
            if lefts:
                a, b = np.concatenate(lefts).view(np.int64), np.concatenate(rights).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def ends(rows: np.ndarray) -> int:
            """Where the last group of rows begins."""
            same = np.ones(len(rows), bool)
            for n in ("choice", "key", "low", "high"):
                same &= rows[n] == rows[n][-1]
            return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

        kind = np.dtype([(n, np.int64) for n in ("choice", "key", "low", "high", "own", "fp")])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.empty(batch.num_rows, kind)
            for i, n in enumerate(kind.names):
                rows[n] = batch.column(i).to_numpy(zero_copy_only=False)
            rows = np.concatenate([*held, rows])
            at = ends(rows)
            if at:
                yield from flush(rows[:at])
            held = [rows[at:]]
        if held:
            yield from flush(held[0])

    return dealt.select(*(F.col(c).cast("bigint") for c in ("choice", "key", "low", "high", "own", "fp"))).mapInArrow(run, "a bigint, b bigint").distinct()


def with_least(pairs: DataFrame) -> DataFrame:
    """pairs (x, y) with m, the least of x and its y."""
    low = materialize(pairs.groupBy("x").agg(F.least("x", F.min("y")).alias("m"), F.count("*").alias("n")))
    return join_hot(pairs, low.select("x", "m"), ["x"], low.select("x", "n"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge: root is the smallest v reachable. Large-star and small-star until nothing changes."""
    spark, last = edges.sparkSession, None
    path = scratch(spark)
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), path)
    while True:
        with swept(spark) as keep:
            # Large star: every neighbour larger than v is tied to the smallest of v's neighbours and v.
            both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
            large = materialize(with_least(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
            # Small star: v and its smaller neighbours are tied to the smallest of them.
            small = with_least(large).select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("v"), F.col("m").alias("u")).distinct()
            edges, fresh = keep(small)
        discard(spark, path)
        path = fresh
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select("v", F.col("u").alias("root"))
        last = state


def rooted(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct (fp, and other columns) with root, which fingerprints of a component share."""
    roots = components(links(distinct.select("fp"), distinct.count(), radius, tile))
    return distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for every document row.

    A text without words, null included, has the fingerprint zero. Repeated rows are linked as equal fingerprints. A null
    doc_id keeps its row and never names a component; a component of nothing else has a null component_id. An empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    docs = materialize(fingerprints(documents, words, seed).drop("body"))
    distinct = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = materialize(rooted(distinct.select("fp", "least"), radius, tile))
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = join_hot(linked.select("fp", "root"), least.drop("n"), ["root"], least.select("root", "n")).drop("root")
    return join_hot(docs, named, ["fp"], distinct.select("fp", "n")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The row with the smallest doc_id (null last) of every component, whole; of its repetitions that of the least hash.

    Columns of any name and type are kept. Null and empty texts are one component; an empty table gives no rows.
    """
    docs = fingerprints(documents, words, seed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "body")).alias("first")
    distinct = materialize(docs.groupBy("fp").agg(first))
    kept = rooted(distinct, radius).groupBy("root").agg(F.min("first").alias("first"))
    at = lambda name: F.coalesce(name, F.lit(0))
    kept = kept.select(F.col("first.lost").alias("lost"), at("first.doc_id").alias("at"), F.col("first.body").alias("body"))
    doc_id = F.col("doc_id").cast("bigint")
    rows = documents.select(doc_id.isNull().alias("lost"), at(doc_id).alias("at"), F.xxhash64(F.col("text").cast("string")).alias("body"), row_hash(documents).alias("hash"), whole_row(documents).alias("row"))
    # Repetitions are one before they move; the join finds them where they are then.
    return rows.groupBy("lost", "at", "body").agg(F.min_by("row", "hash").alias("row")).join(kept, ["lost", "at", "body"]).select("row.*")
