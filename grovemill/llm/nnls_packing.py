"""Sequence packing by non-negative least squares on the length histogram.

Documents are cut into whole windows and one remainder. Lengths are counted in units of UNIT tokens, rounded up; so the
histogram has at most window / UNIT bins, whatever the corpus. On the driver, combinations of up to three bins that fill a
window exactly are the columns of a non-negative least squares problem whose right side is the histogram. Its solution,
rounded and held to the counts, gives how often each combination is used; what is left is packed greedily, bin by bin, and
remainders longer than half a window may first be cut in two if that takes fewer sequences. The plan is a table of slots
(bounded by the number of bins), and pieces find their slots by their rank within their bin. Ranks are counted within
salted groups, so no bin, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemill.llm.common import materialize, prefix_sums, slices
from grovemill.llm.tokens import default_vocabulary, shared_encoder

WINDOW, UNIT, END_ID = 2048, 8, 1
#: Ranked rows that meet in one task, about.
RANKED = 200_000
#: Groups of a bin at least, so a common bin is dealt evenly in small tables too.
LEAST_SALTS = 64


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Active-set least squares with x >= 0 (Lawson and Hanson)."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    right = a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(most or 3 * a.shape[0] + 10):
        slope = right - a.T @ (a @ x)
        slope[passive] = -np.inf
        if not len(slope) or slope.max() <= tiny:
            break
        passive[int(slope.argmax())] = True
        while True:
            own = np.flatnonzero(passive)
            part = a[:, own]
            gram = part.T @ part
            gram[np.diag_indices(len(own))] += 1e-10
            best = np.linalg.solve(gram, right[own])
            if best.min() > 0:
                x[:] = 0
                x[own] = best
                break
            bad = best <= 0
            step = float(np.min(x[own][bad] / np.maximum(x[own][bad] - best[bad], 1e-300)))
            x[own] += step * (best - x[own])
            gone = own[(x[own] <= 1e-12) | (bad & (x[own] <= 1e-9))]
            gone = gone if len(gone) else own[[int(best.argmin())]]
            x[gone] = 0
            passive[gone] = False
            if not passive.any():
                break
    return x


@dataclass
class Plan:
    """Strategies (bin -> how many per sequence, repeats) and which ranks of a bin are cut in half a window."""

    units: int
    counts: dict[int, int]
    strategies: list[tuple[dict[int, int], int]] = field(default_factory=list)
    #: Ranks from here on are cut, for bins over half a window.
    cut_from: dict[int, int] = field(default_factory=dict)

    def slots(self) -> list[tuple[int, int, int, int, int, int]]:
        """(bin, first rank, sequences before, pieces of the bin in a sequence, place of the bin in it, repeats)."""
        at: dict[int, int] = {}
        rows, before = [], 0
        for use, repeats in self.strategies:
            for place, (k, n) in enumerate(sorted(use.items(), reverse=True)):
                rows.append((k, at.get(k, 0), before, n, place, repeats))
                at[k] = at.get(k, 0) + n * repeats
            before += repeats
        return rows

    def heads(self) -> dict[int, int]:
        """Where the first halves of a bin's cut pieces begin among the pieces of half a window."""
        at, found = self.counts.get(self.units // 2, 0), {}
        for k in sorted(self.cut_from):
            found[k] = at
            at += self.counts[k] - self.cut_from[k]
        return found


def greedy(counts: dict[int, int], units: int) -> list[tuple[dict[int, int], int]]:
    """Fill windows from the largest bin down; repeat each filling as often as the counts allow."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        room, use = units, {}
        for k in sorted(left, reverse=True):
            if n := min(left[k], room // k):
                use[k], room = n, room - n * k
        repeats = min(left[k] // n for k, n in use.items())
        out.append((use, repeats))
        for k, n in use.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
    return out


def plan(counts: dict[int, int], units: int = WINDOW // UNIT) -> Plan:
    """A packing of counts[k] pieces of k units each, k from 1 to units."""
    counts = {k: n for k, n in counts.items() if n > 0}
    out = Plan(units, counts)
    bins = sorted(k for k in counts if k < units)
    columns = [{k: 2} for k in bins if 2 * k == units] + [{a: 1, units - a: 1} for a in bins if 2 * a < units and units - a in counts]
    for i, a in enumerate(bins):
        for b in bins[i:]:
            c = units - a - b
            if c < b:
                break
            if c in counts and c < units:
                use: dict[int, int] = {}
                for k in (a, b, c):
                    use[k] = use.get(k, 0) + 1
                columns.append(use)
    left = dict(counts)
    if whole := left.pop(units, 0):
        out.strategies.append(({units: 1}, whole))
    if columns:
        row = {k: i for i, k in enumerate(bins)}
        a = np.zeros((len(bins), len(columns)))
        for j, use in enumerate(columns):
            for k, n in use.items():
                a[row[k], j] = n
        b = np.array([float(counts[k]) for k in bins])
        x = nnls(a, b / b.max()) * b.max()
        for j in np.argsort(-x, kind="stable"):
            repeats = min([int(round(x[j])), *(left[k] // n for k, n in columns[j].items())])
            if repeats > 0:
                out.strategies.append((columns[j], repeats))
                for k, n in columns[j].items():
                    left[k] -= n * repeats
    left = {k: n for k, n in left.items() if n}
    plain, half = greedy(left, units), units // 2
    cut: dict[int, int] = {}
    for k, n in left.items():
        for part in (half, k - half) if k > half else (k,):
            cut[part] = cut.get(part, 0) + n
    halved = greedy(cut, units)
    if sum(n for _, n in halved) < sum(n for _, n in plain):
        out.cut_from = {k: counts[k] - n for k, n in left.items() if k > half}
        out.strategies += halved
    else:
        out.strategies += plain
    return out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, head_crc32 bigint, rest_crc32 bigint"


def pieces(documents: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Whole windows and remainders of every document's ids, with checksums; of long remainders also those of both halves."""
    vocabulary, half = vocabulary or default_vocabulary(), window // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = encoder.encode(part.column(1))
                rows: list[tuple] = []
                before = 0
                for doc_id, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                    own = np.empty(end - before + 1, "<u4")
                    own[:-1], own[-1] = ids[before:end], END_ID
                    before, n, raw = end, len(own), memoryview(own).cast("B")
                    for start in range(0, n, window):
                        to = min(n, start + window)
                        long = half < to - start < window
                        rows.append((doc_id, start, to - start, zlib.crc32(raw[4 * start : 4 * to]), n, zlib.crc32(raw[4 * start : 4 * (start + half)]) if long else None, zlib.crc32(raw[4 * (start + half) : 4 * to]) if long else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(documents: DataFrame, vocabulary: str | None = None, window: int = WINDOW, unit: int = UNIT, ranked: int = RANKED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece that holds the closing id. Repeated rows are packed as often as they occur, and a
    null doc_id is a value like any other. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    if window % (2 * unit):
        raise ValueError("half a window must be a whole number of units")
    half, units = window // 2, window // unit
    cut = materialize(pieces(documents, vocabulary, window).withColumns({"bin": F.ceil(F.col("length") / unit).cast("int"), "row": F.monotonically_increasing_id(), "one": F.lit(1).cast("bigint")}))
    counts = {r["bin"]: r["n"] for r in cut.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    found = plan(counts, units)

    # Rank within the bin: groups of about `ranked` rows by hash. One that equal pieces make hot is cut further.
    salts = max(LEAST_SALTS, -(-sum(counts.values()) // ranked))
    same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    salted = cut.withColumn("hash", F.xxhash64(*same)).withColumn("salt", F.pmod("hash", F.lit(salts)).cast("int"))
    ranks = prefix_sums(salted, ["bin"], "salt", {"hash": F.col("hash")}, {"rank": "one"}, [F.col("hash"), *map(F.col, same)], "row", 2 * ranked)

    slots = sorted(found.slots())
    key = np.array([(k << 44) + first for k, first, *_ in slots], np.int64)
    base, each, place = (np.array([r[i] for r in slots], np.int64) for i in (2, 3, 4))
    first_rank = np.array([r[1] for r in slots], np.int64)
    heads, cut_from, had = found.heads(), found.cut_from, counts
    never = np.iinfo(np.int64).max
    from_of, head_of, had_of = np.full(units + 1, never), np.zeros(units + 1, np.int64), np.zeros(units + 1, np.int64)
    for k in cut_from:
        from_of[k], head_of[k], had_of[k] = cut_from[k], heads[k], had.get(k - units // 2, 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"]
        for batch in batches:
            if not batch.num_rows:
                continue
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            num = {n: get[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "length", "ids_crc32", "doc_tokens", "bin", "rank")}
            k, rank = num["bin"], num["rank"]
            over = rank >= from_of[k]
            rest = rank[over] - from_of[k[over]]
            head, tail = (np.array([x or 0 for x in get[n].filter(pa.array(over)).to_pylist()], np.int64) for n in ("head_crc32", "rest_crc32"))
            ids = get["doc_id"]
            ids = pa.concat_arrays([ids.filter(pa.array(~over)), ids.filter(pa.array(over)), ids.filter(pa.array(over))])
            join = lambda n, a, b: np.concatenate([num[n][~over], a, b])
            start = join("start", num["start"][over], num["start"][over] + half)
            length = join("length", np.full(len(rest), half), num["length"][over] - half)
            crc, total = join("ids_crc32", head, tail), join("doc_tokens", num["doc_tokens"][over], num["doc_tokens"][over])
            k, rank = join("bin", np.full(len(rest), units // 2), k[over] - units // 2), join("rank", head_of[k[over]] + rest, had_of[k[over]] + rest)
            at = np.searchsorted(key, (k << 44) + rank, "right") - 1
            inside = rank - first_rank[at]
            columns = [ids, *(pa.array(x) for x in (start, length, crc, total, base[at] + inside // each[at], place[at] * units + inside % each[at]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, place bigint"
    placed = ranks.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "head_crc32", "rest_crc32", "bin", "rank").mapInArrow(assign, schema)
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("place")


def padded_length(filled: int, window: int = WINDOW) -> int:
    """The length that a sequence is padded to: the window, except that a power of two stays as it is."""
    return filled if filled & (filled - 1) == 0 else window
