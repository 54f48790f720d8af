"""Statistics of labels by tree, node, feature and bin.

Regression sums weight, weighted label and weighted square; classification sums the weight of each class. There are two
ways to the same table. `sql_histogram` unpivots rows and aggregates; everything stays in generated code, but each row
becomes one for every tree and feature. `arrow_histogram` counts a partition's rows into arrays and hands on the bins that
are not empty, so what moves is bounded by nodes, features and bins; it is the default for growing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemill.plans.trees import Feature, Flat, Tree

#: Cells of a task's dense arrays at most; beyond it nodes are counted in blocks.
DENSE = 4_000_000
#: Rows that are gathered for each pass over the blocks of a task whose arrays would be larger.
GATHER = 1 << 19
#: Pairs of nodes and features up to so many are broadcast (some tens of MB).
BROADCAST = 500_000

Batch = list[tuple[int, int]]


def width(classes: int) -> int:
    return classes or 3


def stats_names(classes: int) -> list[str]:
    return [f"s{k}" for k in range(width(classes))]


def schema(classes: int) -> str:
    return "tree int, node int, feature int, bin int, " + ", ".join(f"{s} double" for s in stats_names(classes))


def sums(classes: int, y: Column, w: Column) -> list[Column]:
    if classes:
        return [F.sum(F.when(y == k, w).otherwise(0.0)).alias(f"s{k}") for k in range(classes)]
    return [F.sum(w).alias("s0"), F.sum(w * y).alias("s1"), F.sum(w * y * y).alias("s2")]


def sql_histogram(frame: DataFrame, trees: list[Tree], features: list[Feature], batch: Batch, classes: int = 0, chosen: dict | None = None) -> DataFrame:
    """frame: y, w_0.. (a weight for each tree), b_0.. (bin ids). Rows without weight, and at nodes not in the batch, count nothing."""
    wanted = {t: sorted(n for u, n in batch if u == t) for t in sorted({t for t, _ in batch})}
    placed = [x for t in wanted for x in (trees[t].on_bins(features, lambda n: F.lit(n.id)).cast("int").alias(f"node_{t}"), F.col(f"w_{t}").cast("double").alias(f"w_{t}"))]
    bins = [F.col(f"b_{j}").cast("int").alias(f"b_{j}") for j in range(len(features))]
    # stack reads columns that a projection has computed once; the optimiser copies what explode and inline read into filters.
    rows = frame.select("y", *bins, *placed)
    rows = rows.select("y", *[f"b_{j}" for j in range(len(features))], F.stack(F.lit(len(wanted)), *[x for t in wanted for x in (F.lit(t), F.col(f"node_{t}"), F.col(f"w_{t}"))]).alias("tree", "node", "w")).where("w > 0")
    rows = rows.where(F.expr(" or ".join(f"(tree = {t} and node in ({', '.join(map(str, own))}))" for t, own in wanted.items())))
    rows = rows.select("tree", "node", "y", "w", F.stack(F.lit(len(features)), *[x for j in range(len(features)) for x in (F.lit(j), F.col(f"b_{j}"))]).alias("feature", "bin"))
    if chosen:
        own = [(t, n, f) for (t, n), every in chosen.items() for f in every]
        few = frame.sparkSession.createDataFrame(own, "tree int, node int, feature int")
        rows = rows.join(F.broadcast(few) if len(own) <= BROADCAST else few, ["tree", "node", "feature"], "semi")
    return rows.groupBy("tree", "node", "feature", "bin").agg(*sums(classes, F.col("y"), F.col("w")))


class Counter:
    """Adds rows to the cells of (batch entry, feature, bin)."""

    def __init__(self, features: list[Feature], entries: int, classes: int) -> None:
        self.at = np.concatenate([[0], np.cumsum([f.bins.cardinality for f in features])]).astype(np.int64)
        self.classes, self.k, self.entries = classes, width(classes), entries

    def cells(self) -> int:
        return self.entries * int(self.at[-1])

    def values(self, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        return [w * (y == c) for c in range(self.classes)] if self.classes else [w, w * y, w * y * y]

    def dense(self, into: np.ndarray, entry: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        values, total = self.values(y, w), int(self.at[-1])
        for j in range(len(self.at) - 1):
            size = int(self.at[j + 1] - self.at[j])
            key = entry * size + bins[j]
            for s, v in enumerate(values):
                into[:, self.at[j] : self.at[j + 1], s] += np.bincount(key, v, self.entries * size).reshape(self.entries, size)
        assert into.shape == (self.entries, total, self.k)


def arrow_histogram(frame: DataFrame, trees: list[Tree], features: list[Feature], batch: Batch, classes: int = 0, chosen: dict | None = None, dense: int = DENSE) -> DataFrame:
    """The same as sql_histogram, from partial sums of partitions."""
    use = sorted({t for t, _ in batch})
    flats = {t: Flat(trees[t], features) for t in use}
    index = {t: {n: i for i, (u, n) in enumerate(batch) if u == t} for t in use}
    names = [f.name for f in features]
    counter = Counter(features, len(batch), classes)
    allowed = None if not chosen else {i: sorted(chosen[key]) for i, key in enumerate(batch)}
    columns = [c.split()[0] for c in schema(classes).split(", ")]
    entry_tree, entry_node = np.array([t for t, _ in batch]), np.array([n for _, n in batch])

    def rows(block: np.ndarray, first: int = 0) -> pa.RecordBatch:
        weight = block.sum(axis=2) if classes else block[:, :, 0]
        e, cell = np.nonzero(weight > 0)
        f = np.searchsorted(counter.at, cell, "right") - 1
        if allowed is not None:
            mask = np.zeros((len(batch), len(names)), bool)
            for i, own in allowed.items():
                mask[i, own] = True
            fine = mask[e + first, f]
            e, cell, f = e[fine], cell[fine], f[fine]
        ints = [entry_tree[e + first], entry_node[e + first], f, cell - counter.at[f]]
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in ints), *(pa.array(block[e, cell, s]) for s in range(counter.k))], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Entries are taken in blocks, so arrays stay within `dense` cells whatever the number of nodes.
        per = max(1, dense // max(1, int(counter.at[-1]) * counter.k))
        whole = np.zeros((len(batch), int(counter.at[-1]), counter.k)) if len(batch) <= per else None
        held: list[tuple[np.ndarray, ...]] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            own, bins, y, w = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(0, len(batch) + per, per))
            for k, first in enumerate(range(0, len(batch), per)):
                some = order[cuts[k] : cuts[k + 1]]
                if len(some):
                    small = Counter(features, min(per, len(batch) - first), classes)
                    block = np.zeros((small.entries, int(small.at[-1]), small.k))
                    small.dense(block, own[some] - first, bins[:, some], y[some], w[some])
                    yield rows(block, first)

        for part in batches:
            if not part.num_rows:
                continue
            y = part.column(0).to_numpy(zero_copy_only=False)
            ws = {t: part.column(1 + i).to_numpy(zero_copy_only=False) for i, t in enumerate(use)}
            bins = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1 + len(use) :]]).astype(np.int64)
            for t in use:
                node, entry = flats[t].walk(bins), np.full(int(flats[t].feature.shape[0]), -1)
                for n, i in index[t].items():
                    entry[n] = i
                own = entry[node]
                live = np.flatnonzero((own >= 0) & (ws[t] > 0))
                if whole is not None:
                    counter.dense(whole, own[live], bins[:, live], y[live], ws[t][live])
                elif len(live):
                    held.append((own[live], bins[:, live], y[live], ws[t][live]))
                    if sum(len(h[0]) for h in held) >= GATHER:
                        yield from blocks()
        if whole is not None:
            yield rows(whole)
        elif held:
            yield from blocks()

    picked = frame.select(F.col("y").cast("double"), *[F.col(f"w_{t}").cast("double") for t in use], *[F.col(f"b_{j}").cast("int") for j in range(len(features))])
    # Summed up by all four keys in each task before anything moves; the windows of the split search deal what is left.
    return picked.mapInArrow(run, schema(classes)).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(s).alias(s) for s in stats_names(classes)])
