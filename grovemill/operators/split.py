"""Split search over histograms: with window sums in Spark for all nodes of a level, and in numpy for what is local.

Candidates of a numeric feature lie after each bin that has rows; missing values are a third child of their own, or part
alone from all others. Categories are put in the order of their mean label (regression and two classes) or of a hash, and
cut like numbers; or each has a child. A split counts if it lowers the impurity; of equal ones the first feature's first
candidate wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemill.functions.scalars import key_uniform
from grovemill.operators.histogram import stats_names
from grovemill.operators.impurity import Impurity, usual
from grovemill.plans.trees import MULTIWAY, NUMERIC, SUBSET, Feature

ORDERED, RANDOM = "ordered", "random"

@dataclass
class Found:
    """Of a node: its totals, and the best split, if any. members: (bin, stats, child), child 0 for left, 1 for right, or the
    bin's place among the children."""

    totals: np.ndarray
    feature: int | None = None
    kind: str = NUMERIC
    cut: int = 0
    impurity: float = 0.0
    parts: list[np.ndarray] | None = None
    members: list[tuple[int, np.ndarray, int]] | None = None


def weight_of(s: np.ndarray, classes: int) -> np.ndarray:
    return s.sum(axis=-1) if classes else s[..., 0]


def impurity_of(s: np.ndarray, classes: int, impurity: Impurity | None = None) -> np.ndarray:
    """By entropy or variance, if no other impurity is given; 0 without weight."""
    live = weight_of(s, classes) > 0
    return np.where(live, (impurity or usual(classes)).values(np.where(live[..., None], s, 1.0)), 0.0)


def prediction_of(s: np.ndarray, classes: int) -> tuple[float, float]:
    """Prediction and addendum: mean and variance, or the commonest class (the lowest of equals) and its share."""
    w = float(weight_of(s, classes))
    if classes:
        k = int(np.argmax(s))
        return float(k), float(s[k]) / w
    return float(s[1]) / w, float(impurity_of(s, classes))


def mean_of(s: np.ndarray, classes: int) -> np.ndarray:
    w = np.maximum(weight_of(s, classes), 1e-300)
    return (s * np.arange(classes)).sum(axis=-1) / w if classes else s[..., 1] / w


def order_kind(categories: str, classes: int) -> str:
    """Mean labels order categories only if labels are numbers or two classes."""
    return RANDOM if categories == RANDOM or classes > 2 else ORDERED


def uniform_of(key: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """The twin of key_uniform."""
    prime = 2147483647
    start = (seed * 69069 + stream * 362437 + 12345) % prime
    one = (key % prime * 48271 + start) % prime
    two = one * (one + (start * 31 + 7) % prime) % prime
    return (two * 16807 % prime) / float(prime)


def hashed_order(bins: np.ndarray, seed: int, tree: int, node: int) -> np.ndarray:
    return uniform_of((tree * 1_048_573 + node) * 65_536 + bins.astype(np.int64), seed, 1)


def best_local(tables: dict[int, np.ndarray], features: list[Feature], classes: int, categories: str, seed: int = 1, tree: int = 0, node: int = 1, impurity: Impurity | None = None) -> Found:
    """tables: of each feature an array (bins, stats)."""
    totals = next(iter(tables.values())).sum(axis=0)
    out, whole, total = Found(totals), float(impurity_of(totals, classes, impurity)), float(weight_of(totals, classes))
    best = whole
    for j, table in sorted(tables.items()):
        f, w = features[j], weight_of(table, classes)
        nothing = np.zeros(table.shape[1])
        lost = table[f.bins.missing] if f.bins.missing is not None else nothing
        bins = np.flatnonzero(w[: f.bins.regular] > 0) if not f.categorical else np.flatnonzero(w > 0)
        if f.categorical and categories == MULTIWAY:
            value = float((w[bins] * impurity_of(table[bins], classes, impurity)).sum() / total)
            if len(bins) > 1 and value < best:
                best = value
                out.feature, out.kind, out.cut, out.impurity, out.parts = j, MULTIWAY, 0, value, None
                out.members = [(int(b), table[b], i) for i, b in enumerate(bins)]
            continue
        if f.categorical:
            key = mean_of(table[bins], classes) if order_kind(categories, classes) == ORDERED else hashed_order(bins, seed, tree, node)
            bins = bins[np.lexsort((bins, key))]
        left = np.cumsum(table[bins], axis=0)
        right = table.sum(axis=0) - lost - left
        if not len(bins):
            continue
        wl, wr, wn = weight_of(left, classes), weight_of(right, classes), float(weight_of(lost, classes))
        wr[-1], right[-1] = 0.0, 0.0
        value = (wl * impurity_of(left, classes, impurity) + wr * impurity_of(right, classes, impurity) + wn * impurity_of(lost, classes, impurity)) / total
        fine = (wl > 0).astype(int) + (wr > 0) + (wn > 0) >= 2
        if not f.categorical:
            fine &= bins < f.bins.regular - 1
        value = np.where(fine, value, np.inf)
        k = int(value.argmin())
        if value[k] < best:
            best = float(value[k])
            out.feature, out.impurity, out.kind = j, best, SUBSET if f.categorical else NUMERIC
            alone = wr[k] <= 0
            out.cut = 0 if f.categorical or alone else int(bins[k]) + 1
            out.parts = [nothing, left[k], lost] if alone and not f.categorical else [left[k], right[k], lost]
            out.members = [(int(b), table[b], int(i > k)) for i, b in enumerate(bins)] if f.categorical else None
    return out


# Spark --------------------------------------------------------------------------------------------------------------


def weight_col(s: list[Column], classes: int) -> Column:
    return sum(s[1:], s[0]) if classes else s[0]


def impurity_col(s: list[Column], classes: int, impurity: Impurity | None = None) -> Column:
    return F.when(weight_col(s, classes) > 0, (impurity or usual(classes)).column(s)).otherwise(0.0)


def mean_col(s: list[Column], classes: int) -> Column:
    w = weight_col(s, classes)
    return sum((k * c for k, c in enumerate(s[1:], 1)), F.lit(0.0)) / w if classes else s[1] / w


#: Descriptions of up to so many features are literals; of more, a broadcast table with a row a feature.
LITERALS = 500


def with_features(hist: DataFrame, features: list[Feature], categories: str) -> DataFrame:
    """Of each row's feature: kind (0 numeric, 1 cut in order, 2 multiway), regular bins and the missing bin."""
    rows = [(j, 0, f.bins.regular, -1 if f.bins.missing is None else f.bins.missing) if not f.categorical else (j, 2 if categories == MULTIWAY else 1, f.bins.cardinality, -1) for j, f in enumerate(features)]
    if len(rows) <= LITERALS:
        at = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in rows]), F.col("feature") + 1)
        return hist.withColumns({"kind": at(1), "regular": at(2), "lost": at(3)})
    return hist.join(F.broadcast(hist.sparkSession.createDataFrame(rows, "feature int, kind int, regular int, lost int")), "feature")


def candidates(hist: DataFrame, features: list[Feature], classes: int, categories: str, seed: int = 1, impurity: Impurity | None = None) -> DataFrame:
    """All candidates: tree, node, feature, kind, bin, nth, impurity, and sums t (node), l, r and n (missing).

    Window sums run within a node's feature, so tasks are as many as nodes times features, and a window is a feature's bins.
    """
    names = stats_names(classes)
    s = [F.col(c) for c in names]
    h = with_features(hist, features, categories)
    if order_kind(categories, classes) == ORDERED:
        key = mean_col(s, classes)
    else:
        key = F.expr(key_uniform("(cast(tree as bigint) * 1048573 + node) * 65536 + bin", seed, 1))
    h = h.withColumn("place", F.when(F.col("kind") == 1, key).otherwise(F.col("bin").cast("double"))).withColumn("gone", F.col("bin") == F.col("lost"))
    by = ["tree", "node", "feature"]
    whole, running = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("gone", "place", "bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select(
        *by, "kind", "bin", "regular", "gone",
        F.row_number().over(running.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"),
        F.sum(F.when(~F.col("gone"), 1)).over(whole).alias("filled"),
        *[F.sum(c).over(whole).alias(f"t{k}") for k, c in enumerate(s)],
        *[F.sum(F.when(F.col("gone"), c).otherwise(0.0)).over(whole).alias(f"n{k}") for k, c in enumerate(s)],
        *[F.sum(F.when(F.col("gone"), 0.0).otherwise(c)).over(running).alias(f"l{k}") for k, c in enumerate(s)],
        F.sum(weight_col(s, classes) * impurity_col(s, classes, impurity)).over(whole).alias("spread"),
    )
    side = lambda p: [F.col(f"{p}{k}") for k in range(len(s))]
    last = F.col("nth") == F.col("filled")
    h = h.withColumns({f"r{k}": F.when(last, 0.0).otherwise(F.col(f"t{k}") - F.col(f"n{k}") - F.col(f"l{k}")) for k in range(len(s))})
    weights = [weight_col(side(p), classes) for p in "lrn"]
    two = sum((F.when(w > 0, 1).otherwise(0) for w in weights), F.lit(0)) >= 2
    cut = sum((w * impurity_col(side(p), classes, impurity) for p, w in zip("lrn", weights, strict=True)), F.lit(0.0)) / weight_col(side("t"), classes)
    lowered = F.when(F.col("kind") == 2, F.col("spread") / weight_col(side("t"), classes)).otherwise(cut)
    fine = F.when(F.col("kind") == 2, (F.col("filled") > 1) & last).when(F.col("kind") == 1, two).otherwise(two & (F.col("bin") < F.col("regular") - 1))
    return h.withColumn("impurity", lowered).withColumn("fine", fine & ~F.col("gone"))


def best_splits(hist: DataFrame, features: list[Feature], classes: int, categories: str, seed: int = 1, impurity: Impurity | None = None) -> DataFrame:
    """One row a node: totals (array), best (struct) or null. Only a node's best row reaches the driver."""
    c = candidates(hist, features, classes, categories, seed, impurity)
    n = len(stats_names(classes))
    side = lambda p: F.array(*[F.col(f"{p}{k}") for k in range(n)]).alias(p)
    worth = F.col("fine") & (F.col("impurity") < impurity_col([F.col(f"t{k}") for k in range(n)], classes, impurity))
    row = F.struct("impurity", "feature", "nth", "kind", "bin", side("l"), side("r"), side("n"))
    return c.groupBy("tree", "node").agg(F.min_by(side("t"), "feature").alias("totals"), F.min(F.when(worth, row)).alias("best"))


def search(hist: DataFrame, features: list[Feature], classes: int, categories: str, seed: int = 1, impurity: Impurity | None = None) -> dict[tuple[int, int], Found]:
    """Found of every (tree, node) of the histogram. What comes to the driver: a row a node, and the bins of a node's best
    categorical feature."""
    # The bins of categories are asked for once the best splits are known.
    again = any(f.categorical for f in features)
    hist = hist.persist() if again else hist
    try:
        best = best_splits(hist, features, classes, categories, seed, impurity)
        out: dict[tuple[int, int], Found] = {}
        wanted = []
        for r in best.collect():
            found = out[r["tree"], r["node"]] = Found(np.array(r["totals"]))
            if (b := r["best"]) is None:
                continue
            left, right, lost = (np.array(b[p]) for p in "lrn")
            found.feature, found.impurity, found.kind = b["feature"], b["impurity"], (NUMERIC, SUBSET, MULTIWAY)[b["kind"]]
            if found.kind == NUMERIC:
                alone = weight_of(right, classes) <= 0
                found.cut, found.parts = (0, [0 * left, left, lost]) if alone else (b["bin"] + 1, [left, right, lost])
            else:
                found.parts = [left, right, lost] if found.kind == SUBSET else None
                wanted.append((r["tree"], r["node"], b["feature"], b["nth"]))
        if wanted:
            few = hist.sparkSession.createDataFrame(wanted, "tree int, node int, feature int, upto int")
            rows = hist.join(F.broadcast(few), ["tree", "node", "feature"]).collect()
            cuts, own = {(t, n): upto for t, n, _, upto in wanted}, {}
            for r in rows:
                own.setdefault((r["tree"], r["node"]), []).append((r["bin"], np.array([r[s] for s in stats_names(classes)])))
            for (t, n), members in own.items():
                members.sort(key=lambda m: m[0])
                if out[t, n].kind == MULTIWAY:
                    out[t, n].members = [(b, s, i) for i, (b, s) in enumerate(members)]
                    continue
                bins, stats = np.array([b for b, _ in members], np.int64), np.stack([s for _, s in members])
                key = mean_of(stats, classes) if order_kind(categories, classes) == ORDERED else hashed_order(bins, seed, t, n)
                order = np.lexsort((bins, key))
                out[t, n].members = [(int(bins[i]), stats[i], int(place >= cuts[t, n])) for place, i in enumerate(order)]
        return out
    finally:
        if again:
            hist.unpersist()
