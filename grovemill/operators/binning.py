"""Bins of features: equal width from the summary, and three ways of segmenting a sample."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from dataclasses import dataclass
from enum import Enum
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemill.errors import CardinalityOverLimit, InvalidCategory
from grovemill.functions.scalars import key_uniform
from grovemill.operators.summary import FeatureSummary, LabelSummary, summarize

#: Bins of a feature at most.
WIDEST = 65_536


class Discretization(str, Enum):
    EQUAL_WIDTH = "equal_width"
    EQUAL_FREQUENCY = "equal_frequency"
    MIN_ENTROPY = "min_entropy"
    MIN_VARIANCE = "min_variance"


@dataclass(frozen=True)
class BinningOptions:
    kind: Discretization = Discretization.EQUAL_FREQUENCY
    most_bins: int = 256
    most_categories: int = 256
    hash_categories: bool = True
    sample: int = 5000
    #: A finder of the caller's own, in place of `kind`.
    finder: BinFinder | None = None


@dataclass(frozen=True)
class NumericBins:
    """Inner edges in order: bin i is [edges[i-1], edges[i]). Missing values have a bin of their own, after the others."""

    edges: tuple[float, ...]
    has_missing: bool = False

    @property
    def regular(self) -> int:
        return len(self.edges) + 1

    @property
    def missing(self) -> int | None:
        return self.regular if self.has_missing else None

    @property
    def cardinality(self) -> int:
        return self.regular + self.has_missing

    def find(self, x: float) -> int:
        if x != x:
            if not self.has_missing:
                raise ValueError("a missing value, but no bin for it")
            return self.regular
        return bisect_right(self.edges, x)


@dataclass(frozen=True)
class CategoryBins:
    """Bins are the category ids."""

    cardinality: int

    missing = None

    def find(self, x: float) -> int:
        if x != x or int(x) != x:
            raise InvalidCategory(f"{x} is not a category id")
        if not 0 <= x < self.cardinality:
            raise CardinalityOverLimit(f"category {int(x)} is not below {self.cardinality}")
        return int(x)


Bins = NumericBins | CategoryBins


class BinFinder(Protocol):
    def find(self, df: DataFrame, label: str, features: list[str], categorical: set[str], most: int, cardinality: int | None = None) -> tuple[LabelSummary, dict[str, Bins]]: ...


def equal_width(summary: FeatureSummary, most: int) -> NumericBins:
    regular = most - summary.has_nan
    if summary.least is None or summary.least == summary.most or regular < 2:
        return NumericBins((), summary.has_nan)
    width = (summary.most - summary.least) / regular
    inner = [summary.least + width * i for i in range(1, regular - 1)] + [summary.most - width]
    return NumericBins(tuple(sorted(inner)), summary.has_nan)


@dataclass(frozen=True)
class EqualWidth:
    def find(self, df, label, features, categorical, most, cardinality=None):
        own, of = summarize(df, label, features, cardinality)
        return own, {f: CategoryBins(int(s.most or 0) + 1) if f in categorical else equal_width(s, most) for f, s in of.items()}


def size_loss(y: np.ndarray, classes: int) -> float:
    return float(len(y))


def entropy_loss(y: np.ndarray, classes: int) -> float:
    p = np.bincount(y.astype(int), minlength=classes) / len(y)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def variance_loss(y: np.ndarray, classes: int) -> float:
    return float(np.mean(y * y) - np.mean(y) ** 2)


def prefix_losses(kind: str, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Losses of y[:i] and y[i:] for every i from 1 to len(y) - 1."""
    n = len(y)
    i = np.arange(1, n)
    if kind == "size":
        return i.astype(float), (n - i).astype(float)
    if kind == "variance":
        s, q = np.cumsum(y), np.cumsum(y * y)
        left = q[:-1] / i - (s[:-1] / i) ** 2
        return left, (q[-1] - q[:-1]) / (n - i) - ((s[-1] - s[:-1]) / (n - i)) ** 2
    hot = np.zeros((n, classes))
    hot[np.arange(n), y.astype(int)] = 1
    c = np.cumsum(hot, axis=0)

    def entropy(counts: np.ndarray) -> np.ndarray:
        p = counts / counts.sum(axis=1, keepdims=True)
        return -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)

    return entropy(c[:-1]), entropy(c[-1] - c[:-1])


LOSS = {"size": size_loss, "entropy": entropy_loss, "variance": variance_loss}


def divide(kind: str, x: np.ndarray, y: np.ndarray, classes: int, loss: float, exact: bool) -> tuple[float, float, int] | None:
    """The best cut of a sorted segment, and the losses of both sides; none if no cut is better than the whole.

    By default a cut is weighed with the side losses of the last cut that was taken (at first 0 and the whole's). The
    golden bins of equal frequency depend on that; exact weighs each cut with its own.
    """
    n = len(x)
    if n < 2:
        return None
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    left, right = prefix_losses(kind, y, classes)
    if exact:
        if not len(cuts):
            return None
        own = (left[cuts - 1] * cuts + right[cuts - 1] * (n - cuts)) / n
        k = int(own.argmin())
        return (float(left[cuts[k] - 1]), float(right[cuts[k] - 1]), int(cuts[k])) if own[k] < loss else None
    best, at, ll, rl = loss, 0, 0.0, loss
    for c in cuts.tolist():
        now = (ll * c + rl * (n - c)) / n
        if now < best:
            best, at, ll, rl = now, c, float(left[c - 1]), float(right[c - 1])
    return (ll, rl, at) if at else None


def segment(kind: str, x: np.ndarray, y: np.ndarray, most: int, has_missing: bool, classes: int = 0, exact: bool = False) -> NumericBins:
    """Halve segments of the sorted sample, first in first out, until there are `most` bins or none can be divided."""
    if not len(x):
        return NumericBins((), has_missing)
    whole, queue = [], deque([(LOSS[kind](y, classes), 0, len(x))])
    while queue and len(whole) + len(queue) < most - has_missing:
        loss, start, end = queue.popleft()
        found = divide(kind, x[start:end], y[start:end], classes, loss, exact)
        if found is None:
            whole.append((loss, start, end))
        else:
            left, right, at = found
            queue += [(left, start, start + at), (right, start + at, end)]
    starts = sorted(s for _, s, _ in [*whole, *queue])
    return NumericBins(tuple(float(x[s]) for s in starts if s), has_missing)


@dataclass(frozen=True)
class Segmenting:
    """Bins from a sample of about `sample` rows: by a hash of the integer column `key`, so the same rows however the table is
    partitioned; without a key by chance with the seed, which depends on partitions."""

    kind: str
    sample: int = 5000
    seed: int = 1
    exact: bool = False
    truncate_labels: bool = False
    key: str | None = None

    def find(self, df, label, features, categorical, most, cardinality=None):
        own, of = summarize(df, label, features, cardinality)
        if self.kind == "entropy" and not cardinality:
            raise ValueError("minimum entropy needs classes")
        numeric = [f for f in features if f not in categorical]
        out: dict[str, Bins] = {f: CategoryBins(int(of[f].most or 0) + 1) for f in features if f in categorical}
        if numeric:
            share = self.sample / max(own.total, 1)
            part = df if share >= 1 else df.sample(False, share, self.seed) if self.key is None else df.where(F.expr(key_uniform(self.key, self.seed, 501)) < share)
            # At most about `sample` rows: bounded by the option.
            rows = part.select(F.col(label).cast("double"), *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in numeric]).collect()
            table = np.array([tuple(r) for r in rows], float).reshape(len(rows), 1 + len(numeric))
            y = np.trunc(table[:, 0]) if self.truncate_labels else table[:, 0]
            for j, f in enumerate(numeric, 1):
                fine = ~np.isnan(table[:, j]) & ~np.isnan(y)
                order = np.lexsort((y[fine], table[fine, j]))
                out[f] = segment(self.kind, table[fine, j][order], y[fine][order], most, of[f].has_nan, cardinality or 0, self.exact)
        return own, {f: out[f] for f in features}


FINDERS = {
    Discretization.EQUAL_WIDTH: lambda sample, seed, key: EqualWidth(),
    Discretization.EQUAL_FREQUENCY: lambda sample, seed, key: Segmenting("size", sample, seed, key=key),
    Discretization.MIN_ENTROPY: lambda sample, seed, key: Segmenting("entropy", sample, seed, key=key),
    Discretization.MIN_VARIANCE: lambda sample, seed, key: Segmenting("variance", sample, seed, key=key),
}


def finder(options: BinningOptions, seed: int = 1, key: str | None = None) -> BinFinder:
    return options.finder or FINDERS[Discretization(options.kind)](options.sample, seed, key)
