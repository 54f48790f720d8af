"""Impurities, each over numpy arrays and as an expression. Any object with these two methods can take their place."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variances up to this, relative to the mean square, are zero: what is left of a pure node by rounding.
PURE = 1e-12


class Impurity(Protocol):
    """What splits lower: 0 for a pure node, above it otherwise. Both methods take statistics with weight, along the last axis
    of an array or as columns: in classification the weight of each class, in regression weight, weighted label and weighted
    square. Nodes without weight are asked for neither."""

    def values(self, s: np.ndarray) -> np.ndarray: ...
    def column(self, s: list[Column]) -> Column: ...


class Entropy:
    """In bits, over classes."""

    def values(self, s: np.ndarray) -> np.ndarray:
        p = s / s.sum(axis=-1, keepdims=True)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)

    def column(self, s: list[Column]) -> Column:
        w = reduce(add, s)
        return reduce(add, [F.when(c > 0, -(c / w) * F.log2(c / w)).otherwise(0.0) for c in s])


class Gini:
    """The chance that two draws from the node differ in class."""

    def values(self, s: np.ndarray) -> np.ndarray:
        p = s / s.sum(axis=-1, keepdims=True)
        return (p * (1 - p)).sum(axis=-1)

    def column(self, s: list[Column]) -> Column:
        w = reduce(add, s)
        return reduce(add, [(c / w) * (1 - c / w) for c in s])


class Variance:
    """Of a regression's label."""

    def values(self, s: np.ndarray) -> np.ndarray:
        square, mean = s[..., 2] / s[..., 0], s[..., 1] / s[..., 0]
        v = square - mean * mean
        return np.where(v <= PURE * np.maximum(1, square), 0.0, v)

    def column(self, s: list[Column]) -> Column:
        square, mean = s[2] / s[0], s[1] / s[0]
        v = square - mean * mean
        return F.when(v <= PURE * F.greatest(F.lit(1.0), square), 0.0).otherwise(v)


def usual(classes: int) -> Impurity:
    return Entropy() if classes else Variance()
