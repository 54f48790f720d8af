"""Loss functions. Each has its SQL text, for expressions and aggregates over y (label), f (raw prediction) and w (weight),
and the same in numpy, for passes that already hold arrays. A new loss is a subclass that is given to `register`."""

from __future__ import annotations

from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemill.functions.scalars import clamped_exp, clamped_log, ratio, sigmoid
from grovemill.operators.sampling import order_statistics

LOW, HIGH = 1e-15, 1 - 1e-15


class Loss:
    """cardinality: classes that the label must have, or None. refinable: leaves are estimated anew after growing."""

    name: ClassVar[str]
    cardinality: ClassVar[int | None] = None
    refinable: ClassVar[bool] = True

    # SQL text -----------------------------------------------------------------------------------------------------
    def gradient_sql(self, y: str = "y", f: str = "f") -> str:
        raise NotImplementedError

    def deviance_sql(self, y: str = "y", f: str = "f", w: str = "w") -> str:
        raise NotImplementedError

    def initial_sql(self, y: str = "y", w: str = "w") -> str:
        return ratio(f"sum({w} * {y})", f"sum({w})")

    def estimate_sql(self, y: str = "y", f: str = "f", w: str = "w") -> str:
        raise NotImplementedError(f"{self.name} does not estimate leaves anew")

    def mean_sql(self, f: str = "f") -> str:
        return f

    # Columns ------------------------------------------------------------------------------------------------------
    def gradient(self, y: str = "y", f: str = "f") -> Column:
        return F.expr(self.gradient_sql(y, f))

    def deviance(self, y: str = "y", f: str = "f", w: str = "w") -> Column:
        return F.expr(self.deviance_sql(y, f, w))

    def initial(self, y: str = "y", w: str = "w") -> Column:
        return F.expr(self.initial_sql(y, w))

    def estimate(self, y: str = "y", f: str = "f", w: str = "w") -> Column:
        return F.expr(self.estimate_sql(y, f, w))

    def mean(self, f: str = "f") -> Column:
        return F.expr(self.mean_sql(f))

    # numpy: gradients, and sums over rows that add up over partitions ------------------------------------------------
    def gradients(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def deviances(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The deviance is the mean of these."""
        raise NotImplementedError

    def means(self, f: np.ndarray) -> np.ndarray:
        return f

    # Over DataFrames ----------------------------------------------------------------------------------------------
    def initial_of(self, rows: DataFrame) -> float:
        """rows: y, w."""
        return float(rows.agg(self.initial().alias("v")).first()["v"])

    def estimates_of(self, rows: DataFrame) -> dict[int, float]:
        """Of each node its estimate; rows: node, y, f, w. A row a node returns."""
        return {r["node"]: r["v"] for r in rows.where("w > 0").groupBy("node").agg(self.estimate().alias("v")).collect()}


class Gaussian(Loss):
    name, refinable = "gaussian", False

    def gradient_sql(self, y="y", f="f"):
        return f"({y} - {f})"

    def deviance_sql(self, y="y", f="f", w="w"):
        return ratio(f"sum({w} * ({y} - {f}) * ({y} - {f}))", f"sum({w})")

    def gradients(self, y, f):
        return y - f

    def deviances(self, y, f):
        return (y - f) ** 2


class Laplacian(Loss):
    """Medians are the upper ones of the rows with weight, however often a row is drawn. Their SQL text gathers a group's
    values in one task; training finds them by rounds of counting."""

    name = "laplacian"

    def gradient_sql(self, y="y", f="f"):
        return f"cast(sign({y} - {f}) as double)"

    def deviance_sql(self, y="y", f="f", w="w"):
        return ratio(f"sum({w} * abs({y} - {f}))", f"sum({w})")

    def initial_sql(self, y="y", w="w"):
        return f"percentile_disc(0.5) within group (order by {y} desc) filter (where {w} > 0)"

    def estimate_sql(self, y="y", f="f", w="w"):
        return f"percentile_disc(0.5) within group (order by ({y} - {f}) desc) filter (where {w} > 0)"

    def initial_of(self, rows):
        return order_statistics(rows.where("w > 0"), "y")[None]

    def estimates_of(self, rows):
        return order_statistics(rows.where("w > 0").selectExpr("node", "y - f as rest"), "rest", group="node")

    def gradients(self, y, f):
        return np.sign(y - f)

    def deviances(self, y, f):
        return np.abs(y - f)


class Poisson(Loss):
    name = "poisson"

    def gradient_sql(self, y="y", f="f"):
        return f"({y} - {clamped_exp(f)})"

    def deviance_sql(self, y="y", f="f", w="w"):
        return ratio(f"-2e0 * (sum({w} * {y} * {f}) - sum({w} * {clamped_exp(f)}))", f"sum({w})")

    def initial_sql(self, y="y", w="w"):
        return clamped_log(ratio(f"sum({w} * {y})", f"sum({w})"))

    def estimate_sql(self, y="y", f="f", w="w"):
        return clamped_log(ratio(f"sum({w} * {y})", f"sum({w} * {clamped_exp(f)})"))

    def mean_sql(self, f="f"):
        return clamped_exp(f)

    def gradients(self, y, f):
        return y - np.exp(np.clip(f, -19, 19))

    def deviances(self, y, f):
        return -2 * (y * f - np.exp(np.clip(f, -19, 19)))

    def means(self, f):
        return np.exp(np.clip(f, -19, 19))


class Binary(Loss):
    """Labels 0 and 1. The initial value is a clamped log of the odds, times `odds`."""

    cardinality, odds = 2, "1e0"

    def initial_sql(self, y="y", w="w"):
        up, down = f"sum({w} * {y})", f"(sum({w}) - sum({w} * {y}))"
        return f"({self.odds} * case when {down} = 0 then 1.9e1 else {clamped_log(ratio(up, down))} end)"


class LogLoss(Binary):
    name = "logloss"

    def p(self, f: str) -> str:
        return sigmoid(f, repr(LOW), f"(1e0 - {LOW!r})")

    def probability(self, f):
        return np.clip(1 / (1 + np.exp(-f)), LOW, HIGH)

    def gradient_sql(self, y="y", f="f"):
        return f"({y} - {self.p(f)})"

    def deviance_sql(self, y="y", f="f", w="w"):
        return ratio(f"sum({w} * -({y} * ln({self.p(f)}) + (1 - {y}) * ln(1 - {self.p(f)})))", f"sum({w})")

    def estimate_sql(self, y="y", f="f", w="w"):
        p = self.p(f)
        return ratio(f"sum({w} * {y}) - sum({w} * {p})", f"sum({w} * {p}) - sum({w} * {p} * {p})")

    def mean_sql(self, f="f"):
        return self.p(f)

    def means(self, f):
        return self.probability(f)

    def gradients(self, y, f):
        return y - self.probability(f)

    def deviances(self, y, f):
        p = self.probability(f)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p))


class Exponential(Binary):
    name, odds = "adaboost", "0.5e0"

    def gradient_sql(self, y="y", f="f"):
        return f"((2 * {y} - 1) * exp(-(2 * {y} - 1) * {f}))"

    def deviance_sql(self, y="y", f="f", w="w"):
        return ratio(f"sum({w} * exp(-(2 * {y} - 1) * {f}))", f"sum({w})")

    def estimate_sql(self, y="y", f="f", w="w"):
        return ratio(f"sum({w} * (2 * {y} - 1) * exp(-(2 * {y} - 1) * {f}))", f"sum({w} * exp(-(2 * {y} - 1) * {f}))")

    def mean_sql(self, f="f"):
        return sigmoid(f"2 * {f}", repr(LOW), f"(1e0 - {LOW!r})")

    def means(self, f):
        return np.clip(1 / (1 + np.exp(-2 * f)), LOW, HIGH)

    def gradients(self, y, f):
        return (2 * y - 1) * self.deviances(y, f)

    def deviances(self, y, f):
        return np.exp(-(2 * y - 1) * f)


class TruncatedHinge(Binary):
    """most: the largest probability; margin: how far beyond 0 a row still counts."""

    name, refinable, most, margin = "hinge", False, 0.9, 0.12

    @property
    def cap(self) -> float:
        return float(np.log(self.most / (1 - self.most)))

    def gradient_sql(self, y="y", f="f"):
        e, m = f"{self.margin!r}e0", f"{self.cap!r}e0"
        return f"({y} * (case when {e} - {f} > 0 and {e} - {f} <= {m} then 1 else 0 end) - (1 - {y}) * (case when {f} + {e} > 0 and {f} + {e} <= {m} then 1 else 0 end))"

    def deviance_sql(self, y="y", f="f", w="w"):
        e, m = f"{self.margin!r}e0", f"{self.cap!r}e0"
        return ratio(f"sum({w} * ({y} * least(greatest({e} - {f}, 0e0), {m}) + (1 - {y}) * least(greatest({f} + {e}, 0e0), {m})))", f"sum({w})")

    def mean_sql(self, f="f"):
        return sigmoid(f, f"{1 - self.most!r}e0", f"{self.most!r}e0")

    def means(self, f):
        return np.clip(1 / (1 + np.exp(-f)), 1 - self.most, self.most)

    def gradients(self, y, f):
        a, b = self.margin - f, self.margin + f
        return y * ((a > 0) & (a <= self.cap)) - (1 - y) * ((b > 0) & (b <= self.cap))

    def deviances(self, y, f):
        return y * np.clip(self.margin - f, 0, self.cap) + (1 - y) * np.clip(self.margin + f, 0, self.cap)


LOSSES: dict[str, Loss] = {}


def register(loss: Loss) -> Loss:
    LOSSES[loss.name] = loss
    return loss


for _kind in (Gaussian, Laplacian, Poisson, LogLoss, Exponential, TruncatedHinge):
    register(_kind())


def loss_named(name: str | Loss) -> Loss:
    if isinstance(name, Loss):
        return name
    if name not in LOSSES:
        raise ValueError(f"no loss {name!r}; there are {sorted(LOSSES)}")
    return LOSSES[name]
