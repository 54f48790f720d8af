"""Bags, train and validation rows, reservoir samples and order statistics. All randomness is a hash of a row's key."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemill.functions.scalars import key_uniform, poisson_count


def bag_count(key: str, tree: int, rate: float, replace: bool = False, seed: int = 1) -> Column:
    """How often a row is in a tree's bag: 0 or 1, or a Poisson count up to 127 with replacement."""
    u = key_uniform(key, seed, tree + 1)
    return F.expr(poisson_count(u, rate) if replace else f"(case when {u} <= {rate} then 1 else 0 end)")


def is_training(key: str, fraction: float, seed: int = 1) -> Column:
    return F.expr(f"({key_uniform(key, seed, 0)} < {fraction})") if fraction < 1 else F.lit(True)


def reservoir(df: DataFrame, size: int, key: str, seed: int = 1) -> DataFrame:
    """size rows by chance: those with the smallest hashes. Mergeable: the reservoir of a union is that of the reservoirs."""
    order = F.expr(key_uniform(key, seed, 977))
    return df.orderBy(order, F.col(key) if key in df.columns else F.expr(key)).limit(size)


class Reservoir:
    """The same over a stream of single values, by algorithm R."""

    def __init__(self, size: int, seed: int = 1) -> None:
        self.size, self.seen, self.sample, self.chance = size, 0, [], random.Random(seed)

    def add(self, x: float) -> None:
        self.seen += 1
        if len(self.sample) < self.size:
            self.sample.append(x)
        elif (k := self.chance.randrange(self.seen)) < self.size:
            self.sample[k] = x

    def merge(self, other: Reservoir) -> Reservoir:
        """Draws each place from one of the two in proportion to what they have seen, without replacement."""
        mine, theirs = list(self.sample), list(other.sample)
        self.chance.shuffle(mine)
        self.chance.shuffle(theirs)
        a, b, out = self.seen, other.seen, []
        while len(out) < self.size and (mine or theirs):
            take = bool(mine) and (not theirs or self.chance.random() * (a + b) < a)
            out.append((mine if take else theirs).pop())
            a, b = a - take, b - (not take)
        self.seen, self.sample = self.seen + other.seen, out
        return self


def kth(df: DataFrame, column: str, k: int) -> DataFrame:
    """value: the k-th smallest, from 0; no row if there are no more than k."""
    found = order_statistics(df, column, lambda n: k)
    return df.sparkSession.createDataFrame([(v,) for v in found.values()], "value double")


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """value: the element n div 2 of the n sorted values; no row if there are none."""
    return df.sparkSession.createDataFrame([(v,) for v in order_statistics(df, column).values()], "value double")


#: Buckets of a group in each round of the search for an order statistic.
BUCKETS = 512


def order_statistics(df: DataFrame, value: str, place: Callable[[int], int] = lambda n: n // 2, group: str | None = None) -> dict[int | None, float]:
    """Of each group the value at place(n) of its n sorted values, from 0. Groups without such a place are left out.

    Exact, by rounds: each counts the values between the bounds known so far in equal buckets and goes on in the bucket that
    has the place, until its values are equal. A round is one aggregate over numbers, of at most groups x BUCKETS rows; no
    values are sorted, and no group meets in one task. value: a column of finite doubles, nulls left out; group: integers.
    """
    rows = df.select((F.col(group) if group else F.lit(0)).cast("bigint").alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    out: dict[int | None, float] = {}
    # Of each open group: the place among the values from low to high.
    bounds: dict[int, tuple[int, float, float]] = {}

    def narrow(g: int, k: int, low: float, high: float) -> None:
        if low == high:
            out[g if group else None] = low
        else:
            bounds[g] = (k, low, high)

    for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        if 0 <= (k := place(r["n"])) < r["n"]:
            narrow(r["g"], k, r["low"], r["high"])
    while bounds:
        table = df.sparkSession.createDataFrame([(g, low, high) for g, (_, low, high) in bounds.items()], "g bigint, low double, high double")
        # Halves, so that the width of no range overflows. The ends fall into the first and the last bucket: every round narrows.
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        inside = rows.join(F.broadcast(table) if len(bounds) <= 500_000 else table, "g").where("v between low and high")
        counts = inside.groupBy("g", F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        by: dict[int, list] = {}
        for r in counts.collect():
            by.setdefault(r["g"], []).append((r["b"], r["n"], r["low"], r["high"]))
        last, bounds = bounds, {}
        for g, found in by.items():
            k = last[g][0]
            for _, n, low, high in sorted(found):
                if k < n:
                    narrow(g, k, low, high)
                    break
                k -= n
    return out
