"""Scalar expressions as SQL text that Spark and DuckDB read alike, and as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logarithms and exponents are held within these bounds.
BOUND = "1.9e1"


def clamped_exp(x: str) -> str:
    return f"exp(least(greatest(({x}), -{BOUND}), {BOUND}))"


def clamped_log(x: str) -> str:
    """The lower bound at 0, NaN below, null for null."""
    return f"(case when ({x}) = 0 then -{BOUND} when ({x}) < 0 then cast('NaN' as double) else least(greatest(ln(({x})), -{BOUND}), {BOUND}) end)"


def ratio(a: str, b: str) -> str:
    """a / b; null where b is 0."""
    return f"(({a}) / nullif(({b}), 0))"


def sigmoid(x: str, low: str, high: str) -> str:
    return f"least(greatest(1e0 / (1e0 + exp(-({x}))), {low}), {high})"


def string_hash_bucket(value: str, buckets: int) -> str:
    """The 31-polynomial string hash of 32-bit wrap-around, shifted to be positive, modulo buckets. For text in the basic plane."""
    h = f"aggregate(filter(split({value}, ''), c -> c <> ''), cast(0 as bigint), (a, c) -> (a * 31 + ascii(c)) % 4294967296)"
    return f"((({h}) + 2147483648) % 4294967296) % {buckets}"


def key_uniform(key: str, seed: int, stream: int = 0) -> str:
    """Between 0 and 1 from an integer key, modulo a prime; the same in both engines. The square keeps streams from being
    shifted copies of one another."""
    prime = 2147483647
    start = (seed * 69069 + stream * 362437 + 12345) % prime
    one = f"((((({key}) % {prime}) + {prime}) % {prime}) * 48271 + {start}) % {prime}"
    two = f"(({one}) * (({one}) + {(start * 31 + 7) % prime})) % {prime}"
    return f"(cast(({two}) * 16807 % {prime} as double) / {float(prime)!r})"


def poisson_count(uniform: str, rate: float, most: int = 127) -> str:
    """A Poisson count by its inverse distribution, at most 127."""
    import math

    mass = total = math.exp(-rate)
    cases, k = [], 0
    while total < 1 - 1e-5 and k < most:
        cases.append(f"when ({uniform}) <= {total!r}e0 then {k}" if "e" not in repr(total) else f"when ({uniform}) <= {total!r} then {k}")
        k += 1
        mass *= rate / k
        total += mass
    return f"(case {' '.join(cases)} else {k} end)"


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """A numeric column as double; null is NaN."""
    return F.coalesce(quoted(name).cast("double"), F.lit(float("nan")))


def category(name: str) -> Column:
    """A categorical column as string; null is the empty string."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))
