"""One-pass data summary, and what it says about the label."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemill.errors import InvalidLabel


@dataclass(frozen=True)
class LabelSummary:
    """counts of the classes 0, 1, ...; rest: all other labels, which are all in regression."""

    counts: tuple[int, ...]
    rest: int
    mean: float | None
    mean_square: float | None

    @property
    def total(self) -> int:
        return sum(self.counts) + self.rest


@dataclass(frozen=True)
class FeatureSummary:
    """least and most are None if no value is a number."""

    has_nan: bool
    least: float | None
    most: float | None


def summary_frame(df: DataFrame, label: str, features: list[str], cardinality: int | None = None) -> DataFrame:
    """One row: label counts and moments, and of each feature the NaN flag and the range of the other values.

    Nulls are NaN. NaN is the largest double, so every range leaves it out.
    """
    y = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))
    known = [F.count_if(y == F.lit(float(k))).alias(f"class_{k}") for k in range(cardinality or 0)]
    other = F.count_if(~y.isin([float(k) for k in range(cardinality)])) if cardinality else F.count("*")
    columns = [*known, other.alias("rest"), F.avg(y).alias("mean"), F.avg(y * y).alias("mean_square"), F.coalesce(F.bool_or(F.isnan(y)), F.lit(False)).alias("label_nan")]
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))
        columns += [F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)).alias(f"{f}_nan"), F.min(F.when(~F.isnan(x), x)).alias(f"{f}_least"), F.max(F.when(~F.isnan(x), x)).alias(f"{f}_most")]
    return df.agg(*columns)


def summarize(df: DataFrame, label: str, features: list[str], cardinality: int | None = None) -> tuple[LabelSummary, dict[str, FeatureSummary]]:
    row = summary_frame(df, label, features, cardinality).first()
    if row["label_nan"]:
        raise InvalidLabel(f"{label} is missing in some row")
    own = LabelSummary(tuple(row[f"class_{k}"] for k in range(cardinality or 0)), row["rest"], row["mean"], row["mean_square"])
    return own, {f: FeatureSummary(row[f"{f}_nan"], row[f"{f}_least"], row[f"{f}_most"]) for f in features}


def validate_label(summary: LabelSummary, cardinality: int | None) -> None:
    """Classes must be all there, and nothing else; a label that hardly varies is only warned of."""
    if cardinality:
        if summary.rest:
            raise InvalidLabel(f"{summary.rest} labels are not classes below {cardinality}")
        if missing := [k for k, n in enumerate(summary.counts) if not n]:
            raise InvalidLabel(f"no row has the classes {missing}")
    elif summary.mean is not None and summary.mean_square - summary.mean**2 < 1e-19:
        logging.getLogger(__name__).warning("the label does not vary")
