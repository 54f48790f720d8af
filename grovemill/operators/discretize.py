"""Values to bin ids, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemill.operators.binning import Bins, CategoryBins, NumericBins

#: Up to so many edges are a chain of comparisons, which stays in generated code; more are a filtered array.
CHAIN = 32


def bin_column(x: Column, bins: Bins) -> Column:
    """The bin id of a double. Of categories: errors for what is not an id below the cardinality."""
    if isinstance(bins, CategoryBins):
        wrong = x.isNull() | F.isnan(x) | (x != F.floor(x)) | (x < 0) | (x >= bins.cardinality)
        return F.when(wrong, F.raise_error(F.concat(F.lit("not a category id below "), F.lit(str(bins.cardinality)), F.lit(": "), F.coalesce(x.cast("string"), F.lit("null")))).cast("int")).otherwise(x.cast("int"))
    lost = x.isNull() | F.isnan(x)
    regular = search(x, bins)
    if bins.has_missing:
        return F.when(lost, F.lit(bins.regular)).otherwise(regular).cast("int")
    return F.when(lost, F.raise_error(F.lit("a missing value, but no bin for it")).cast("int")).otherwise(regular).cast("int")


def search(x: Column, bins: NumericBins) -> Column:
    edges = list(bins.edges)

    def half(low: int, high: int) -> Column:
        # How many edges are at most x: a balanced tree of comparisons, log2 deep for each row.
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x >= F.lit(edges[middle]), half(middle + 1, high)).otherwise(half(low, middle))

    if len(edges) <= CHAIN:
        return half(0, len(edges))
    # A block of edges first, then the edge within its slice: two short scans instead of one long one.
    step = CHAIN // 2
    heads = F.array(*[F.lit(e) for e in edges[::step]])
    block = F.size(F.filter(heads, lambda e: e <= x))
    inner = F.slice(F.array(*[F.lit(e) for e in edges]), F.greatest((block - 1) * step + 1, F.lit(1)), F.lit(step))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + F.size(F.filter(inner, lambda e: e <= x)))


def discretize(df: DataFrame, bins: dict[str, Bins], prefix: str = "b_") -> DataFrame:
    """df with a column of bin ids for each feature; smallint if ids fit."""
    kind = {f: "smallint" if b.cardinality <= 32_767 else "int" for f, b in bins.items()}
    return df.withColumns({f"{prefix}{f}": bin_column(F.col(f), b).cast(kind[f]) for f, b in bins.items()})
