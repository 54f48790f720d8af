"""Helpers that the corpus operators share: tables, the shared scratch folder, hot keys, prefix sums, bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters.
SPACES = " \t\n\x0b\x0c\r"
#: Of n rows, a key with more than n / HOT of them, and more than HOT_ROWS, is hot: so there are HOT such keys at most.
HOT, HOT_ROWS = 10_000, 512
#: Groups of a prefix sum that are summed up together.
BAND = 64

#: Folders written within the open scopes of `swept`.
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share (spark.checkpoint.dir). If none is set, a local master
    gets a temporary one; a cluster has no such folder, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="grovemill-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/grovemill-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[Callable[[DataFrame], tuple[DataFrame, str]]]:
    """A scope whose scratch folders are deleted at its end, but for what is written by the function that it gives.

    That function materializes a DataFrame beyond the scope, and returns it with its folder.
    """
    _scopes.append([])

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark)
        _scopes[-1].remove(path)
        return materialize(df, path), path

    try:
        yield keep
    finally:
        discard(spark, *_scopes.pop())


def materialize(df: DataFrame, path: str | None = None, codec: str = "zstd", options: dict[str, int] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and lost executors lose nothing. options: of the writer."""
    path = path or scratch(df.sparkSession)
    df.write.options(compression=codec, **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a name of ours."""
    return F.struct(*[column(c) for c in df.columns])


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's values, nulls and maps included."""

    def maps(t: DataType) -> bool:
        return isinstance(t, MapType) or (isinstance(t, ArrayType) and maps(t.elementType)) or (isinstance(t, StructType) and any(maps(f.dataType) for f in t))

    own = [F.to_json(F.struct(column(f.name))) if maps(f.dataType) else column(f.name) for f in df.schema]
    return F.xxhash64(*[x for c in own for x in (c.isNull(), c)])


def hot_keys(sizes: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame | None:
    """sizes: keys and n, the rows of each. The hot keys and into how many parts each is cut; None if no key is hot. A key
    of no more than `rows` rows (HOT_ROWS if not given) never is.

    At most HOT rows, since each has more than a HOT-th of all: so they are broadcast at any size of the input.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(rows or HOT_ROWS, total // HOT)
    hot = materialize(sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("parts_")))
    return None if hot.isEmpty() else hot


def join_hot(many: DataFrame, few: DataFrame, keys: list[str], sizes: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with few on keys, which are never null. few has a row or a handful for each key; many may have any number.

    sizes has keys and n, how many rows of many a key has. Rows of hot keys are dealt evenly over parts, and few's rows of
    these keys go to all the parts.
    """
    hot = hot_keys(sizes, keys)
    if hot is None:
        return many.join(few, keys, how)
    part = F.when(F.col("parts_").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("parts_"))).cast("int")
    left = many.join(F.broadcast(hot), keys, "left").withColumn("part_", part).drop("parts_")
    right = few.join(F.broadcast(hot), keys, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    return left.join(right, [*keys, "part_"], how).drop("part_")


def prefix_sums(df: DataFrame, by: list[str], coarse: str, exact: dict[str, Column], sums: dict[str, str], order: list[Column], tie: str | None = None, rows: int | None = None) -> DataFrame:
    """df with columns of sums (new name: column), each over the rows of `by` that come before a row in the order.

    The sums are two-level: over the groups of `coarse`, an integer that the order must follow, and within each. A hot group is
    cut by the columns of exact, which the order follows inside it; rows that agree in all of them, if there is a column
    tie of distinct numbers, must be equal in the order, and are cut by it. A group of up to `rows` rows is not hot. by and coarse are never null.
    """
    totals = [F.sum(c).alias(f"sum_{n}") for n, c in sums.items()]
    groups = materialize(df.groupBy(*by, coarse).agg(F.count("*").alias("n"), *totals))
    hot, cut = hot_keys(groups.select(*by, coarse, "n"), [*by, coarse], rows), []
    if hot is not None:
        cold = F.col("parts_").isNull()
        df = df.join(F.broadcast(hot), [*by, coarse], "left").withColumns({f"exact_{n}": F.when(~cold, c) for n, c in exact.items()})
        cut = [f"exact_{n}" for n in exact]
        if tie:
            df, cut = df.withColumn("part_", F.when(~cold, F.pmod(F.col(tie), F.col("parts_")))), [*cut, "part_"]
        # What a group has in these columns is one value, so a join needs it once, and without nulls: as text.
        df = df.withColumn("cut_", F.coalesce(F.to_json(F.struct(*cut)), F.lit(""))).drop("parts_")
        groups = df.groupBy(*by, coarse, *cut, "cut_").agg(*totals)
    # The groups' own sums are two-level again, so those of one hot value of `by` don't meet in one task either.
    groups = groups.withColumn("band", F.floor(F.col(coarse) / BAND))
    over, across = Window.partitionBy(*by, "band").orderBy(coarse, *cut), Window.partitionBy(*by).orderBy("band")
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = groups.groupBy(*by, "band").agg(*[F.sum(f"sum_{n}").alias(f"sum_{n}") for n in sums]).select(*by, "band", *[earlier(across, f"sum_{n}").alias(f"base_{n}") for n in sums])
    keys = [*by, coarse, *(["cut_"] if cut else [])]
    begins = groups.select(*keys, "band", *[earlier(over, f"sum_{n}").alias(f"begin_{n}") for n in sums]).join(bands, [*by, "band"]).select(*keys, *[(F.col(f"begin_{n}") + F.col(f"base_{n}")).alias(f"begin_{n}") for n in sums])
    within = Window.partitionBy(*keys).orderBy(*order)
    out = df.join(begins, keys).withColumns({n: F.col(f"begin_{n}") + earlier(within, c) for n, c in sums.items()})
    return out.drop(*[f"begin_{n}" for n in sums], *cut, "cut_")


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: a fifth of all identifiers."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges with about `most` bytes of the column each; a longer value stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null is the empty text."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
