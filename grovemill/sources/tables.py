"""Reading training tables, and the roles of their columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, MapType, StructType, TimestampNTZType, TimestampType

FORMATS = ("csv", "parquet", "avro")
#: What no encoder takes: convert it to a number first.
REFUSED = (ArrayType, MapType, StructType, BinaryType, BooleanType, DateType, TimestampType, TimestampNTZType)


@dataclass(frozen=True)
class Delimited:
    """Delimited text; of each option the first character counts."""

    delimiter: str = "\t"
    escape: str = "\\"
    quote: str = '"'
    header: bool = False


def read(spark: SparkSession, path: str, format: str = "csv", text: Delimited | None = None, schema: StructType | str | None = None, partitions: int | None = None) -> DataFrame:
    """A table. CSV without a schema is read twice, once to infer it."""
    if format not in FORMATS:
        raise ValueError(f"no format {format!r}; there are {FORMATS}")
    if format == "csv":
        t = text or Delimited()
        reader = spark.read.options(sep=t.delimiter[:1], quote=t.quote[:1], escape=t.escape[:1], header=t.header)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif format == "avro":
        try:
            df = (spark.read.schema(schema) if schema else spark.read).format("avro").load(path)
        except Exception as e:
            raise RuntimeError("Avro needs the spark-avro module on the class path") from e
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.repartition(partitions) if partitions else df


@dataclass(frozen=True)
class Roles:
    """Names of the label, the features and those of them that are categories."""

    label: str
    features: list[str]
    categorical: set[str]


def roles(df: DataFrame, label: int | str = 0, categorical: tuple = (), ignored: tuple = ()) -> Roles:
    """Columns may be given by index or name. Features are all columns but the label and the ignored ones, in order."""
    name = lambda c: df.columns[c] if isinstance(c, int) else c
    own, out, few = name(label), {name(c) for c in ignored}, {name(c) for c in categorical}
    if missing := ({own} | out | few) - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    if own in out:
        raise ValueError("the label can't be ignored")
    features = [c for c in df.columns if c != own and c not in out]
    if wrong := [f.name for f in df.schema if f.name in [own, *features] and isinstance(f.dataType, REFUSED)]:
        raise ValueError(f"columns that are neither numbers nor text: {wrong}")
    return Roles(own, features, few & {own, *features})
