"""Categorical encoders: capped distinct values, dictionaries, hash buckets, and their replay on new rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemill.errors import CardinalityOverLimit
from grovemill.functions.scalars import category, number, quoted, string_hash_bucket

#: Dictionaries beyond this size are joined, not written into the expression.
LITERALS = 2000
#: Dictionaries up to this size are broadcast (some tens of MB); larger ones are joined by shuffling.
BROADCAST = 500_000


def distinct_values(df: DataFrame, names: list[str], most: int) -> dict[str, list[str]]:
    """Distinct strings of each column in order, at most `most` + 1 of them: enough to tell that there are too many."""
    return {n: sorted(r[0] for r in df.select(category(n).alias("v")).distinct().limit(most + 1).collect()) for n in names}


def dictionary(values: list[str], use_empty: bool = True) -> dict[str, int]:
    """Value to index in lexicographic order."""
    return {v: i for i, v in enumerate(v for v in sorted(values) if use_empty or v != "")}


@dataclass(frozen=True)
class Encoder:
    """How a column becomes a number: as it is, by a dictionary, or by hash buckets."""

    name: str
    mapping: dict[str, int] | None = None
    buckets: int | None = None
    unseen: str = field(default="null", compare=False)

    def column(self) -> Column:
        """The encoded column, double. Unseen values are null (NaN after discretizing: the heaviest child), or an error."""
        if self.buckets is not None:
            return F.expr(string_hash_bucket(f"coalesce(cast(`{self.name}` as string), '')", self.buckets)).cast("double")
        if self.mapping is None:
            return number(self.name)
        found = F.try_element_at(F.create_map(*[x for k, v in self.mapping.items() for x in (F.lit(k), F.lit(float(v)))]), category(self.name)) if self.mapping else F.lit(None).cast("double")
        if self.unseen == "error":
            return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unseen category of {self.name}: "), category(self.name))).cast("double"))
        return found

    @property
    def joined(self) -> bool:
        """Whether the dictionary is too large for an expression."""
        return self.mapping is not None and len(self.mapping) > LITERALS and self.unseen != "error"

    def encode(self, df: DataFrame, out: str) -> DataFrame:
        """df with the encoded column."""
        own = [quoted(c) for c in df.columns if c != out]
        return encode_all(df, [self], own, [out])

    @property
    def cardinality(self) -> int | None:
        return self.buckets if self.buckets is not None else None if self.mapping is None else len(self.mapping)


def encode_all(df: DataFrame, encoders: list[Encoder], carried: list[Column], names: list[str] | None = None) -> DataFrame:
    """The carried columns, then each encoder's, named x_0, x_1, ... if no names are given. Large dictionaries are joined,
    by broadcasting if they have up to BROADCAST values."""
    names = names or [f"x_{j}" for j in range(len(encoders))]
    wide = [(j, e) for j, e in enumerate(encoders) if e.joined]
    out = df.select(*carried, *[category(e.name).alias(f"key of {n}") if e.joined else e.column().alias(n) for n, e in zip(names, encoders, strict=True)])
    for j, e in wide:
        rows = df.sparkSession.createDataFrame([(k, float(v)) for k, v in e.mapping.items()], f"`key of {names[j]}` string, `{names[j]}` double")
        out = out.join(F.broadcast(rows) if len(e.mapping) <= BROADCAST else rows, f"key of {names[j]}", "left")
    kept = len(carried)
    return out if not wide else out.select(*[quoted(c) for c in out.columns if c not in names and not c.startswith("key of ")][:kept], *[quoted(n) for n in names])


def encoders(df: DataFrame, numeric: list[str], categorical: list[str], most: int, hashing: bool) -> list[Encoder]:
    """One encoder a column. Beyond `most` categories a column is hashed, or refused."""
    out = [Encoder(n) for n in numeric]
    for name, values in distinct_values(df, categorical, most).items():
        if len(values) <= most:
            out.append(Encoder(name, mapping=dictionary(values)))
        elif hashing:
            out.append(Encoder(name, buckets=most))
        else:
            raise CardinalityOverLimit(f"{name} has more than {most} categories")
    return out
