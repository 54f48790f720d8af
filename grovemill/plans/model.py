"""Trained ensembles: scoring as expressions or over node arrays, importance, and their files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import count, takewhile
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemill.functions.encoders import Encoder, encode_all
from grovemill.functions.losses import Loss, loss_named
from grovemill.functions.scalars import quoted
from grovemill.operators.binning import CategoryBins, NumericBins
from grovemill.plans.trees import Feature, Flat, Node, Tree, codes

#: Ensembles of up to so many nodes are scored as expressions; larger ones by walking node arrays.
EXPRESSION_NODES = 300


def bins_of(row: dict) -> NumericBins | CategoryBins:
    return CategoryBins(row["cardinality"]) if row["edges"] is None else NumericBins(tuple(row["edges"]), row["missing"])


def described(features: list[Feature], encoders: list[Encoder]) -> list[dict]:
    return [
        {"name": f.name, "edges": None if f.categorical else list(f.bins.edges), "missing": f.bins.missing is not None, "cardinality": f.bins.cardinality, "mapping": e.mapping, "buckets": e.buckets, "unseen": e.unseen}
        for f, e in zip(features, encoders, strict=True)
    ]


def label_of(meta: dict) -> Encoder | None:
    return Encoder(meta["label"]["name"], meta["label"]["mapping"], unseen="error") if meta.get("label") else None


def others(df: DataFrame, *outputs: str | None) -> list[Column]:
    """The columns of df from the struct row, without those that the outputs replace."""
    new = {o.lower() for o in outputs if o}
    return [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in new]


class Ensemble:
    """features, and the encoder of each; trees over their bins. label: what the label was called, and the numbers of its
    values if it was categorical."""

    features: list[Feature]
    encoders: list[Encoder]
    trees: list[Tree]
    label: Encoder | None

    def encoded(self, df: DataFrame) -> DataFrame:
        """row, a struct of df's columns, so that no name of theirs meets one of ours, and the encoded features x_0, x_1, ..."""
        return encode_all(df, self.encoders, [F.struct(*[quoted(c) for c in df.columns]).alias("row")])

    def tree_column(self, tree: Tree, value: Callable[[Node], float]) -> Column:
        return tree.on_values(self.features, lambda n: F.lit(float(value(n))), lambda j: F.col(f"x_{j}"))

    def walked(self, trees: list[Tree], combine: Callable[[np.ndarray], np.ndarray], kind: str, value: Callable[[Node], float] | None = None) -> Column:
        """combine(values of trees by rows) over Arrow batches of the encoded columns."""
        features, flats = self.features, [Flat(t, self.features, value) for t in trees]

        @F.pandas_udf(kind)
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                bins = codes(features, [p.to_numpy(np.float64) for p in part])
                yield pd.Series(list(combine(np.stack([f.value[f.walk(bins)] for f in flats]))))

        return score(*[F.coalesce(F.col(f"x_{j}"), F.lit(float("nan"))) for j in range(len(features))])

    def importance(self) -> list[tuple[str, float]]:
        """Features by what their splits took from the impurity, over all trees; ties in the order of features."""
        total = sum((t.importance(len(self.features)) for t in self.trees), np.zeros(len(self.features)))
        return [(self.features[j].name, float(total[j])) for j in np.argsort(-total, kind="stable")]

    def importance_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.importance(), "feature string, importance double")

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, *row) for t, tree in enumerate(self.trees) for row in tree.rows()], "tree int, " + Tree.SCHEMA)

    def dump(self) -> str:
        return "\n".join(f"tree {t}\n{tree.dump([f.name for f in self.features])}" for t, tree in enumerate(self.trees))

    def metadata(self) -> dict:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        """A folder with the nodes as Parquet and everything else as one JSON row."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        self.describe(spark, path)

    def describe(self, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
        """The JSON row of save."""
        label = self.label and {"name": self.label.name, "mapping": self.label.mapping}
        text = json.dumps({**self.metadata(), "kind": type(self).__name__, "trees": len(self.trees), "label": label, "features": described(self.features, self.encoders)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/metadata")


class TreeWriter(Protocol):
    """Who takes trees as a training run makes them: begin comes with the model before its first tree, end with the whole one."""

    def begin(self, model: Ensemble) -> None: ...
    def tree(self, number: int, tree: Tree) -> None: ...
    def end(self, model: Ensemble) -> None: ...


class TreeFolder:
    """Writes each tree below path once it is grown, so what a lost driver had grown stays; `load` reads the folder at any time,
    with the trees up to the first that is missing. A folder that holds a model is refused."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def begin(self, model: Ensemble) -> None:
        model.describe(self.spark, self.path, "errorifexists")
        self.append([])

    def append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, "tree int, " + Tree.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/nodes")

    def tree(self, number: int, tree: Tree) -> None:
        self.append([(number, *row) for row in tree.rows()])

    def end(self, model: Ensemble) -> None:
        model.describe(self.spark, self.path)


def load(spark: SparkSession, path: str) -> Ensemble:
    """A saved model, or what a TreeFolder holds of one."""
    meta = json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()[0])
    rows: dict[int, list] = {}
    for r in spark.read.schema("tree int, " + Tree.SCHEMA).parquet(f"{path}/nodes").collect():
        rows.setdefault(r["tree"], []).append(r)
    rows = {t: rows[t] for t in takewhile(rows.__contains__, count())}
    features = [Feature(f["name"], bins_of(f)) for f in meta["features"]]
    encoders = [Encoder(f["name"], f["mapping"], f["buckets"], f["unseen"]) for f in meta["features"]]
    trees = [Tree.of_rows(own) for own in rows.values()]
    kinds = {"BoostedTrees": BoostedTrees, "RandomForest": RandomForest}
    return kinds[meta["kind"]].of(features, encoders, trees, meta)


@dataclass
class BoostedTrees(Ensemble):
    """train_deviance, validation_deviance: before the first tree, and after each. best: the number of trees with the lowest
    validation deviance (all, without validation rows)."""

    features: list[Feature]
    encoders: list[Encoder]
    trees: list[Tree]
    loss: Loss
    initial: float
    shrinkage: float
    train_deviance: list[float] = field(default_factory=list)
    validation_deviance: list[float] = field(default_factory=list)
    best: int = 0
    label: Encoder | None = None

    def metadata(self) -> dict:
        return {"loss": self.loss.name, "initial": self.initial, "shrinkage": self.shrinkage, "train_deviance": self.train_deviance, "validation_deviance": self.validation_deviance, "best": self.best}

    @staticmethod
    def of(features, encoders, trees, meta) -> BoostedTrees:
        return BoostedTrees(features, encoders, trees, loss_named(meta["loss"]), meta["initial"], meta["shrinkage"], meta["train_deviance"], meta["validation_deviance"], meta["best"], label_of(meta))

    def transform(self, df: DataFrame, output: str = "prediction", raw: str | None = None, best_only: bool = False) -> DataFrame:
        """df with the prediction, and if wanted the raw sum. Without state, so also for streams.

        Columns of df that have the names of the outputs, in any case, are replaced; all others stay as they are. Ensembles
        of up to EXPRESSION_NODES nodes are scored by expressions, larger ones over Arrow batches, with equal results.
        """
        trees = self.trees[: self.best] if best_only else self.trees
        start, step = self.initial, self.shrinkage
        if sum(len(t.nodes) for t in trees) <= EXPRESSION_NODES:
            total = sum((self.tree_column(t, lambda n: n.prediction) * step for t in trees), F.lit(start))
        else:
            total = self.walked(trees, lambda v: start + step * v.sum(axis=0), "double")
        out = self.encoded(df).select("row", total.alias("raw"))
        return out.select(*others(df, output, raw), *([F.col("raw").alias(raw)] if raw else []), self.loss.mean("raw").alias(output))

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(i, d, self.validation_deviance[i] if self.validation_deviance else None) for i, d in enumerate(self.train_deviance)]
        return spark.createDataFrame(rows, "trees int, train_deviance double, validation_deviance double")


@dataclass
class RandomForest(Ensemble):
    """classes: 0 for regression. sample_counts: the weight of each tree's bag."""

    features: list[Feature]
    encoders: list[Encoder]
    trees: list[Tree]
    classes: int = 0
    label: Encoder | None = None

    def metadata(self) -> dict:
        return {"classes": self.classes}

    @staticmethod
    def of(features, encoders, trees, meta) -> RandomForest:
        return RandomForest(features, encoders, trees, meta["classes"], label_of(meta))

    @property
    def sample_counts(self) -> list[int]:
        return [int(t.nodes[1].weight) for t in self.trees]

    def values(self, df: DataFrame, output: str = "values") -> DataFrame:
        """df with the array of the trees' predictions, in place of a column of that name."""
        if sum(len(t.nodes) for t in self.trees) <= EXPRESSION_NODES:
            every = F.array(*[self.tree_column(t, lambda n: n.prediction) for t in self.trees])
        else:
            every = self.walked(self.trees, lambda v: v.T, "array<double>")
        return self.encoded(df).select(*others(df, output), every.alias(output))

    def transform(self, df: DataFrame) -> DataFrame:
        """Regression: df with mean and variance. Classification: df with votes, an array of (class, share) from the largest
        share down, the lower class first, and prediction, the first of them. Columns of df with these names are replaced."""
        own = self.values(df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[quoted(e.name) for e in self.encoders]), "values")
        if not self.classes:
            mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / len(self.trees)
            m = mean(F.col("values"))
            return own.select(*others(df, "mean", "variance"), m.alias("mean"), (mean(F.transform("values", lambda v: v * v)) - m * m).alias("variance"))

        def share_of(k: int) -> Column:
            return F.struct((-F.size(F.filter("values", lambda v: v == k)) / len(self.trees)).alias("order"), F.lit(k).alias("class"))

        share = [share_of(k) for k in range(self.classes)]
        votes = F.transform(F.filter(F.array_sort(F.array(*share)), lambda s: s["order"] < 0), lambda s: F.struct(s["class"].alias("class"), (-s["order"]).alias("share")))
        return own.select("row", votes.alias("votes")).select(*others(df, "votes", "prediction"), "votes", F.col("votes")[0]["class"].alias("prediction"))


def register(spark: SparkSession, name: str, model: BoostedTrees) -> None:
    """The model for SQL text: `name(feature, ...)` takes the encoded features as doubles and gives the prediction."""
    features, flats = model.features, [Flat(t, model.features) for t in model.trees]
    start, step, loss = model.initial, model.shrinkage, model.loss

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            bins = codes(features, [p.to_numpy(np.float64) for p in part])
            total = start + step * sum((f.value[f.walk(bins)] for f in flats), np.zeros(bins.shape[1]))
            yield pd.Series(loss.means(total))

    spark.udf.register(name, score)
