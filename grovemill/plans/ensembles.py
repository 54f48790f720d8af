"""Training gradient boosted trees and random forests from raw DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemill.errors import InvalidLabel
from grovemill.functions.encoders import Encoder, dictionary, distinct_values, encode_all, encoders
from grovemill.functions.losses import Loss, loss_named
from grovemill.functions.scalars import number, quoted
from grovemill.operators.binning import WIDEST, BinningOptions, finder
from grovemill.operators.discretize import bin_column
from grovemill.operators.sampling import bag_count, is_training
from grovemill.operators.impurity import Impurity
from grovemill.operators.summary import LabelSummary, validate_label
from grovemill.plans.grow import GrowOptions, grow
from grovemill.plans.model import BoostedTrees, RandomForest, TreeWriter
from grovemill.plans.state import Log, Notifiee, Stash
from grovemill.plans.trees import Feature, Tree


@dataclass(frozen=True)
class BoostOptions:
    """max_depth counts the root, so 3 is two levels of splits. Predictions are written anew every `stash_every` trees. mtry,
    max_splits, subtree_weight and impurity are those of GrowOptions; a node's mtry features are drawn anew in each tree."""

    trees: int = 100
    max_depth: int = 3
    min_split: float = 10
    loss: str | Loss = "gaussian"
    categories: str = "ordered"
    bag_rate: float = 0.5
    bag_replace: bool = False
    shrinkage: float = 0.001
    refine: bool = True
    training: float = 0.8
    stash_every: int = 5
    engine: str = "arrow"
    seed: int = 1
    binning: BinningOptions = field(default_factory=BinningOptions)
    mtry: int | None = None
    max_splits: int = 1024
    subtree_weight: float = 0
    impurity: Impurity | None = None

    def __post_init__(self) -> None:
        if self.trees < 0 or self.stash_every < 1 or not 0 < self.training <= 1 or self.bag_rate <= 0:
            raise ValueError("trees are 0 at least, stash_every is 1 at least, rates are above 0")
        loss_named(self.loss)


@dataclass(frozen=True)
class ForestOptions:
    trees: int = 10
    classes: int = 0
    mtry: int | None = None
    max_depth: int = 30
    min_split: float = 2
    categories: str = "ordered"
    bag_rate: float = 1.0
    bag_replace: bool = True
    subtree_weight: float = 0
    max_splits: int = 1024
    engine: str = "arrow"
    seed: int = 1
    binning: BinningOptions = field(default_factory=BinningOptions)
    impurity: Impurity | None = None


@dataclass
class Prepared:
    """rows: key, y, b_0.. in a table of the stash."""

    rows: DataFrame
    features: list[Feature]
    encoders: list[Encoder]
    label: LabelSummary
    named: Encoder


def prepare(df: DataFrame, label: str, features: list[str], categorical: set[str], binning: BinningOptions, cardinality: int | None, stash: Stash, key: str | None = None, seed: int = 1) -> Prepared:
    """Encode, find bins over all rows, and write label and bin ids. A categorical label is numbered in order of its values.

    key: an integer column that names rows, for bags, the validation split and the sample of bins. Without one a row is named
    by a hash of its label and features and a number among its equals, which takes one more shuffle.
    """
    numeric = [f for f in features if f not in categorical]
    by = {e.name: e for e in encoders(df, numeric, [f for f in features if f in categorical], binning.most_categories, binning.hash_categories)}
    own = [by[f] for f in features]
    y, named = number(label), Encoder(label)
    if label in categorical:
        values = distinct_values(df, [label], binning.most_categories)[label]
        named = Encoder(label, dictionary(values), unseen="error")
        y = named.column()
    names = [f"x_{j}" for j in range(len(features))]
    encoded = encode_all(df, own, [y.alias("y"), *([quoted(key).cast("bigint").alias("key")] if key else [])], names)
    if not key:
        # Equal rows are counted, then numbered: the key of a row is the same however the table is partitioned.
        counted = encoded.groupBy("y", *names).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        encoded = counted.select("y", F.xxhash64("y", *names, "copy").alias("key"), *names)
    encoded = encoded.select("key", "y", *names)
    encoded = stash.keep(encoded)
    if encoded.isEmpty():
        raise ValueError("there are no rows to train from")
    summary, bins = finder(binning, seed, "key").find(encoded, "y", names, {f"x_{j}" for j, f in enumerate(features) if f in categorical}, binning.most_bins, cardinality)
    validate_label(summary, cardinality)
    if wide := [f for f, b in zip(features, bins.values(), strict=True) if b.cardinality > WIDEST]:
        raise ValueError(f"more than {WIDEST} bins: {wide}")
    shaped = [Feature(f, bins[n]) for f, n in zip(features, names, strict=True)]
    ids = [bin_column(F.col(n), f.bins).cast("smallint" if f.bins.cardinality <= 32_767 else "int").alias(f"b_{j}") for j, (n, f) in enumerate(zip(names, shaped, strict=True))]
    rows = stash.keep(encoded.select("key", "y", *ids))
    return Prepared(rows, shaped, own, summary, named)


def initial_value(rows: DataFrame, loss: Loss) -> float:
    return loss.initial_of(rows.select("y", F.lit(1.0).alias("w")))


def refined(tree: Tree, rows: DataFrame, features: list[Feature], loss: Loss) -> None:
    """Every node's prediction from the rows in the bag that pass through it: y, f (before this tree), w_0."""
    above: dict[int, list[int]] = {1: [1]}
    for n in sorted(tree.nodes.values(), key=lambda n: n.depth):
        for c in n.split.targets() if n.split else []:
            above[c] = [*above[n.id], c]
    path = tree.on_bins(features, lambda n: F.array(*[F.lit(i) for i in above[n.id]])).alias("path")
    passed = rows.select(path, "y", "f", F.col("w_0").alias("w")).where("w > 0").select(F.explode("path").alias("node"), "y", "f", "w")
    for node, value in loss.estimates_of(passed).items():
        if value is not None:
            tree.nodes[node].prediction = float(value)


def deviances(rows: DataFrame, loss: Loss) -> dict[bool, float]:
    """By training (True) and validation rows: y, f, training."""
    return {r["training"]: r["v"] for r in rows.select("training", "y", "f", F.lit(1.0).alias("w")).groupBy("training").agg(loss.deviance().alias("v")).collect()}


def boost(df: DataFrame, label: str, features: list[str], categorical: set[str] | None = None, options: BoostOptions | None = None, key: str | None = None, notifiee: Notifiee | None = None, writer: TreeWriter | None = None) -> BoostedTrees:
    """Gradient boosted trees. A tree takes one pass a level, one for its leaves and one for deviances. The writer is given
    each tree once it is final."""
    o, told = options or BoostOptions(), notifiee or Log()
    loss, stash = loss_named(o.loss), Stash(df.sparkSession)
    try:
        p = prepare(df, label, features, set(categorical or ()), o.binning, loss.cardinality, stash, key, o.seed)
        told.status(f"{p.label.total} rows, {len(p.features)} features, {sum(f.bins.cardinality for f in p.features)} bins")
        base = p.rows.withColumn("training", is_training("key", o.training, o.seed))
        counts = {r["training"]: r["n"] for r in base.groupBy("training").agg(F.count("*").alias("n")).collect()}
        if not counts.get(True) or (o.training < 1 and not counts.get(False)):
            raise ValueError("there are no training rows, or no validation rows")
        start = initial_value(base.where("training"), loss)
        rows = base.withColumn("f", F.lit(start)).persist(StorageLevel.MEMORY_AND_DISK)
        state, number_of = rows, None
        model = BoostedTrees(p.features, p.encoders, [], loss, start, o.shrinkage, label=p.named)
        if writer:
            writer.begin(model)

        def note(found: dict[bool, float]) -> None:
            model.train_deviance.append(found[True])
            if o.training < 1:
                model.validation_deviance.append(found[False])

        note(deviances(state, loss))
        grown = GrowOptions(mtry=o.mtry, max_depth=o.max_depth, min_split=o.min_split, categories=o.categories, max_splits=o.max_splits, subtree_weight=o.subtree_weight, engine=o.engine, seed=o.seed, impurity=o.impurity)
        for i in range(o.trees):
            bag = state.where("training").withColumn("w_0", bag_count("key", i, o.bag_rate, o.bag_replace, o.seed).cast("double"))
            gradient = bag.withColumn("y", loss.gradient())
            tree = grow(gradient, p.features, replace(grown, seed=o.seed + i) if o.mtry else grown)[0]
            if o.refine and loss.refinable:
                refined(tree, bag, p.features, loss)
            model.trees.append(tree)
            if writer:
                writer.tree(i, tree)
            state = state.withColumn("f", F.col("f") + o.shrinkage * tree.on_bins(p.features, lambda n: F.lit(float(n.prediction))))
            if (i + 1) % o.stash_every == 0 and i + 1 < o.trees:
                state = stash.keep(state).persist(StorageLevel.MEMORY_AND_DISK)
                note(deviances(state, loss))
                rows.unpersist()
                if number_of:
                    stash.drop(number_of)
                rows, number_of = state, stash.count
            else:
                note(deviances(state, loss))
            told.progress(f"tree {i + 1} of {o.trees}: deviance {model.train_deviance[-1]:g}")
        rows.unpersist()
        own = model.validation_deviance[1:]
        model.best = own.index(min(own)) + 1 if own else len(model.trees)
        if writer:
            writer.end(model)
        return model
    except Exception as e:
        told.error(str(e))
        raise
    finally:
        stash.drop()


def forest(df: DataFrame, label: str, features: list[str], categorical: set[str] | None = None, options: ForestOptions | None = None, key: str | None = None, writer: TreeWriter | None = None) -> RandomForest:
    """A random forest: all trees grow together, a pass for each level of all of them. So the writer gets them at the end."""
    o, stash = options or ForestOptions(), Stash(df.sparkSession)
    try:
        p = prepare(df, label, features, set(categorical or ()), o.binning, o.classes or None, stash, key, o.seed)
        if o.classes and p.label.rest:
            raise InvalidLabel("labels beyond the classes")
        bags: dict[str, Column] = {f"w_{t}": bag_count("key", t, o.bag_rate, o.bag_replace, o.seed).cast("double") for t in range(o.trees)}
        # Bags are hashes, computed in each pass: only bins and keys are held.
        rows = p.rows.persist(StorageLevel.MEMORY_AND_DISK)
        grown = GrowOptions(o.classes, o.mtry, o.max_depth, o.min_split, o.categories, o.max_splits, o.subtree_weight, engine=o.engine, seed=o.seed, impurity=o.impurity)
        model = RandomForest(p.features, p.encoders, [], o.classes, p.named)
        if writer:
            writer.begin(model)
        model.trees += grow(rows.withColumns(bags), p.features, grown, o.trees)
        rows.unpersist()
        if writer:
            for i, tree in enumerate(model.trees):
                writer.tree(i, tree)
            writer.end(model)
        return model
    finally:
        stash.drop()
