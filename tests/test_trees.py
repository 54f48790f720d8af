import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemill.operators.binning import EqualWidth, Segmenting
from grovemill.operators import histogram, split
from grovemill.operators.discretize import discretize
from grovemill.operators.histogram import arrow_histogram, sql_histogram
from grovemill.operators.impurity import Gini
from grovemill.plans.grow import GrowOptions, grow, grow_local
from grovemill.plans.trees import Feature, Flat, Tree, codes
from tests.fixtures import DATA2, DATA6, frame


def binned(spark, rows, categorical=("f1",), most=5, finder=None):
    df = frame(spark, rows)
    names = [c for c in df.columns if c.startswith("f")]
    _, bins = (finder or EqualWidth()).find(df, "label", names, set(categorical), most)
    features = [Feature(n, bins[n]) for n in names]
    out = discretize(df, bins)
    return out.select("row_id", F.col("label").alias("y"), F.lit(1.0).alias("w_0"), *[F.col(f"b_{n}").alias(f"b_{j}") for j, n in enumerate(names)]), features


def arrays(df, features):
    rows = df.orderBy("row_id").collect()
    return np.array([[r[f"b_{j}"] for r in rows] for j in range(len(features))]), np.array([r["y"] for r in rows]), np.ones(len(rows))


GOLDEN = [("entropy", 4, "multiway", 16), ("variance", 0, "multiway", 16), ("variance", 0, "ordered", 19)]


@pytest.mark.parametrize("kind,classes,categories,nodes", GOLDEN)
def test_golden_trees_in_every_way(spark, kind, classes, categories, nodes):
    df, features = binned(spark, DATA2)
    bins, y, w = arrays(df, features)
    trees = [grow_local(bins, y, w, features, GrowOptions(classes=classes, categories=categories))]
    trees += grow(df, features, GrowOptions(classes=classes, categories=categories, engine="sql" if nodes == 19 else "arrow"))
    trees += grow(df, features, GrowOptions(classes=classes, categories=categories, subtree_weight=10, max_subtrees=3, max_splits=2))
    assert {len(t.nodes) for t in trees} == {nodes}
    assert len({t.shape() for t in trees}) == 1
    root = trees[0].nodes[1]
    assert (root.weight, root.impurity) == (30, pytest.approx(1.916716186961402 if classes else 0.9733333, rel=1e-6))
    assert root.prediction == (2 if classes else pytest.approx(1.4))
    for t in trees:
        flat = Flat(t, features)
        assert np.allclose(flat.value[flat.walk(bins)], y)
        by_rows = df.orderBy("row_id").select(t.on_bins(features, lambda n: F.lit(n.prediction)).alias("p")).collect()
        assert np.allclose([r.p for r in by_rows], y)
        assert np.allclose(t.importance(2), trees[0].importance(2))
        assert Tree.of_json(t.to_json()).shape() == t.shape()
        assert json.loads(t.to_json())[0]["id"] == 1 and "depth 1" in t.dump(["a", "b"])


@pytest.mark.parametrize("classes,categories", [(4, "random"), (0, "random"), (4, "ordered")])
def test_random_order_predicts_its_rows(spark, classes, categories):
    df, features = binned(spark, DATA2)
    bins, y, w = arrays(df, features)
    options = GrowOptions(classes=classes, categories=categories)
    a, b = grow_local(bins, y, w, features, options), *grow(df, features, options)
    assert a.shape() == b.shape()
    flat = Flat(a, features)
    assert np.allclose(flat.value[flat.walk(bins)], y)


@pytest.mark.parametrize("classes", [0, 3])
def test_missing_values(spark, classes):
    rows = [r for r in DATA6 if r[0] < 3]
    df, features = binned(spark, rows, (), 8, Segmenting("size", 1000))
    bins, y, w = arrays(df, features)
    assert [f.bins.has_missing for f in features] == [True, True]
    local = grow_local(bins, y, w, features, GrowOptions(classes=classes))
    for options in (GrowOptions(classes=classes, engine="sql"), GrowOptions(classes=classes, subtree_weight=8)):
        assert grow(df, features, options)[0].shape() == local.shape()
    assert any(n.split and n.split.missing for n in local.nodes.values())
    values = codes(features, [np.array([r[1] for r in rows]), np.array([r[2] for r in rows])])
    flat = Flat(local, features)
    own = flat.value[flat.walk(bins)]
    assert np.array_equal(own, flat.value[flat.walk(values)])
    raw = frame(spark, rows).orderBy("row_id").select(local.on_values(features, lambda n: F.lit(n.prediction), lambda j: F.col(f"f{j}")).alias("p")).collect()
    assert np.array_equal([r.p for r in raw], own)


def test_only_missing_values_part(spark):
    df, features = binned(spark, [(0, 1.0), (0, 2.0), (1, float("nan")), (1, float("nan")), (0, 1.5)], (), 3)
    for options in (GrowOptions(classes=2), GrowOptions(engine="sql")):
        tree = grow(df, features, options)[0]
        flat = Flat(tree, features)
        bins, y, _ = arrays(df, features)
        assert np.array_equal(flat.value[flat.walk(bins)], y)


def test_limits(spark):
    df, features = binned(spark, DATA2)
    for options, want in ((GrowOptions(max_depth=1), 1), (GrowOptions(max_depth=2), 3), (GrowOptions(min_split=31), 1), (GrowOptions(max_depth=2, subtree_weight=100), 3)):
        tree = grow(df, features, options)[0]
        assert len(tree.nodes) == want and max(n.depth for n in tree.nodes.values()) <= options.max_depth
    with pytest.raises(ValueError, match="weight"):
        grow(df.where("y > 9"), features, GrowOptions())
    for wrong in ({"max_subtrees": 0}, {"mtry": 0}, {"categories": "x"}, {"classes": 1}):
        with pytest.raises(ValueError):
            GrowOptions(**wrong)


def test_feature_subsets_and_several_trees(spark):
    df, features = binned(spark, DATA2)
    df = df.withColumn("w_1", F.when(F.col("row_id") % 2 == 0, 2.0).otherwise(0.0))
    one, two = (grow(df, features, GrowOptions(classes=4, mtry=1, max_splits=3, engine=e), trees=2) for e in ("arrow", "sql"))
    assert [t.shape() for t in one] == [t.shape() for t in two]
    assert one[1].nodes[1].weight == 30 and one[0].shape() != one[1].shape()
    bins, y, _ = arrays(df, features)
    w = np.where(np.arange(30) % 2 == 0, 2.0, 0.0)
    assert grow(df, features, GrowOptions(classes=4), trees=2)[1].shape() == grow_local(bins, y, w, features, GrowOptions(classes=4), 1).shape()


def test_histograms_beyond_dense_arrays_and_with_many_features(spark, monkeypatch):
    df, features = binned(spark, DATA2)
    tree = grow(df, features, GrowOptions(max_depth=2))[0]
    batch = [(0, 2), (0, 3)]
    whole, blocks, plain = arrow_histogram(df, [tree], features, batch), arrow_histogram(df, [tree], features, batch, dense=1), sql_histogram(df, [tree], features, batch)
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, whole.collect())) == want == sorted(map(tuple, blocks.collect())) and len({r[1] for r in want}) == 2
    shape = grow(df, features, GrowOptions(max_depth=3))[0].shape()
    monkeypatch.setattr(histogram, "GATHER", 3)
    assert sorted(map(tuple, arrow_histogram(df, [tree], features, batch, dense=1).collect())) == want
    for h in (whole, plain):
        plan = h._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[-1]
        # Read from below: partial sums by all four keys come before the first exchange, which is by the same keys.
        below = plan[plan.index("Exchange hashpartitioning(tree") :]
        assert below.startswith("Exchange hashpartitioning(tree") and all(k in below.split("\n")[0] for k in ("tree", "node", "feature", "bin")) and "partial_sum" in below.split("\n")[1]
        assert "Exchange" not in below.split("\n", 1)[1]
    monkeypatch.setattr(split, "LITERALS", 0)
    assert grow(df, features, GrowOptions(max_depth=3))[0].shape() == shape


class Minority:
    """The share of rows that are not of the commonest class."""

    def values(self, s):
        return 1 - s.max(axis=-1) / s.sum(axis=-1)

    def column(self, s):
        return 1 - F.greatest(*s) / sum(s[1:], s[0])


@pytest.mark.parametrize("impurity", [Gini(), Minority()])
def test_own_impurities_grow_equal_trees_in_every_way(spark, impurity):
    df, features = binned(spark, DATA2)
    bins, y, w = arrays(df, features)
    trees = [grow_local(bins, y, w, features, GrowOptions(classes=4, impurity=impurity))]
    trees += grow(df, features, GrowOptions(classes=4, impurity=impurity))
    trees += grow(df, features, GrowOptions(classes=4, impurity=impurity, subtree_weight=10, engine="sql"))
    assert len({t.shape() for t in trees}) == 1 and len(trees[0].nodes) > 1
    counts = np.bincount(y.astype(int), minlength=4).astype(float)
    assert trees[0].nodes[1].impurity == pytest.approx(float(impurity.values(counts)))
    assert impurity.values(np.array([5.0, 0, 0, 0])) == 0


def test_impurities_agree_in_numpy_and_columns(spark):
    rows = [(3.0, 1.0, 2.0), (4.0, 8.0, 16.0), (0.0, 0.0, 7.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for classes, own in ((3, None), (3, Gini()), (0, None)):
        got = [r[0] for r in df.select(split.impurity_col([F.col(c) for c in "abc"], classes, own)).collect()]
        assert np.allclose(got, split.impurity_of(np.array(rows), classes, own)) and got[3] == 0
