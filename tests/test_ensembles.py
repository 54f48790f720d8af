import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemill.errors import CardinalityOverLimit, InvalidLabel
from grovemill.functions import encoders as encoders_module
from grovemill.functions.losses import LOSSES, loss_named
from grovemill.operators.binning import BinningOptions, Discretization, EqualWidth, NumericBins
from grovemill.operators.impurity import Gini
from grovemill.plans import model as models
from grovemill.plans.ensembles import BoostOptions, ForestOptions, boost, forest
from grovemill.plans.model import TreeFolder, load, register
from grovemill.plans.runner import Config, options_of, parse, run
from grovemill.sources.tables import Delimited, read, roles
from grovemill.streaming.scoring import score_files, score_stream

BINS = BinningOptions(Discretization.EQUAL_WIDTH, most_bins=16)


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.uniform(0, 10), rng.uniform(0, 1), "xyz"[rng.integers(3)]
        y = 3.0 * (a > 5) + 2.0 * (c == "y") + rng.normal(0, 0.1)
        rows.append((i, float(y), int(a > 5 or c == "y"), float(a) if i % 11 else None, float(b), c if i % 13 else None))
    return spark.createDataFrame(rows, "key bigint, y double, flag int, a double, b double, c string")


@pytest.mark.parametrize("name", sorted(LOSSES))
def test_gradients_are_slopes_of_the_deviance(name):
    loss, rng = LOSSES[name], np.random.default_rng(2)
    y = rng.integers(0, 2, 200).astype(float) if loss.cardinality else rng.integers(0, 9, 200).astype(float)
    f, e = rng.normal(0, 0.7, 200), 1e-6
    slope = -(loss.deviances(y, f + e) - loss.deviances(y, f - e)) / (2 * e)
    scale = 2 if name in ("gaussian", "poisson") else 1
    fine = np.abs(np.abs(y - f)) > 1e-3 if name == "laplacian" else np.ones(200, bool)
    if name == "hinge":
        fine = (np.abs(np.abs(f) - loss.margin) > 1e-3) & (np.abs(np.abs(f) - abs(loss.cap - loss.margin)) > 1e-3)
    assert np.allclose(loss.gradients(y, f)[fine] * scale, slope[fine], atol=1e-4)


def test_boosting_lowers_deviance_and_predicts(spark):
    df = table(spark)
    model = boost(df, "y", ["a", "b", "c"], {"c"}, BoostOptions(trees=7, shrinkage=0.5, bag_rate=1.0, stash_every=3, binning=BINS), key="key")
    assert all(b < a for a, b in zip(model.train_deviance, model.train_deviance[1:])) and len(model.validation_deviance) == 8
    assert model.best == int(np.argmin(model.validation_deviance[1:])) + 1 and model.importance()[0][0] == "a"
    got = model.transform(df, raw="f").agg(F.avg((F.col("y") - F.col("prediction")) ** 2).alias("v"), F.max(F.abs(F.col("f") - F.col("prediction"))).alias("d")).first()
    # Rows without a or c leave about a tenth of the variance.
    assert got.v < 0.15 * model.train_deviance[0] and got.d == 0
    unseen = spark.createDataFrame([(1.0, None, "new"), (None, 0.5, "x")], "a double, b double, c string")
    assert all(r.prediction is not None for r in model.transform(unseen).collect())


def test_scoring_ways_agree_and_models_are_saved(spark, tmp_path, monkeypatch):
    df = table(spark, 200)
    model = boost(df, "flag", ["a", "b", "c"], {"c"}, BoostOptions(trees=3, shrinkage=0.5, loss="logloss", categories="multiway", training=1.0, binning=BINS), key="key")
    assert model.validation_deviance == [] and model.best == 3
    want = [r.prediction for r in model.transform(df).orderBy("key").collect()]
    assert 0 <= min(want) and max(want) <= 1
    model.save(spark, f"file://{tmp_path}/model")
    again = load(spark, f"file://{tmp_path}/model")
    assert [t.shape() for t in again.trees] == [t.shape() for t in model.trees] and again.metadata() == model.metadata()
    monkeypatch.setattr(models, "EXPRESSION_NODES", 0)
    assert np.allclose([r.prediction for r in again.transform(df).orderBy("key").collect()], want)
    register(spark, "score_flag", again)
    again.encoded(df).selectExpr("row.key", "x_0", "x_1", "x_2").createOrReplaceTempView("encoded_rows")
    assert np.allclose([r.p for r in spark.sql("select score_flag(x_0, x_1, x_2) as p from encoded_rows order by key").collect()], want)


@pytest.mark.parametrize("loss", ["laplacian", "poisson", "adaboost", "hinge"])
def test_other_losses_train(spark, loss):
    own = loss_named(loss)
    df = table(spark, 200).withColumn("y", F.abs("y"))
    model = boost(df, "flag" if own.cardinality else "y", ["a", "c"], {"c"}, BoostOptions(trees=2, shrinkage=0.3, loss=loss, bag_replace=True, binning=BINS), key="key")
    assert model.train_deviance[-1] < model.train_deviance[0]


def test_forest(spark, tmp_path):
    df = table(spark, 300)
    model = forest(df, "flag", ["a", "b", "c"], {"c"}, ForestOptions(trees=3, classes=2, mtry=2, max_depth=5, binning=BINS), key="key")
    got = model.transform(df).collect()
    assert np.mean([r.prediction == r.flag for r in got]) > 0.9
    assert all(abs(sum(v["share"] for v in r.votes) - 1) < 1e-9 and r.votes == sorted(r.votes, key=lambda v: (-v["share"], v["class"])) for r in got)
    assert all(200 < n < 400 for n in model.sample_counts)
    model.save(spark, f"file://{tmp_path}/forest")
    assert load(spark, f"file://{tmp_path}/forest").transform(df).collect() == got
    mean = forest(df, "y", ["a", "c"], {"c"}, ForestOptions(trees=2, max_depth=3, binning=BINS), key="key").transform(df).first()
    assert mean["variance"] >= -1e-9


def test_bad_tables(spark):
    df = table(spark, 40)
    for error, label, options in ((InvalidLabel, "y", BoostOptions(loss="logloss", binning=BINS)), (CardinalityOverLimit, "y", BoostOptions(binning=BinningOptions(most_categories=2, hash_categories=False)))):
        with pytest.raises(error):
            boost(df, label, ["a", "c"], {"c"}, options, key="key")
    with pytest.raises(ValueError, match="no rows"):
        boost(df.where("key < 0"), "y", ["a"], options=BoostOptions(binning=BINS), key="key")
    with pytest.raises(InvalidLabel):
        boost(df, "a", ["b"], options=BoostOptions(binning=BINS), key="key")


def test_runner_and_sources(spark, tmp_path):
    df = table(spark, 120).select("y", "a", "b", "c", "key")
    df.write.option("sep", "|").option("header", True).csv(f"file://{tmp_path}/in")
    c = parse(["--inputPath", f"file://{tmp_path}/in", "--outputPath", f"file://{tmp_path}/out", "--delimiter", "|", "--headerExists", "true", "--catColIndices", "3", "--colsToIgnoreIndices", "4", "--numTrees", "2", "--shrinkage", "0.5", "--repartitionSize", "2", "--discType", "equal_width", "--verbose", "true"])
    assert c.catColIndices == (3,) and c.fracTraining == 0.8 and options_of(c).trees == 2 and len(Config.__dataclass_fields__) == 31
    model = run(spark, c)
    assert [f.name for f in model.features] == ["a", "b", "c"] and len(load(spark, c.outputPath).trees) == 2
    assert run.__doc__ and read(spark, f"file://{tmp_path}/in", text=Delimited("|", header=True), schema=df.schema).count() == 120
    with pytest.raises(ValueError):
        roles(df, 0, ("c",), ("y",))
    with pytest.raises(ValueError):
        read(spark, "x", "orc")
    with pytest.raises(RuntimeError, match="avro"):
        read(spark, f"file://{tmp_path}/in", "avro")


def test_streams_are_scored(spark, tmp_path):
    df = table(spark, 100)
    model = boost(df, "y", ["a", "c"], {"c"}, BoostOptions(trees=2, shrinkage=0.5, binning=BINS), key="key")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    score_files(model, stream, f"file://{tmp_path}/out", f"file://{tmp_path}/offsets").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").select("key", "prediction").collect())) == sorted(map(tuple, model.transform(df).select("key", "prediction").collect()))
    with pytest.raises(ValueError):
        score_stream(model, df)


NAMES = "row raw raw_ x_0 x_1 x_0_ x_1_ values values_ votes k_ v_ copies copy key_ f training w_0 b_0 path node g order".split()


@pytest.mark.parametrize("few", [True, False])
def test_scoring_keeps_columns_of_any_name(spark, monkeypatch, few):
    df = table(spark, 120)
    boosted = boost(df, "y", ["a", "c"], {"c"}, BoostOptions(trees=2, shrinkage=0.5, binning=BINS), key="key")
    voting = forest(df, "flag", ["a", "c"], {"c"}, ForestOptions(trees=2, classes=2, max_depth=3, binning=BINS), key="key")
    mean = forest(df, "y", ["a", "c"], {"c"}, ForestOptions(trees=2, max_depth=3, binning=BINS), key="key")
    if not few:
        monkeypatch.setattr(models, "EXPRESSION_NODES", 0)
        monkeypatch.setattr(encoders_module, "LITERALS", 0)
    own = [F.lit(f"{n} of the caller").alias(n) for n in [*NAMES, "a.b"]]
    wide = df.select("*", *own, F.lit(-1).alias("Prediction"), F.lit(-1).alias("mean"), F.lit(-1).alias("variance"), F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    for model, outputs in ((boosted, {"prediction"}), (voting, {"prediction", "votes"}), (mean, {"mean", "variance"})):
        out, plain = model.transform(wide), {r.key: r for r in model.transform(df).collect()}
        assert [c for c in out.columns if c not in outputs] == [c for c in wide.columns if c.lower() not in outputs]
        for r in out.collect():
            assert all(r[o] == plain[r.key][o] for o in outputs)
            assert all(r[n] == f"{n} of the caller" for n in [*NAMES, "a.b"] if n not in outputs) and r["map"] == {"k": 1}


def test_training_does_not_depend_on_partitions(spark):
    df = table(spark, 300)
    df = df.unionByName(df.where("key < 40"))
    binning = BinningOptions(Discretization.EQUAL_FREQUENCY, most_bins=12, sample=100)
    found = []
    for n, key in ((2, None), (5, None), (2, "key"), (5, "key")):
        model = boost(df.repartition(n, "b"), "y", ["a", "b", "c"], {"c"}, BoostOptions(trees=2, shrinkage=0.5, binning=binning), key=key)
        found.append((np.round(model.train_deviance, 9).tolist(), [f.bins for f in model.features], [t.shape() for t in model.trees]))
    assert found[0] == found[1] and found[2] == found[3]


def test_every_node_of_a_path_is_estimated_anew(spark):
    df = table(spark, 300)
    model = boost(df, "flag", ["a", "c"], {"c"}, BoostOptions(trees=1, shrinkage=1.0, loss="logloss", bag_rate=1.0, training=1.0, binning=BINS), key="key")
    y = np.array([r.flag for r in df.collect()])
    p = y.mean()
    assert model.trees[0].nodes[1].prediction == pytest.approx((y.sum() - p * len(y)) / (p * len(y) * (1 - p)), abs=1e-9)
    leaf = model.trees[0].leaves()[0]
    assert abs(leaf.prediction) > abs(model.trees[0].nodes[1].prediction)


def test_subtrees_feature_subsets_and_own_bins_in_boosting(spark):
    class Halves:
        def find(self, df, label, features, categorical, most, cardinality=None):
            own, bins = EqualWidth().find(df, label, features, categorical, most, cardinality)
            return own, {f: NumericBins((5.0,), True) if f == "x_0" else b for f, b in bins.items()}

    df = table(spark, 200)
    binning = BinningOptions(Discretization.EQUAL_WIDTH, most_bins=16, finder=Halves())
    plain, small = (boost(df, "y", ["a", "b", "c"], {"c"}, BoostOptions(trees=2, max_depth=4, shrinkage=0.5, binning=binning, subtree_weight=w, max_splits=s), key="key") for w, s in ((0, 1024), (60, 2)))
    assert plain.features[0].bins == NumericBins((5.0,), True)
    assert np.allclose(plain.train_deviance, small.train_deviance) and [t.shape() for t in plain.trees] == [t.shape() for t in small.trees]
    few = boost(df, "y", ["a", "b", "c"], {"c"}, BoostOptions(trees=2, shrinkage=0.5, binning=BINS, mtry=1), key="key")
    assert few.train_deviance[-1] < few.train_deviance[0]


def test_trees_are_written_as_they_come(spark, tmp_path):
    df, path = table(spark, 200), f"file://{tmp_path}/trees"

    class Stops(TreeFolder):
        """Loses its driver after the second tree."""

        def tree(self, number, tree):
            super().tree(number, tree)
            if number == 1:
                raise KeyboardInterrupt

    options = BoostOptions(trees=3, shrinkage=0.5, training=1.0, binning=BINS)
    with pytest.raises(KeyboardInterrupt):
        boost(df, "y", ["a", "b", "c"], {"c"}, options, key="key", writer=Stops(spark, path))
    left = load(spark, path)
    whole = boost(df, "y", ["a", "b", "c"], {"c"}, options, key="key", writer=TreeFolder(spark, path + "2"))
    assert [t.shape() for t in left.trees] == [t.shape() for t in whole.trees[:2]] and left.initial == whole.initial
    again = load(spark, path + "2")
    assert [t.shape() for t in again.trees] == [t.shape() for t in whole.trees] and again.train_deviance == whole.train_deviance
    with pytest.raises(Exception, match="(?i)already exists"):
        TreeFolder(spark, path).begin(whole)
    TreeFolder(spark, path + "3").begin(whole)
    assert load(spark, path + "3").trees == []


def test_models_know_their_label(spark, tmp_path):
    df = table(spark, 200).withColumn("kind", F.when(F.col("flag") == 1, "yes").otherwise("no"))
    model = forest(df, "kind", ["a", "b"], {"kind"}, ForestOptions(trees=2, classes=2, max_depth=3, impurity=Gini(), binning=BINS), key="key", writer=TreeFolder(spark, f"file://{tmp_path}/f"))
    assert model.label.name == "kind" and model.label.mapping == {"no": 0, "yes": 1}
    again = load(spark, f"file://{tmp_path}/f")
    assert again.label == model.label and [t.shape() for t in again.trees] == [t.shape() for t in model.trees]
