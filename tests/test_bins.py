import numpy as np
import pytest

from grovemill.errors import CardinalityOverLimit, InvalidCategory, InvalidLabel
from grovemill.operators.binning import EqualWidth, NumericBins, Segmenting, segment
from grovemill.operators.discretize import discretize
from grovemill.operators import sampling
from grovemill.operators.sampling import Reservoir, bag_count, kth, reservoir, upper_median
from grovemill.operators.summary import LabelSummary, validate_label
from tests.fixtures import DATA1, DATA3, DATA6, NAN, frame


def test_equal_frequency(spark):
    own, bins = Segmenting("size", 1000, 0).find(frame(spark, DATA1), "label", ["f0", "f1", "f2"], {"f1"}, 8, 4)
    assert (own.counts, own.rest) == ((7, 8, 11, 4), 0)
    assert [b.cardinality for b in bins.values()] == [5, 3, 8]
    assert bins["f0"].edges == (1, 2, 3, 4)
    assert bins["f2"].edges == (-72.87, -52.28, -5.63, 20.88, 25.89, 59.07, 81.67)
    assert [bins["f0"].find(x) for x in (0, 0.5, 1.0, 3.99999, 4.0, 10)] == [0, 0, 1, 3, 4, 4]
    with pytest.raises(InvalidCategory):
        bins["f1"].find(1.1)
    with pytest.raises(CardinalityOverLimit):
        bins["f1"].find(10.0)
    rows = discretize(frame(spark, DATA1), bins).orderBy("row_id").select("b_f0", "b_f1", "b_f2").collect()
    assert tuple(rows[0]) == (0, 0, 2) and tuple(rows[17]) == (2, 2, 4)
    assert [tuple(r) for r in rows] == [tuple(b.find(x) for b, x in zip(bins.values(), r[1:], strict=True)) for r in DATA1]


def test_equal_frequency_of_numbers_and_missing_values(spark):
    own, bins = Segmenting("size", 1000, 0).find(frame(spark, DATA3), "label", ["f0", "f1"], set(), 8)
    assert [b.cardinality for b in bins.values()] == [5, 3] and (own.counts, own.rest) == ((), 30)
    own, bins = Segmenting("size", 1000, 0).find(frame(spark, DATA6), "label", ["f0", "f1"], set(), 8, 3)
    assert (own.counts, own.rest) == ((7, 8, 11), 4)
    assert [(b.cardinality, b.missing) for b in bins.values()] == [(6, 5), (4, 3)]
    rows = discretize(frame(spark, DATA6), bins).orderBy("row_id").select("b_f0", "b_f1").collect()
    assert tuple(rows[2]) == (2, 3) and tuple(rows[7]) == (5, 1)


def test_equal_width(spark):
    _, bins = EqualWidth().find(frame(spark, DATA1), "label", ["f0", "f1", "f2"], {"f1"}, 8, 4)
    assert [b.cardinality for b in bins.values()] == [8, 3, 8]
    assert [bins["f0"].find(x) for x in (0, 0.5, 1, 4)] == [0, 1, 2, 7] and [bins["f2"].find(x) for x in (-80, -60, -58)] == [0, 0, 1]
    own, bins = EqualWidth().find(frame(spark, DATA6), "label", ["f0", "f1"], set(), 8, 3)
    assert [(b.cardinality, b.missing) for b in bins.values()] == [(8, 7), (8, 7)] and own.rest == 4


def test_supervised_bins_and_awkward_columns(spark):
    for kind in ("entropy", "variance"):
        _, bins = Segmenting(kind, exact=True).find(frame(spark, DATA1), "label", ["f0", "f2"], set(), 6, 4)
        assert all(1 < b.cardinality <= 6 and list(b.edges) == sorted(set(b.edges)) for b in bins.values())
    with pytest.raises(ValueError):
        Segmenting("entropy").find(frame(spark, DATA1), "label", ["f0"], set(), 6)
    x, y = np.array([1.0, 1, 2, 2, 3, 3]), np.array([0.0, 0, 5, 5, 5, 5])
    assert segment("variance", x, y, 2, False, exact=True).edges == (2.0,)
    assert segment("size", x[:0], y[:0], 4, True) == NumericBins((), True)
    same = [(0, 1.0, NAN), (1, 1.0, NAN)]
    for way in (EqualWidth(), Segmenting("size")):
        _, bins = way.find(frame(spark, same), "label", ["f0", "f1"], set(), 8)
        assert [b.cardinality for b in bins.values()] == [1, 2]
    with pytest.raises(InvalidLabel):
        EqualWidth().find(frame(spark, [(NAN, 1.0)]), "label", ["f0"], set(), 8)


def test_label_rules():
    validate_label(LabelSummary((3, 4), 0, 0.5, 0.5), 2)
    for wrong in (LabelSummary((3, 4), 1, 0.5, 0.5), LabelSummary((3, 0), 0, 0.0, 0.0)):
        with pytest.raises(InvalidLabel):
            validate_label(wrong, 2)
    validate_label(LabelSummary((), 3, 1.0, 1.0), None)


def test_many_edges_use_the_blockwise_search(spark):
    bins = NumericBins(tuple(float(i) for i in range(1, 100)), True)
    values = [-1.0, 0.5, 1.0, 16.0, 16.5, 17.0, 50.2, 98.9, 99.0, 1e9, NAN]
    df = discretize(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, f double"), {"f": bins})
    assert [r.b_f for r in df.orderBy("i").collect()] == [bins.find(v) for v in values]


@pytest.mark.parametrize("replace", [False, True])
def test_bags(spark, replace):
    df = spark.range(10_000).select("id", bag_count("id", 0, 0.7, replace).alias("a"), bag_count("id", 1, 0.7, replace).alias("b"))
    rows = np.array(df.select("a", "b").collect())
    assert abs(np.corrcoef(rows.T)[0, 1]) < 0.05
    assert (abs(rows.sum(axis=0) - 7000) < 700).all() and (rows[:, 0] != rows[:, 1]).any() and (rows.max() > 1) == replace


def test_reservoirs_and_order_statistics(spark):
    counts = np.zeros(3)
    for seed in range(100):
        r = Reservoir(100, seed)
        for x in [0, 1, 2] * 1000:
            r.add(x)
        counts += np.bincount(r.sample, minlength=3)
    assert (31 <= counts / 100).all() and (counts / 100 <= 35).all()
    for a, b, low, high in ((1000, 2000, 31, 35), (150, 50, 73, 77), (50, 150, 23, 27), (90, 45, 64, 68)):
        zeros = 0
        for seed in range(100):
            left, right = Reservoir(100, seed), Reservoir(100, seed + 1000)
            for _ in range(a):
                left.add(0)
            for _ in range(b):
                right.add(1)
            merged = left.merge(right).sample
            zeros += merged.count(0)
            assert len(merged) == 100
        assert low <= zeros / 100 <= high
    values = [-1, 2, -152, 123, 11, 11, 323, -12]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert [kth(df, "v", k).first().value for k in (0, 3, 7)] == [-152, 2, 323] and kth(df, "v", 8).collect() == []
    assert reservoir(spark.range(50), 10, "id").count() == 10


def test_order_statistics_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(0, 6, 400), -rng.lognormal(0, 6, 300), np.full(200, 3.5), [1.7e308, -1.7e308, 5e-324, 0.0]])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(values)] + [(7, 2.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for buckets in (4, 512):
        monkeypatch.setattr(sampling, "BUCKETS", buckets)
        own = np.sort([v for _, v in rows if v is not None])
        assert sampling.order_statistics(df, "v") == {None: own[len(own) // 2]}
        want = {g: np.sort([v for h, v in rows if h == g]) for g in (0, 1, 2, 7)}
        assert sampling.order_statistics(df, "v", lambda n: n - 1, "g") == {g: v[-1] for g, v in want.items()}
        assert sampling.order_statistics(df, "v", group="g") == {g: v[len(v) // 2] for g, v in want.items()}
    assert sampling.order_statistics(df.where("g > 9"), "v") == {} and upper_median(df.where("g = 8"), "v").collect() == []
