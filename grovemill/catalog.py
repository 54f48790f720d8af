"""Registered queries of the tree engine over whole tables, and their DuckDB twins, which are written on their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemill.errors import InvalidLabel
from grovemill.functions.encoders import Encoder, dictionary, distinct_values, encoders
from grovemill.functions.losses import LOSSES, loss_named
from grovemill.functions.scalars import number
from grovemill.operators.binning import BinningOptions, Discretization, EqualWidth, Segmenting
from grovemill.operators.discretize import discretize
from grovemill.operators.histogram import arrow_histogram, sql_histogram
from grovemill.operators.impurity import Gini
from grovemill.operators.sampling import bag_count, is_training, kth, reservoir, upper_median
from grovemill.operators.split import best_splits, candidates
from grovemill.operators.summary import summarize, summary_frame, validate_label
from grovemill.plans.ensembles import BoostOptions, ForestOptions, boost, forest
from grovemill.plans.grow import GrowOptions, grow
from grovemill.plans.model import BoostedTrees, RandomForest, load
from grovemill.plans.runner import Config, run
from grovemill.plans.state import Stash
from grovemill.plans.trees import NUMERIC, SUBSET, Feature, Node, Split, Tree
from grovemill.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem")


KEY = "(l_orderkey * 10 + l_linenumber)"

# Encoders -------------------------------------------------------------------------------------------------------------


@query(f"SELECT {KEY} AS key, l_extendedprice AS y, l_quantity AS f0, l_discount AS f1, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::DOUBLE AS f2 FROM lineitem")
def project_label_features(spark, sf):
    df = items(spark, sf)
    return df.select(F.expr(KEY).alias("key"), number("l_extendedprice").alias("y"), number("l_quantity").alias("f0"), number("l_discount").alias("f1"), Encoder("l_returnflag", dictionary(["A", "N", "R"])).column().alias("f2"))


@query("SELECT count(*) FILTER (l_tax = 0) AS n_nan, count(*) FILTER (l_tax <> 0) AS n_number FROM lineitem")
def null_to_nan(spark, sf):
    x = number("x")
    return items(spark, sf).select(F.expr("nullif(l_tax, 0)").alias("x")).agg(F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(~F.isnan(x)).alias("n_number"))


@query("SELECT DISTINCT p_brand AS value FROM part")
def cat_distinct(spark, sf):
    return spark.createDataFrame([(v,) for v in distinct_values(read(spark, sf, "part"), ["p_brand"], 256)["p_brand"]], "value string")


@query("SELECT least(count(DISTINCT p_brand), 11) AS brands, least(count(DISTINCT p_name), 11) AS names FROM part")
def cat_distinct_capped(spark, sf):
    found = distinct_values(read(spark, sf, "part"), ["p_brand", "p_name"], 10)
    return spark.createDataFrame([(len(found["p_brand"]), len(found["p_name"]))], "brands bigint, names bigint")


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS idx FROM part")
def cat_index(spark, sf):
    df = read(spark, sf, "part")
    return encoders(df, [], ["p_brand"], 256, False)[0].encode(df, "idx").select("p_partkey", "idx")


@query("SELECT p_partkey, ((list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) + 2147483648) % 4294967296 % 16)::DOUBLE AS bucket FROM part")
def cat_hash_bucket(spark, sf):
    df = read(spark, sf, "part")
    return encoders(df, [], ["p_name"], 16, True)[0].encode(df, "bucket").select("p_partkey", "bucket")


@query("SELECT 'p_brand' AS name, count(DISTINCT p_brand) > 30 AS over_limit FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name) > 30 FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) > 30 FROM part")
def cardinality_guard(spark, sf):
    found = distinct_values(read(spark, sf, "part"), ["p_brand", "p_name", "p_type"], 30)
    return spark.createDataFrame([(n, len(v) > 30) for n, v in found.items()], "name string, over_limit boolean")


# Summaries and bins ---------------------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (quality = 0) AS class_0, count(*) FILTER (quality = 1) AS class_1, count(*) FILTER (quality NOT IN (0, 1)) AS rest, round(avg(quality), 9) AS mean FROM labels")
def label_summary_class(spark, sf):
    return summary_frame(read(spark, sf, "labels"), "quality", [], 2).select("class_0", "class_1", "rest", F.round("mean", 9).alias("mean"))


@query("SELECT count(*) AS rest, round(avg(l_extendedprice), 4) AS mean, round(avg(l_extendedprice * l_extendedprice) / 1e6, 4) AS mean_square FROM lineitem")
def label_summary_regression(spark, sf):
    return summary_frame(items(spark, sf), "l_extendedprice", []).select("rest", F.round("mean", 4).alias("mean"), F.round(F.col("mean_square") / 1e6, 4).alias("mean_square"))


@query("SELECT min(l_quantity) AS q_least, max(l_quantity) AS q_most, min(l_tax) AS t_least, max(l_tax) AS t_most, false AS q_nan FROM lineitem")
def feature_summary(spark, sf):
    df = items(spark, sf).select("l_extendedprice", F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    return summary_frame(df, "l_extendedprice", ["q", "t"]).select("q_least", "q_most", "t_least", "t_most", "q_nan")


@query("SELECT true AS t_nan, min(l_tax) AS t_least, max(l_tax) AS t_most FROM lineitem WHERE l_linenumber <> 1")
def feature_summary_nan(spark, sf):
    return summary_frame(items(spark, sf).select("l_extendedprice", F.expr("if(l_linenumber = 1, double('NaN'), l_tax)").alias("t")), "l_extendedprice", ["t"]).select("t_nan", "t_least", "t_most")


def sql_bin(x: str, lo: str, hi: str, k: int) -> str:
    """Equal width: how many of the inner edges are at most x."""
    inner = [f"({x} >= {lo} + ({hi} - {lo}) / {k} * {i})::INT" for i in range(1, k - 1)]
    return "(" + " + ".join([*inner, f"({x} >= {hi} - ({hi} - {lo}) / {k})::INT"]) + ")"


def edges_frame(spark: SparkSession, bins: dict) -> DataFrame:
    return spark.createDataFrame([(f, i, float(e)) for f, b in bins.items() for i, e in enumerate(b.edges)], "feature string, nth int, edge double")


@query(
    "WITH s AS (SELECT 'l_quantity' AS feature, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem) "
    "SELECT feature, i::INT AS nth, CASE WHEN i < 14 THEN lo + (hi - lo) / 16 * (i + 1) ELSE hi - (hi - lo) / 16 END AS edge FROM s, range(15) t(i)"
)
def bins_equal_width(spark, sf):
    _, bins = EqualWidth().find(items(spark, sf), "l_extendedprice", ["l_quantity", "l_tax"], set(), 16)
    return edges_frame(spark, bins)


@query(
    "WITH s AS (SELECT min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_linenumber <> 1) "
    "SELECT 't' AS feature, i::INT AS nth, CASE WHEN i < 13 THEN lo + (hi - lo) / 15 * (i + 1) ELSE hi - (hi - lo) / 15 END AS edge FROM s, range(14) t(i)"
)
def bins_equal_width_nan(spark, sf):
    df = items(spark, sf).select("l_extendedprice", F.expr("if(l_linenumber = 1, null, l_tax)").alias("t"))
    return edges_frame(spark, EqualWidth().find(df, "l_extendedprice", ["t"], set(), 16)[1])


@query(f"WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT {KEY} AS key, {sql_bin('l_extendedprice', 'lo', 'hi', 64)} AS bin FROM lineitem, s")
def discretize_numeric(spark, sf):
    df = items(spark, sf)
    _, bins = EqualWidth().find(df, "l_quantity", ["l_extendedprice"], set(), 64)
    return discretize(df, bins).select(F.expr(KEY).alias("key"), F.col("b_l_extendedprice").cast("int").alias("bin"))


@query("SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def discretize_categorical(spark, sf):
    df = items(spark, sf)
    df = encoders(df, [], ["l_returnflag"], 256, False)[0].encode(df, "flag")
    _, bins = EqualWidth().find(df, "l_quantity", ["flag"], {"flag"}, 16)
    return discretize(df, bins).groupBy(F.col("b_flag").cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sql_uniform(key: str, seed: int, stream: int) -> str:
    start, prime = (seed * 69069 + stream * 362437 + 12345) % 2147483647, 2147483647
    one = f"(({key} % {prime} * 48271 + {start}) % {prime})"
    return f"({one} * ({one} + {(start * 31 + 7) % prime}) % {prime} * 16807 % {prime} / {prime}.0::DOUBLE)"


#: Of each kind of segmentation: what is summed for a distinct value besides its rows, and the loss of sums n, a and b.
_SEGMENTS = {
    "size": ("0", "0", lambda n, a, b: n),
    "entropy": ("y = 0", "y = 1", lambda n, a, b: " + ".join(f"(CASE WHEN {c} > 0 THEN -({c}) / {n} * ln(({c}) / {n}) ELSE 0 END)" for c in (a, b))),
    "variance": ("y", "y * y", lambda n, a, b: f"(({b}) / {n} - (({a}) / {n}) * (({a}) / {n}))"),
}


def sql_segments(kind: str, label: str, most: int = 16) -> str:
    """Segments are halved level by level, from left to right, until there are `most`. A level halves one at least, or is the last.

    A segment's cuts are folded in order with what the last cut that was taken has left: its losses weigh the next ones.
    """
    one, two, loss = _SEGMENTS[kind]
    levels = most - 1
    cell = "{'c': c, 'l': l, 'r': r, 'x': nx, 'll': 0::DOUBLE, 'rl': whole, 'best': whole}"
    taken = "{'c': e.c, 'l': e.l, 'r': e.r, 'x': e.x, 'll': e.l, 'rl': e.r, 'best': (s.ll * e.c + s.rl * (n - e.c)) / n}"
    text = (
        f"WITH p AS (SELECT {KEY} AS key, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS e, ({label})::DOUBLE AS y FROM lineitem), "
        f"s AS (SELECT * FROM p WHERE {sql_uniform('key', 1, 501)} < 5000::DOUBLE / greatest((SELECT count(*) FROM lineitem), 1)), "
        "u AS (SELECT 'l_quantity' AS feature, q AS x, y FROM s UNION ALL SELECT 'l_extendedprice', e, y FROM s), "
        f"g0 AS (SELECT feature, 0 AS seg, x, count(*)::DOUBLE AS n, sum(({one})::DOUBLE) AS a, sum(({two})::DOUBLE) AS b FROM u GROUP BY ALL)"
    )
    for i in range(levels):
        text += (
            f", w{i} AS (SELECT feature, seg, x, lead(x) OVER r AS nx, sum(n) OVER (r ROWS UNBOUNDED PRECEDING) AS c, sum(a) OVER (r ROWS UNBOUNDED PRECEDING) AS ca, sum(b) OVER (r ROWS UNBOUNDED PRECEDING) AS cb, "
            f"sum(n) OVER p AS n, sum(a) OVER p AS a, sum(b) OVER p AS b FROM g{i} WINDOW p AS (PARTITION BY feature, seg), r AS (PARTITION BY feature, seg ORDER BY x)), "
            f"v{i} AS (SELECT feature, seg, x, nx, n, c, {loss('n', 'a', 'b')} AS whole, {loss('c', 'ca', 'cb')} AS l, CASE WHEN nx IS NOT NULL THEN {loss('(n - c)', '(a - ca)', '(b - cb)')} END AS r FROM w{i}), "
            f"m{i} AS (SELECT feature, seg, any_value(n) AS n, any_value(whole) AS whole, coalesce(list({cell} ORDER BY x) FILTER (nx IS NOT NULL), []) AS cuts FROM v{i} GROUP BY feature, seg), "
            "f%d AS (SELECT feature, seg, list_reduce(list_prepend({'c': 0::DOUBLE, 'l': 0::DOUBLE, 'r': 0::DOUBLE, 'x': NULL::DOUBLE, 'll': 0::DOUBLE, 'rl': whole, 'best': whole}, cuts), lambda s, e: CASE WHEN (s.ll * e.c + s.rl * (n - e.c)) / n < s.best THEN %s ELSE s END).x AS cut FROM m%d), " % (i, taken, i)
            + f"k{i} AS (SELECT feature, seg, CASE WHEN row_number() OVER (PARTITION BY feature, cut IS NULL ORDER BY seg) <= {most} - count(*) OVER (PARTITION BY feature) THEN cut END AS cut FROM f{i}), "
            f"g{i + 1} AS (SELECT feature, seg * 2 + coalesce(x >= cut, false)::INT AS seg, x, n, a, b FROM g{i} JOIN k{i} USING (feature, seg))"
        )
    return text + f" SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY edge) - 2)::INT AS nth, edge FROM (SELECT feature, seg, min(x) AS edge FROM g{levels} GROUP BY feature, seg) z QUALIFY nth >= 0"


def segmented(kind: str):
    def run(spark, sf):
        df = items(spark, sf).withColumn("big", (F.col("l_extendedprice") > 40_000).cast("int")).withColumn("key", F.expr(KEY))
        _, bins = Segmenting(kind, key="key").find(df, "big" if kind == "entropy" else "l_linenumber", ["l_quantity", "l_extendedprice"], set(), 16, 2 if kind == "entropy" else None)
        return edges_frame(spark, bins)

    return run


for _name, _kind in (("bins_equal_frequency", "size"), ("bins_entropy", "entropy"), ("bins_variance", "variance")):
    QUERIES[_name] = segmented(_kind)
    SQL[_name] = sql_segments(_kind, "l_extendedprice > 40000" if _kind == "entropy" else "l_linenumber")

# Losses ---------------------------------------------------------------------------------------------------------------

#: Label and raw prediction of each loss's queries, and its formulas in DuckDB.
YES = "(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)"
P1 = "least(greatest(1 / (1 + exp(-f)), 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
P2 = "least(greatest(1 / (1 + exp(-2 * f)), 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
EF = "exp(least(greatest(f, -19::DOUBLE), 19::DOUBLE))"
CAP = "ln(0.9::DOUBLE / 0.1::DOUBLE)"
ODDS = "ln(sum(y) / (count(*) - sum(y)))"
CASES = {
    "gaussian": ("l_extendedprice", "l_quantity * 1500", {"init": "avg(y)", "gradient": "y - f", "deviance": "avg((y - f) * (y - f)) / 1e6", "mean": "f"}),
    "laplacian": ("l_extendedprice", "l_quantity * 1500", {"init": "percentile_disc(0.5) WITHIN GROUP (ORDER BY y DESC)", "gradient": "sign(y - f)::DOUBLE", "deviance": "avg(abs(y - f))", "mean": "f", "node_estimate": "percentile_disc(0.5) WITHIN GROUP (ORDER BY (y - f) DESC)"}),
    "poisson": ("l_linenumber", "l_discount * 10", {"init": "ln(avg(y))", "gradient": f"y - {EF}", "deviance": f"-2 * avg(y * f - {EF})", "mean": EF, "node_estimate": f"ln(sum(y) / sum({EF}))"}),
    "logloss": (YES, "(l_quantity - 25) / 10", {"init": ODDS, "gradient": f"y - {P1}", "deviance": f"-avg(y * ln({P1}) + (1 - y) * ln(1 - {P1}))", "mean": P1, "node_estimate": f"(sum(y) - sum({P1})) / (sum({P1}) - sum({P1} * {P1}))"}),
    "adaboost": (YES, "(l_quantity - 25) / 10", {"init": f"{ODDS} / 2", "gradient": "(2 * y - 1) * exp(-(2 * y - 1) * f)", "deviance": "avg(exp(-(2 * y - 1) * f))", "mean": P2, "node_estimate": "sum((2 * y - 1) * exp(-(2 * y - 1) * f)) / sum(exp(-(2 * y - 1) * f))"}),
    "hinge": (YES, "(l_quantity - 25) / 10", {"init": ODDS, "gradient": f"y * (0.12 - f > 0 AND 0.12 - f <= {CAP})::INT - (1 - y) * (f + 0.12 > 0 AND f + 0.12 <= {CAP})::INT", "deviance": f"avg(y * least(greatest(0.12 - f, 0), {CAP}) + (1 - y) * least(greatest(f + 0.12, 0), {CAP}))", "mean": "least(greatest(1 / (1 + exp(-f)), 0.1::DOUBLE), 0.9::DOUBLE)"}),
}


def loss_query(name: str, what: str):
    def run(spark, sf):
        label, raw, _ = CASES[name]
        df = items(spark, sf).select(F.expr(KEY).alias("key"), F.expr(label).cast("double").alias("y"), F.expr(raw).cast("double").alias("f"), F.lit(1.0).alias("w"))
        loss = loss_named(name)
        if what in ("gradient", "mean"):
            return df.select("key", F.round(loss.gradient() if what == "gradient" else loss.mean(), 6).cast("double").alias("value"))
        if name == "laplacian" and what != "deviance":
            value = loss.initial_of(df) if what == "init" else loss.estimates_of(df.withColumn("node", F.lit(1)))[1]
            return spark.createDataFrame([(round(value, 6),)], "value double")
        own: dict[str, Callable[[], Column]] = {"init": loss.initial, "deviance": loss.deviance, "node_estimate": loss.estimate}
        return df.agg(F.round(own[what]() / (1e6 if name == "gaussian" and what == "deviance" else 1), 6).alias("value"))

    return run


for _name, (_label, _raw, _formulas) in CASES.items():
    assert _name in LOSSES
    for _what, _formula in _formulas.items():
        _rows = f"(SELECT {KEY} AS key, {_label}::DOUBLE AS y, ({_raw})::DOUBLE AS f FROM lineitem)"
        QUERIES[f"loss_{_what}_{_name}"] = loss_query(_name, _what)
        SQL[f"loss_{_what}_{_name}"] = f"SELECT {'key, ' if _what in ('gradient', 'mean') else ''}round(({_formula})::DOUBLE, 6) AS value FROM {_rows}"

# Histograms and splits ------------------------------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LABEL = "floor(l_extendedprice / 100)"
LOST = "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END"


def binned(spark: SparkSession, sf: str, label: str = LABEL, names: list[str] | None = None, most: int = 8, missing: bool = False) -> tuple[DataFrame, list[Feature]]:
    names = names or FEATURES
    few = {n for n in names if n in ("l_returnflag", "l_linestatus", "l_linenumber")}
    df = items(spark, sf).withColumn("y", F.expr(label).cast("double"))
    if missing:
        df = df.withColumn("l_tax", F.expr(LOST))
    for j, n in enumerate(names):
        df = Encoder(n, dictionary({"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}[n])).encode(df, f"x_{j}") if n in few and n != "l_linenumber" else df.withColumn(f"x_{j}", number(n))
    own = [f"x_{j}" for j in range(len(names))]
    _, bins = EqualWidth().find(df, "y", own, {f"x_{j}" for j, n in enumerate(names) if n in few}, most)
    rows = discretize(df, bins).select("y", F.lit(1.0).alias("w_0"), F.expr(KEY).alias("key"), *[F.col(f"b_x_{j}").alias(f"b_{j}") for j in range(len(names))])
    return rows, [Feature(n, bins[x]) for n, x in zip(names, own, strict=True)]


_NUM = {"l_quantity": "q", "l_discount": "d", "l_tax": "t"}
_BINNED = (
    "WITH e AS (SELECT min(l_quantity) AS lq, max(l_quantity) AS hq, min(l_discount) AS ld, max(l_discount) AS hd, min(l_tax) AS lt, max(l_tax) AS ht FROM lineitem), "
    f"b AS (SELECT {KEY} AS key, {LABEL} AS y, l_returnflag, " + ", ".join(f"{sql_bin(n, 'l' + a, 'h' + a, 8)} AS b{j}" for j, (n, a) in enumerate(_NUM.items())) + ", "
    "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS b3, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS b4 FROM lineitem, e), "
    "long AS (" + " UNION ALL ".join(f"SELECT {j} AS feature, b{j} AS bin, y, l_returnflag FROM b" for j in range(5)) + "), "
    "h AS (SELECT feature, bin, count(*)::DOUBLE AS s0, sum(y)::DOUBLE AS s1, sum(y * y)::DOUBLE AS s2 FROM long GROUP BY ALL)"
)


def sql_variance(s: str) -> str:
    return f"(CASE WHEN {s}0 > 0 THEN {s}0 * ({s}2 / {s}0 - ({s}1 / {s}0) * ({s}1 / {s}0)) ELSE 0 END)"


def _candidates(where: str, place: str, head: str = _BINNED, valid: str = "bin < 7") -> str:
    sums = ", ".join(f"sum(s{k}) OVER w AS l{k}, sum(s{k}) OVER (PARTITION BY feature) AS t{k}" for k in range(3))
    return (
        f"{head}, o AS (SELECT *, {place} AS place FROM h WHERE {where}), "
        f"c AS (SELECT feature, bin, count(*) OVER w AS nth, {sums} FROM o WINDOW w AS (PARTITION BY feature ORDER BY place, bin ROWS UNBOUNDED PRECEDING)), "
        "d AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM c), "
        f"x AS (SELECT feature::INT AS feature, bin::INT AS bin, nth::INT AS nth, round(({sql_variance('l')} + {sql_variance('r')}) / t0, 4) AS impurity, l0 AS left_weight, r0 AS right_weight FROM d WHERE l0 > 0 AND r0 > 0 AND {valid})"
    )


def shown(c: DataFrame) -> DataFrame:
    return c.where("fine").select("feature", "bin", "nth", F.round("impurity", 4).alias("impurity"), F.col("l0").alias("left_weight"), F.col("r0").alias("right_weight"))


@query(f"{_BINNED} SELECT feature::INT AS feature, bin::INT AS bin, s0, s1, s2 FROM h")
def hist_variance(spark, sf):
    rows, features = binned(spark, sf)
    return sql_histogram(rows, [root()], features, [(0, 1)]).drop("tree", "node")


@query(SQL["hist_variance"])
def hist_partials(spark, sf):
    """The same table from partial sums over Arrow batches."""
    rows, features = binned(spark, sf)
    return arrow_histogram(rows, [root()], features, [(0, 1)]).drop("tree", "node")


@query(f"{_BINNED} SELECT feature::INT AS feature, bin::INT AS bin, " + ", ".join(f"count(*) FILTER (l_returnflag = '{c}')::DOUBLE AS s{k}" for k, c in enumerate("ANR")) + " FROM long WHERE feature < 3 GROUP BY ALL")
def hist_class(spark, sf):
    rows, features = binned(spark, sf, "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end", FEATURES[:3])
    return sql_histogram(rows, [root()], features, [(0, 1)], 3).drop("tree", "node")


@query(SQL["hist_variance"])
def hist_grouping_sets(spark, sf):
    """The same table by GROUPING SETS over the bin columns."""
    rows, features = binned(spark, sf)
    rows.createOrReplaceTempView("grovemill_rows")
    n = len(features)
    sets = ", ".join(f"(b_{j})" for j in range(n))
    which = "case " + " ".join(f"when grouping(b_{j}) = 0 then {j}" for j in range(n)) + " end"
    return spark.sql(f"select {which} as feature, cast(coalesce({', '.join(f'b_{j}' for j in range(n))}) as int) as bin, sum(w_0) as s0, sum(w_0 * y) as s1, sum(w_0 * y * y) as s2 from grovemill_rows group by grouping sets ({sets})")


def root() -> Tree:
    return Tree({1: Node(1, 1, 0.0, 0.0, 0.0, 0.0)})


def hist_of(spark, sf, **how):
    rows, features = binned(spark, sf, **how)
    return sql_histogram(rows, [root()], features, [(0, 1)]), features


@query(_candidates("feature < 3", "bin") + " SELECT * FROM x")
def split_numeric(spark, sf):
    hist, features = hist_of(spark, sf, names=FEATURES[:3])
    return shown(candidates(hist, features, 0, "ordered"))


_NAN = (
    f"WITH e AS (SELECT min(l_tax) AS lt, max(l_tax) AS ht FROM lineitem WHERE l_linenumber <> 1), b AS (SELECT {LABEL} AS y, l_linenumber = 1 AS gone, {sql_bin('l_tax', 'lt', 'ht', 7)} AS bin FROM lineitem, e), "
    "n AS (SELECT count(*)::DOUBLE AS n0, sum(y)::DOUBLE AS n1, sum(y * y)::DOUBLE AS n2 FROM b WHERE gone), "
    "h AS (SELECT bin, count(*)::DOUBLE AS s0, sum(y)::DOUBLE AS s1, sum(y * y)::DOUBLE AS s2 FROM b WHERE NOT gone GROUP BY bin), "
    "c AS (SELECT bin, " + ", ".join(f"sum(s{k}) OVER (ORDER BY bin) AS l{k}, sum(s{k}) OVER () - sum(s{k}) OVER (ORDER BY bin) AS r{k}" for k in range(3)) + ", sum(s0) OVER () AS all0 FROM h) "
    f"SELECT bin::INT AS bin, round(({sql_variance('l')} + {sql_variance('r')} + {sql_variance('n')}) / (all0 + n0), 4) AS impurity, l0 AS left_weight, r0 AS right_weight, n0 AS missing_weight FROM c, n WHERE bin < 6"
)


@query(_NAN)
def split_numeric_nan(spark, sf):
    hist, features = hist_of(spark, sf, names=["l_tax"], missing=True)
    return candidates(hist, features, 0, "ordered").where("fine").select("bin", F.round("impurity", 4).alias("impurity"), F.col("l0").alias("left_weight"), F.col("r0").alias("right_weight"), F.col("n0").alias("missing_weight"))


@query(_candidates("feature >= 3", "s1 / s0", valid="true") + " SELECT * FROM x")
def split_cat_ordered(spark, sf):
    hist, features = hist_of(spark, sf)
    return shown(candidates(hist, features, 0, "ordered")).where("feature >= 3")


@query(f"{_BINNED} SELECT feature::INT AS feature, round(sum({sql_variance('s')}) / sum(s0), 4) AS impurity, count(*)::INT AS children FROM h WHERE feature >= 3 GROUP BY feature")
def split_cat_multiway(spark, sf):
    hist, features = hist_of(spark, sf)
    c = candidates(hist, features, 0, "multiway").where("fine and feature >= 3")
    return c.select("feature", F.round("impurity", 4).alias("impurity"), F.col("filled").cast("int").alias("children"))


def _entropy(p: str) -> str:
    w = f"({p}0 + {p}1 + {p}2)"
    return "(" + " + ".join(f"CASE WHEN {p}{k} > 0 THEN -{p}{k} * log2({p}{k} / {w}) ELSE 0 END" for k in range(3)) + ")"


def _gini(p: str) -> str:
    w = f"({p}0 + {p}1 + {p}2)"
    return f"({w} - " + " - ".join(f"{p}{k} * {p}{k} / {w}" for k in range(3)) + ")"


def _split_class(weighted: Callable[[str], str]) -> str:
    """weighted: the SQL of a side's impurity times its weight."""
    return (
        f"{_BINNED}, k AS ({SQL['hist_class'][len(_BINNED) :]}), c AS (SELECT feature, bin, "
        + ", ".join(f"sum(s{k}) OVER w AS l{k}, sum(s{k}) OVER (PARTITION BY feature) - sum(s{k}) OVER w AS r{k}" for k in range(3))
        + f" FROM k WINDOW w AS (PARTITION BY feature ORDER BY bin)) SELECT feature, bin, round(({weighted('l')} + {weighted('r')}) / (l0 + l1 + l2 + r0 + r1 + r2), 9) AS impurity FROM c WHERE bin < 7 AND r0 + r1 + r2 > 0"
    )


def _class_candidates(spark, sf, impurity=None):
    rows, features = binned(spark, sf, "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end", FEATURES[:3])
    c = candidates(sql_histogram(rows, [root()], features, [(0, 1)], 3), features, 3, "ordered", impurity=impurity)
    return c.where("fine").select("feature", "bin", F.round("impurity", 9).alias("impurity"))


@query(_split_class(_entropy))
def split_class_entropy(spark, sf):
    return _class_candidates(spark, sf)


@query(_split_class(_gini))
def split_class_gini(spark, sf):
    return _class_candidates(spark, sf, Gini())


_BEST = _candidates("feature < 3", "bin") + " SELECT feature, bin, impurity, left_weight, right_weight FROM x ORDER BY impurity, feature, nth LIMIT 1"


@query(_BEST)
def best_split(spark, sf):
    hist, features = hist_of(spark, sf, names=FEATURES[:3])
    b = best_splits(hist, features, 0, "ordered").select("best.*")
    return b.select("feature", "bin", F.round("impurity", 4).alias("impurity"), F.col("l")[0].alias("left_weight"), F.col("r")[0].alias("right_weight"))


# Trees ----------------------------------------------------------------------------------------------------------------


def fixed(cut: int, flags: dict[int, int], values: tuple[float, float, float]) -> Tree:
    """Quantity below a cut, then the return flag on the right: three leaves."""
    out = Tree()
    out.add(Node(1, 1, 0.0, 0.0, 4.0, 100.0, Split(0, NUMERIC, 2.0, 3, cut, 2, 3)))
    out.add(Node(2, 2, values[0], 0.0, 1.0, 40.0))
    out.add(Node(3, 2, 0.0, 0.0, 2.5, 60.0, Split(1, SUBSET, 1.0, 5, children={b: 4 + side for b, side in flags.items()})))
    out.add(Node(4, 3, values[1], 0.0, 1.0, 20.0))
    out.add(Node(5, 3, values[2], 0.0, 1.0, 40.0))
    return out


def fixed_features() -> tuple[list[Feature], list[Encoder]]:
    from grovemill.operators.binning import CategoryBins, NumericBins

    return [Feature("l_quantity", NumericBins((10.0, 20.0, 30.0, 40.0))), Feature("l_returnflag", CategoryBins(3))], [Encoder("l_quantity"), Encoder("l_returnflag", dictionary(["A", "N", "R"]))]


TREES = [fixed(2, {0: 0, 1: 1}, (1.0, 2.0, 0.0)), fixed(3, {1: 0, 2: 1}, (2.0, 2.0, 1.0)), fixed(1, {0: 1, 2: 0}, (0.0, 1.0, 1.0))]
_LEAVES = [
    "(CASE WHEN l_quantity < 20 THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 0 END)::DOUBLE",
    "(CASE WHEN l_quantity < 30 THEN 2 WHEN l_returnflag = 'N' THEN 2 ELSE 1 END)::DOUBLE",
    "(CASE WHEN l_quantity < 10 THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 1 END)::DOUBLE",
]


@query("SELECT CASE WHEN l_quantity < 20 THEN 2 WHEN l_returnflag = 'A' THEN 4 ELSE 5 END AS node, count(*) AS n FROM lineitem GROUP BY 1")
def route_children(spark, sf):
    features, own = fixed_features()
    df = items(spark, sf)
    df = own[1].encode(df.withColumn("x_0", number("l_quantity")), "x_1")
    at = TREES[0].on_values(features, lambda n: F.lit(n.id), lambda j: F.col(f"x_{j}"))
    return df.groupBy(at.alias("node")).agg(F.count("*").alias("n"))


@query(SQL["route_children"])
def node_update(spark, sf):
    """The same over bin ids."""
    features, own = fixed_features()
    df = own[1].encode(items(spark, sf).withColumn("x_0", number("l_quantity")), "x_1")
    df = discretize(df, {"x_0": features[0].bins, "x_1": features[1].bins})
    return df.groupBy(TREES[0].on_bins(features, lambda n: F.lit(n.id), "b_x_{}").alias("node")).agg(F.count("*").alias("n"))


@query(f"SELECT {KEY} AS key, round(0.5 + 0.1 * ({' + '.join(_LEAVES)}), 9) AS prediction FROM lineitem")
def gbt_predict_fixed(spark, sf):
    model = BoostedTrees(*fixed_features(), TREES, loss_named("gaussian"), 0.5, 0.1)
    return model.transform(items(spark, sf)).select(F.expr(KEY).alias("key"), F.round("prediction", 9).alias("prediction"))


@query(f"WITH r AS (SELECT {KEY} AS key, [{', '.join(_LEAVES)}] AS v FROM lineitem), s AS (SELECT key, [len(list_filter(v, lambda x: x = c)) FOR c IN [0, 1, 2]] AS n FROM r) SELECT key, (list_position(n, list_max(n)) - 1)::INT AS prediction, round(list_max(n) / 3, 9) AS share FROM s")
def forest_vote(spark, sf):
    out = RandomForest(*fixed_features(), TREES, 3).transform(items(spark, sf))
    return out.select(F.expr(KEY).alias("key"), "prediction", F.round(F.col("votes")[0]["share"], 9).alias("share"))


@query(f"WITH r AS (SELECT {KEY} AS key, [{', '.join(_LEAVES)}] AS v FROM lineitem) SELECT key, round(list_avg(v), 9) AS mean, round(list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) * list_avg(v), 9) AS variance FROM r")
def forest_mean_var(spark, sf):
    out = RandomForest(*fixed_features(), TREES).transform(items(spark, sf))
    return out.select(F.expr(KEY).alias("key"), F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"))


def sql_pure_variance(s: str) -> str:
    square, mean = f"({s}2 / {s}0)", f"({s}1 / {s}0)"
    v = f"({square} - {mean} * {mean})"
    return f"(CASE WHEN {s}0 > 0 THEN CASE WHEN {v} <= 1e-12 * greatest(1, {square}) THEN 0 ELSE {v} END ELSE 0 END)"


def sql_tree(t: str, rows: str, depth: int, least: float = 2) -> str:
    """Chained tables of a regression tree over rows (y, w, b0 to b4): {t}_n1, {t}_n2, ... are rows by level with their path
    from the root; {t}_nodes has every node."""
    out, sums = [f"{t}_n1 AS (SELECT *, '' AS path FROM ({rows}) q)"], ", ".join(f"sum(s{k}) OVER v AS l{k}, sum(s{k}) OVER (PARTITION BY path, feature) AS t{k}" for k in range(3))
    nodes = []
    for d in range(1, depth + 1):
        long = " UNION ALL ".join(f"SELECT path, {j} AS feature, b{j} AS bin, y, w FROM {t}_n{d}" for j in range(5))
        out.append(f"{t}_h{d} AS (SELECT path, feature, bin, sum(w) AS s0, sum(w * y) AS s1, sum(w * y * y) AS s2 FROM ({long}) q WHERE w > 0 GROUP BY ALL)")
        out.append(f"{t}_t{d} AS (SELECT path, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2 FROM {t}_h{d} WHERE feature = 0 GROUP BY path)")
        node = f"SELECT path, {d} AS depth, s0 AS weight, s1 / s0 AS prediction, {sql_pure_variance('s')} AS impurity"
        if d == depth:
            nodes.append(f"{node}, NULL AS feature, NULL AS after FROM {t}_t{d}")
            break
        out.append(f"{t}_o{d} AS (SELECT *, CASE WHEN feature < 3 THEN bin ELSE s1 / s0 END AS place FROM {t}_h{d})")
        out.append(f"{t}_c{d} AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM (SELECT path, feature, bin, count(*) OVER v AS nth, {sums} FROM {t}_o{d} WINDOW v AS (PARTITION BY path, feature ORDER BY place, bin ROWS UNBOUNDED PRECEDING)) q)")
        value = f"(l0 * {sql_pure_variance('l')} + r0 * {sql_pure_variance('r')}) / t0"
        out.append(f"{t}_x{d} AS (SELECT path, feature, bin, nth, {value} AS after, {sql_pure_variance('t')} AS whole, t0 FROM {t}_c{d} WHERE l0 > 0 AND r0 > 0 AND (feature > 2 OR bin < 7))")
        out.append(f"{t}_b{d} AS (SELECT * FROM {t}_x{d} WHERE after < whole AND t0 >= {least} QUALIFY row_number() OVER (PARTITION BY path ORDER BY after, feature, nth) = 1)")
        out.append(f"{t}_l{d} AS (SELECT b.path, b.feature, any_value(b.bin) AS cut, list(c.bin) AS lefts FROM {t}_b{d} b JOIN {t}_c{d} c ON c.path = b.path AND c.feature = b.feature AND c.nth <= b.nth GROUP BY b.path, b.feature)")
        goes = "CASE WHEN CASE WHEN l.feature < 3 THEN [b0, b1, b2][l.feature + 1] <= l.cut ELSE list_contains(l.lefts, [b3, b4][l.feature - 2]) END THEN 'L' ELSE 'R' END"
        out.append(f"{t}_n{d + 1} AS (SELECT n.* EXCLUDE (path), n.path || {goes} AS path FROM {t}_n{d} n JOIN {t}_l{d} l ON n.path = l.path)")
        nodes.append(f"{node}, b.feature, b.after FROM {t}_t{d} LEFT JOIN (SELECT path, feature, after FROM {t}_b{d}) b USING (path)")
    out.append(f"{t}_nodes AS ({' UNION ALL '.join(nodes)})")
    return ", ".join(out)


NODE_SQL = f"path, depth::INT AS depth, weight::DOUBLE AS weight, round(prediction, 6) AS prediction, round(impurity, 4) AS impurity, CASE feature {' '.join(f'WHEN {j} THEN {n!r}' for j, n in enumerate(FEATURES))} END AS feature"
_IMPORTANCE = "SELECT name AS feature, round(coalesce(sum((impurity - after) * weight), 0), 2) AS importance FROM (VALUES " + ", ".join(f"({j}, '{n}')" for j, n in enumerate(FEATURES)) + ") f(j, name) LEFT JOIN ({}) n ON n.feature = f.j GROUP BY name"


def placed_nodes(tree: Tree) -> list[tuple]:
    """Of each node: its path from the root by left and right, depth, weight, prediction, impurity, and the split's feature."""
    out, work = [], [(1, "")]
    while work:
        i, path = work.pop()
        n = tree.nodes[i]
        out.append((path, n.depth, float(n.weight), round(n.prediction, 6), round(float(n.impurity), 4), FEATURES[n.split.feature] if n.split else None))
        work += [(c, path + "LR"[k]) for k, c in enumerate(sorted(set(n.split.targets())))] if n.split else []
    return out


NODE_SCHEMA = "path string, depth int, weight double, prediction double, impurity double, feature string"


@query(
    f"{_candidates('feature < 3', 'bin')}, best AS (SELECT * FROM x ORDER BY impurity, feature, nth LIMIT 1), side AS (SELECT y, CASE best.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= best.bin AS low FROM b, best) "
    "SELECT 1 AS node, count(*)::DOUBLE AS weight, round(avg(y), 6) AS prediction FROM side UNION ALL SELECT CASE WHEN low THEN 2 ELSE 3 END, count(*)::DOUBLE, round(avg(y), 6) FROM side GROUP BY low"
)
def tree_fit_stump(spark, sf):
    rows, features = binned(spark, sf, names=FEATURES[:3])
    tree = grow(rows, features, GrowOptions(max_depth=2))[0]
    return spark.createDataFrame([(n.id, n.weight, round(n.prediction, 6)) for n in tree.nodes.values()], "node int, weight double, prediction double")


@query(f"{_BINNED}, {sql_tree('q', 'SELECT y, 1 AS w, b0, b1, b2, b3, b4 FROM b', 3)} SELECT {NODE_SQL} FROM q_nodes")
def tree_fit_depth3(spark, sf):
    rows, features = binned(spark, sf)
    return spark.createDataFrame(placed_nodes(grow(rows, features, GrowOptions(max_depth=3))[0]), NODE_SCHEMA)


@query(
    f"{_candidates('feature < 3', 'bin')}, best AS (SELECT * FROM x ORDER BY impurity, feature, nth LIMIT 1), side AS (SELECT key, y, CASE best.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= best.bin AS low FROM b, best), "
    "m AS (SELECT avg(y) AS mean FROM b), g AS (SELECT low, avg(y) - any_value(mean) AS up FROM side, m GROUP BY low) SELECT key, round(mean + 0.1 * up, 6) AS prediction FROM side JOIN g USING (low), m"
)
def gbt_round1(spark, sf):
    df = items(spark, sf).withColumn("y", F.expr(LABEL).cast("double")).withColumn("key", F.expr(KEY))
    options = BoostOptions(trees=1, max_depth=2, shrinkage=0.1, bag_rate=1.0, training=1.0, binning=BinningOptions(Discretization.EQUAL_WIDTH, most_bins=8))
    model = boost(df, "y", FEATURES[:3], options=options, key="key")
    return model.transform(df).select("key", F.round("prediction", 6).alias("prediction"))


EIGHT = BinningOptions(Discretization.EQUAL_WIDTH, most_bins=8)
#: Two rounds of boosting by stumps: predictions before each tree, and after both.
_ROUNDS = f"{_BINNED}, f0 AS (SELECT *, y AS label, u < 0.8 AS training, avg(y) FILTER (u < 0.8) OVER () AS f FROM (SELECT *, {sql_uniform('key', 1, 0)} AS u FROM b) q)" + "".join(
    ", " + sql_tree(f"g{i}", f"SELECT * EXCLUDE (y), label - f AS y, (training AND {sql_uniform('key', 1, i)} <= 0.5)::INT AS w FROM f{i - 1}", 2, 10)
    + f", f{i} AS (SELECT r.* EXCLUDE (y, w, path, f), r.label AS y, r.f + 0.3 * n.prediction AS f FROM g{i}_n2 r JOIN g{i}_nodes n ON n.path = r.path)"
    for i in (1, 2)
)
_DEVIANCES = _ROUNDS + ", d AS (" + " UNION ALL ".join(f"SELECT {i} AS trees, avg((label - f) * (label - f)) FILTER (training) AS t, avg((label - f) * (label - f)) FILTER (NOT training) AS v FROM f{i}" for i in range(3)) + ")"


def trained(spark: SparkSession, sf: str) -> BoostedTrees:
    df = items(spark, sf).withColumn("key", F.expr(KEY)).withColumn("y", F.expr(LABEL).cast("double"))
    return boost(df, "y", FEATURES, {"l_returnflag", "l_linestatus"}, BoostOptions(trees=2, max_depth=2, shrinkage=0.3, binning=EIGHT), key="key")


@query(f"{_DEVIANCES} SELECT trees, round(t, 4) AS train_deviance, round(v, 4) AS validation_deviance FROM d")
def gbt_deviance_history(spark, sf):
    return trained(spark, sf).history(spark).select("trees", *[F.round(c, 4).alias(c) for c in ("train_deviance", "validation_deviance")])


@query(f"{_DEVIANCES} SELECT arg_min(trees, v)::INT AS trees FROM d WHERE trees > 0")
def optimal_tree_count(spark, sf):
    return spark.createDataFrame([(trained(spark, sf).best,)], "trees int")


@query(f"{_ROUNDS} {_IMPORTANCE.format('SELECT * FROM g1_nodes UNION ALL SELECT * FROM g2_nodes')}")
def var_importance(spark, sf):
    return trained(spark, sf).importance_frame(spark).select("feature", F.round("importance", 2).alias("importance"))


_CDF = "cdf AS (SELECT k, sum(exp(-0.7) * pow(0.7, k) / factorial(k::INT)) OVER (ORDER BY k) AS c FROM range(20) t(k))"
_FOREST = f"{_BINNED}, {_CDF}" + "".join(
    f", u{t} AS (SELECT b.*, {sql_uniform('key', 1, t + 1)} AS u FROM b), " + sql_tree(f"p{t}", f"SELECT *, (SELECT count(*) FROM cdf WHERE c < u AND c < 1 - 1e-5) AS w FROM u{t}", 3) for t in (0, 1)
)


def planted(spark: SparkSession, sf: str) -> RandomForest:
    df = items(spark, sf).withColumn("key", F.expr(KEY)).withColumn("y", F.expr(LABEL).cast("double"))
    return forest(df, "y", FEATURES, {"l_returnflag", "l_linestatus"}, ForestOptions(trees=2, max_depth=3, bag_rate=0.7, binning=EIGHT), key="key")


@query(_FOREST + " " + " UNION ALL ".join(f"SELECT {t}::INT AS tree, {NODE_SQL} FROM p{t}_nodes" for t in (0, 1)))
def forest_fit(spark, sf):
    rows = [(t, *row) for t, tree in enumerate(planted(spark, sf).trees) for row in placed_nodes(tree)]
    return spark.createDataFrame(rows, "tree int, " + NODE_SCHEMA)


@query(f"{_FOREST} {_IMPORTANCE.format('SELECT * FROM p0_nodes UNION ALL SELECT * FROM p1_nodes')} ORDER BY importance DESC LIMIT 2")
def topk_importance(spark, sf):
    """The two features that took most from the impurity."""
    return planted(spark, sf).importance_frame(spark).select("feature", F.round("importance", 2).alias("importance")).orderBy(F.desc("importance")).limit(2)


# Sampling and order statistics ----------------------------------------------------------------------------------------


@query(f"SELECT {KEY} AS key, ({sql_uniform(KEY, 1, 1)} <= 0.7)::INT AS bag FROM lineitem")
def bag_bernoulli(spark, sf):
    return items(spark, sf).select(F.expr(KEY).alias("key"), bag_count(KEY, 0, 0.7).alias("bag"))


@query(f"WITH u AS (SELECT {KEY} AS key, {sql_uniform(KEY, 1, 2)} AS u FROM lineitem), cdf AS (SELECT k, sum(exp(-0.7) * pow(0.7, k) / factorial(k::INT)) OVER (ORDER BY k) AS c FROM range(20) t(k)) SELECT key, (SELECT count(*) FROM cdf WHERE c < u AND c < 1 - 1e-5)::INT AS bag FROM u")
def bag_poisson(spark, sf):
    return items(spark, sf).select(F.expr(KEY).alias("key"), bag_count(KEY, 1, 0.7, True).alias("bag"))


@query(f"SELECT {KEY} AS key, {sql_uniform(KEY, 1, 0)} < 0.8 AS training FROM lineitem")
def validation_split(spark, sf):
    return items(spark, sf).select(F.expr(KEY).alias("key"), is_training(KEY, 0.8).alias("training"))


@query("SELECT o_totalprice AS value FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET 99")
def kth_element(spark, sf):
    return kth(read(spark, sf, "orders"), "o_totalprice", 99)


@query("SELECT list_sort(list(o_totalprice))[count(*) // 2 + 1] AS value FROM orders")
def median_upper(spark, sf):
    return upper_median(read(spark, sf, "orders"), "o_totalprice")


@query(f"SELECT o_orderkey FROM orders ORDER BY {sql_uniform('o_orderkey', 1, 977)}, o_orderkey LIMIT 100")
def reservoir_sample(spark, sf):
    return reservoir(read(spark, sf, "orders"), 100, "o_orderkey").select("o_orderkey")


# The same results by other ways ------------------------------------------------------------------------------------------


@query(_candidates("feature >= 3", sql_uniform("(65536 + bin)::BIGINT", 1, 1), valid="true") + " SELECT * FROM x")
def split_cat_random(spark, sf):
    """Categories in the order of a hash; the tree is 0 and the node 1."""
    rows, features = binned(spark, sf)
    hist = sql_histogram(rows, [root()], features, [(0, 1)])
    return shown(candidates(hist, features, 0, "random")).where("feature >= 3")


@query(SQL["tree_fit_depth3"])
def tree_fit_subtrees(spark, sf):
    """Nodes of up to 20 000 rows are grown whole, in a task each."""
    rows, features = binned(spark, sf)
    return spark.createDataFrame(placed_nodes(grow(rows, features, GrowOptions(max_depth=3, subtree_weight=20_000))[0]), NODE_SCHEMA)


@query(SQL["tree_fit_depth3"])
def tree_fit_unpivoted(spark, sf):
    rows, features = binned(spark, sf)
    return spark.createDataFrame(placed_nodes(grow(rows, features, GrowOptions(max_depth=3, max_splits=1, engine="sql"))[0]), NODE_SCHEMA)


@query(SQL["gbt_predict_fixed"])
def model_saved_and_loaded(spark, sf):
    stash = Stash(spark)
    try:
        BoostedTrees(*fixed_features(), TREES, loss_named("gaussian"), 0.5, 0.1).save(spark, stash.folder)
        model = load(spark, stash.folder)
    finally:
        stash.drop()
    return model.transform(items(spark, sf)).select(F.expr(KEY).alias("key"), F.round("prediction", 9).alias("prediction"))


def flag_sums(rows: DataFrame) -> DataFrame:
    """Figures of each flag. For the greatest of texts Spark would sort all rows of a task by flag, as cells of its hash tables have
    fixed widths. Beside a set, here of one constant, it hashes into buffers of any type, for up to 128 flags a task."""
    own = rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("y").alias("least"), F.max("mode").alias("mode"), F.round(F.sum("l_quantity").cast("double"), 2).alias("quantity"), F.collect_set(F.lit(0)).alias("one"))
    return own.where(F.size("one") == 1).drop("one")


@query(f"SELECT l_returnflag, count(*) AS n, min({LABEL})::DOUBLE AS least, max(l_linestatus || '\t\"\\') AS mode, round(sum(l_quantity)::DOUBLE, 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def delimited_scan(spark, sf):
    """Written as delimited text with quotes, escapes and delimiters in fields, and read again."""
    stash = Stash(spark)
    try:
        df = items(spark, sf).select("l_returnflag", F.expr(LABEL).cast("double").alias("y"), F.concat("l_linestatus", F.lit('\t"\\')).alias("mode"), "l_quantity")
        df.write.options(sep="\t", header=True).csv(stash.folder)
        found = flag_sums(tables.read(spark, stash.folder, "csv", tables.Delimited(header=True), partitions=4))
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        stash.drop()


@query(SQL["gbt_round1"])
def runner_fit(spark, sf):
    """The first round again, from delimited text through the runner."""
    stash = Stash(spark)
    try:
        items(spark, sf).select(F.expr(LABEL).alias("y"), *FEATURES[:3]).write.options(sep="\t", header=True).csv(f"{stash.folder}/in")
        config = Config(f"{stash.folder}/in", f"{stash.folder}/out", headerExists=True, fracTraining=1.0, numTrees=1, maxTreeDepth=2, baggingRate=1.0, shrinkage=0.1, discType="equal_width", maxNumericBins=8)
        model = run(spark, config)
    finally:
        stash.drop()
    return model.transform(items(spark, sf)).select(F.expr(KEY).alias("key"), F.round("prediction", 6).alias("prediction"))


@query("SELECT k::INT AS classes, (SELECT count(DISTINCT l_linenumber) = k AND min(l_linenumber) = 1 AND max(l_linenumber) = k FROM lineitem) AS accepted FROM range(6, 9) t(k)")
def label_rules(spark, sf):
    """Labels are fine if they are all of the classes and nothing else."""
    out = []
    for k in (6, 7, 8):
        try:
            validate_label(summarize(items(spark, sf).withColumn("y", F.col("l_linenumber") - 1), "y", [], k)[0], k)
            out.append((k, True))
        except InvalidLabel:
            out.append((k, False))
    return spark.createDataFrame(out, "classes int, accepted boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

