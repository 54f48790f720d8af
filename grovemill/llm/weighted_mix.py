"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Sources share the size of the whole corpus by weight; none gets more than `most` times its own size, and what is above is
shared again (water filling, in closed form over the sources in the order of their caps). A source's target is spent in
complete epochs first. The rest goes to documents in the order of exponential keys -ln(u) / weight, where u is a hash of
the document's id and the weight is its quality, until the prefix sum of sizes reaches the budget; the document on the
boundary gives the words that are left. Prefix sums are two-level: within narrow ranges of the key, and over the ranges'
totals, so no source is sorted in one task; a range that many equal keys make hot is cut further. Only DataFrame functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemill.llm.common import WORD, materialize, prefix_sums, whole_row

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 7
#: Key ranges of an octave.
STEPS = 4096
#: Up to so many sources are broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 50_000
SYMBOLS = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: falls with the share of symbols among the characters."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.1), 1 - 4 * symbols / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """Between 0 and 1 by the id's MD5; the same in every run and engine."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(has, name, source_size, target) per source. Its windows run over one row a source."""
    by_name = Window.orderBy(F.col("has").desc(), "name")
    sources = sized.groupBy("has", "name").agg(F.sum("size").alias("source_size")).withColumn("nth", F.row_number().over(by_name) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")).cast("bigint")).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    capped_before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn("level", (F.col("total") - capped_before) / weight_left)
    sources = sources.withColumn("capped", F.col("cap") / F.col("weight") < F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return sources.select("has", "name", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def key_range(key: Column) -> Column:
    """Numbers that go with the key: STEPS equal ranges in each octave, so whatever scales the keys, no range is wide."""
    octave = F.floor(F.log2(key))
    return (octave * STEPS + F.floor((key / F.pow(F.lit(2.0), octave) - 1) * STEPS)).cast("bigint")


def mix(documents: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted), one row per row; if whole, also `row`,
    a struct of all columns of documents, whose names therefore never meet those here.

    Null and empty texts have size 0 and take 0. A null source is a source of its own, last in order. Repeated rows are
    sampled as rows of their own; with equal keys, as rows without an id have, the smaller id, then the smaller size goes
    first. With no words at all every target is 0; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    weight = quality_weight(text) if weight is None else weight
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    own = documents.select("doc_id", "source", word_count(text).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("nth"), *([whole_row(documents).alias("row")] if whole else []))
    own = materialize(own.withColumns({"has": F.col("source").isNotNull(), "name": F.coalesce(F.col("source").cast("string"), F.lit("")), "range": key_range(F.col("key"))}))
    narrow = own.drop("row")
    share = materialize(targets(narrow.groupBy("has", "name").agg(F.sum("size").alias("size")), weights, most))
    share = F.broadcast(share) if share.count() <= BROADCAST_SOURCES else share
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    out = prefix_sums(narrow, ["has", "name"], "range", {"key": F.col("key"), "size": F.col("size")}, {"before": "size"}, order, "nth").join(share, ["has", "name"])
    budget = F.floor(F.col("target") + 0.5)
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0))
    rest = budget - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    out = out.withColumn("taken", taken.cast("bigint"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return own.select("nth", "row").join(out.select("nth", *columns), "nth").select(*columns, "row") if whole else out.select(*columns)


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows of documents: each once for every time that it is taken, a part of half its words or more as a whole.

    Columns of any name and type are kept. Rows without words are never taken, nor is anything of an empty table.
    """
    times = F.when(F.col("size") > 0, F.floor((F.col("taken") / F.col("size")) + 0.5)).otherwise(0).cast("int")
    out = mix(documents, whole=True, **options).select(times.alias("times"), "row").where("times > 0")
    return out.select(F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"), "row").select("row.*")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE)
         / greatest(0.1::DOUBLE, 1 - 4 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS key_
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][1 + nth % {len(WEIGHTS)}] AS BIGINT) AS weight, {MOST} * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
share AS (
  SELECT source, source_size, CASE WHEN cap::DOUBLE / weight < level THEN cap::DOUBLE
         ELSE weight * max(CASE WHEN NOT cap::DOUBLE / weight < level THEN level END) OVER () END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key_, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN share t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
            + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)) AS BIGINT) AS taken
FROM placed
"""
