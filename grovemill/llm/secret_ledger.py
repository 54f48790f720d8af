"""Secret scans over an incremental ledger of blobs.

Every version of every path is named by the SHA-256 of its text. The ledger has a row for each scanned blob: the rule
versions that it was scanned with, and the spans that they found; a row is written with its findings or not at all. A scan
takes the blobs for which some rule version is missing, elects one row for each by an aggregate over ids alone, reads the
texts of the elected rows only, and appends. Findings are joined back to all paths of a blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemill.llm.common import join_hot, materialize, scratch, slices


@dataclass(frozen=True)
class Rule:
    """All leftmost non-overlapping matches, of which those whose group has `least` characters are spans."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds first, in their order; the others add spans.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,rank:int,stop:int,rule:string>"


def spans(text: str, rules: list[tuple[int, Rule, re.Pattern]]) -> list[dict]:
    """start, rank of the rule, stop (exclusive), rule name; in code points."""
    return [{"start": m.start(), "rank": rank, "stop": m.end(), "rule": rule.name} for rank, rule, p in rules for m in p.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Ledger:
    """A folder of Parquet rows (blob, rules, spans) that all executors share."""

    SCHEMA = f"blob binary, rules array<string>, spans array<{SPAN}>"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        self.spark, self.path, self.rules, self.fresh = spark, path, rules, False
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fresh = not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    def rows(self) -> DataFrame:
        return self.spark.createDataFrame([], self.SCHEMA) if self.fresh else self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def todo(self, blobs: DataFrame) -> DataFrame:
        """blobs with a column blob, and the rule names that each of them lacks."""
        names = F.array(*[F.lit(r.name) for r in self.rules])
        if self.fresh:
            return blobs.withColumn("missing", names)
        seen = self.rows().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        lacking = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").withColumn("missing", lacking).where(F.size("missing") > 0).drop("seen")

    def scan(self, versions: DataFrame, named: DataFrame) -> None:
        """versions: path, text. named: path, blob of the same rows. Scans what is unseen, once for each blob, and appends it."""
        keys = {"at": F.coalesce("path", F.lit(0)), "lost": F.col("path").isNull()}
        elected = self.todo(named.groupBy("blob").agg(F.min("path").alias("path"))).withColumns(keys).drop("path")
        # Rows that repeat a path and its text are one before they move, and meet the elected ones where they are then.
        own = versions.select(digest(F.col("text")).alias("blob"), *[c.alias(n) for n, c in keys.items()], "text").groupBy("blob", *keys).agg(F.first("text").alias("text"))
        texts = own.join(elected, ["blob", *keys]).select("blob", "text", "missing")
        rules = [(k, r, re.compile(r.pattern, re.ASCII)) for k, r in enumerate(self.rules)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32()), ("rule", pa.string())]))
            for batch in batches:
                for part in slices(batch, "text"):
                    found = [spans(t or "", [x for x in rules if x[1].name in m]) for t, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, kind)], ["blob", "rules", "spans"])

        texts.mapInArrow(run, self.SCHEMA).write.mode("append").parquet(self.path)
        self.fresh = False

    def findings(self) -> DataFrame:
        """blob and all spans of the rule versions in force, by start, then rule. Rows of an interrupted and repeated scan count once."""
        names = [r.name for r in self.rules]
        own = self.rows().select("blob", F.filter("spans", lambda s: s["rule"].isin(names)).alias("spans")).where(F.size("spans") > 0)
        return own.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def digest(text) -> F.Column:
    """The blob's name; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def recorded(documents: DataFrame, ledger: str | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans the table. path and blob of every row; blob and spans of blobs with findings; blob and n, its rows."""
    spark = documents.sparkSession
    versions = documents.select(F.col("doc_id").cast("bigint").alias("path"), F.col("text").cast("string").alias("text"))
    named = materialize(versions.select("path", digest(F.col("text")).alias("blob")))
    book = Ledger(spark, ledger or scratch(spark), rules)
    book.scan(versions, named)
    found = materialize(book.findings())
    # Only blobs with findings can make the join back to the paths hot.
    sizes = materialize(named.groupBy("blob").agg(F.count("*").alias("n")).where("n > 1").join(found.select("blob"), "blob"))
    return named, found, sizes


def scan(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path (the doc_id) and spans of every row: array of (start, rank, stop, rule), never null.

    Null and empty texts are one blob without spans. Equal texts are scanned once, whatever their number of paths;
    repeated rows get equal rows, and null ids are paths like others. An empty table gives no rows.
    """
    named, found, sizes = recorded(documents, ledger, rules)
    none = F.array().cast(f"array<{SPAN}>")
    return join_hot(named, found, ["blob"], sizes, "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def listed(array: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", F.substring_index(s["rule"], "@", 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(array, one), ",")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    found = scan(documents)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def either_case(pattern: str) -> str:
    """(?i:...) spelt out for ASCII letters: DuckDB would fold others to them as well."""
    head, body, tail = re.fullmatch(r"(.*?)\(\?i:(.*)\)(.*)", pattern, re.DOTALL).groups() if "(?i:" in pattern else (pattern, "", "")
    words = re.sub(r"(?<![\[A-Za-z0-9\\-])[a-z]+(?![-\]])", lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]), body)
    return head + words + tail


def sql_rule(rank: int, rule: Rule) -> str:
    """All spans of a rule: the gaps before the matches and the matches themselves add up to where each begins."""
    pattern = either_case(rule.pattern).replace("'", "''")
    groups = re.compile(rule.pattern).groups
    every = lambda g: f"regexp_extract_all(text, '(.*?)({pattern})', {g}, 's')"
    return (
        f"SELECT doc_id, nth, {rank} AS rank, '{rule.kind}' AS kind, unnest({every(1)}) AS gap, unnest({every(2)}) AS hit, unnest({every(2 + rule.group if groups else 2)}) AS part, "
        f"generate_subscripts({every(1)}, 1) AS place, {rule.least} AS least FROM own"
    )


SQL = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS nth FROM documents),
hits AS ({" UNION ALL ".join(sql_rule(k, r) for k, r in enumerate(RULES))}),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY nth, rank ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM hits),
found AS (SELECT nth, rank, kind, stop - length(hit) AS start, stop FROM placed WHERE length(part) >= least),
listed AS (
  SELECT nth, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
         {", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, kind in enumerate(BASE))}
  FROM found GROUP BY nth)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM own LEFT JOIN listed USING (nth)
"""


def redact(text: str, found: list) -> str:
    """The text with each span, overlapping ones as one, replaced by a mark of its first rule."""
    out, at, merged = [], 0, []
    for s in sorted(found, key=lambda s: (s["start"], s["rank"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["stop"])
        else:
            merged.append([s["start"], s["stop"], s["rule"].split("@")[0]])
    for start, stop, kind in merged:
        out += [text[at:start], f"[{kind} removed]"]
        at = stop
    return "".join([*out, text[at:]])


def redacted_documents(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """The rows with their secrets replaced and n_chars counted anew; rows without secrets stay as they are.

    Columns of any name and type are kept. Null and empty texts, repeated rows and null ids stay; an empty table gives no rows.
    """
    _, found, sizes = recorded(documents, ledger, RULES)
    columns = documents.columns
    at = {c: i for i, c in enumerate(columns)}
    plain = documents.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{at['text']}"
    joined = join_hot(plain.withColumn("blob", digest(F.col(text).cast("string"))), found, ["blob"], sizes, "left").select(*plain.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                arrays, secret = list(part.columns[:-1]), part.column(len(columns)).to_pylist()
                if any(secret):
                    texts = [redact(t, s) if s else t for t, s in zip(part.column(at["text"]).to_pylist(), secret, strict=True)]
                    arrays[at["text"]] = pa.array(texts, part.schema.field(at["text"]).type)
                    if "n_chars" in at:
                        counts = [len(t) if s else n for t, s, n in zip(texts, secret, part.column(at["n_chars"]).to_pylist(), strict=True)]
                        arrays[at["n_chars"]] = pa.array(counts, part.schema.field(at["n_chars"]).type)
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return joined.mapInArrow(run, documents.schema)
