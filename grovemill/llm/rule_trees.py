"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts in one Arrow pass. Trees are grown on the driver from a bounded sample of labelled rows,
on histograms of at most 64 bins a feature, under monotonic constraints: a split on a constrained feature is allowed only
if its children's values keep the order, and each child's subtree is held to its side of the middle of the two values.
The trees are flattened into node arrays, and a batch of rows walks all trees level by level with numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemill.llm.common import SPACES, materialize, slices, texts_of

#: At most so many labelled rows are used for fitting, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each feature and how the quality may go with it: -1 never up, 0 freely.
FEATURES = {"log_words": 0, "mean_chars": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "mark_rate": -1, "upper_rate": 0, "digit_rate": 0, "distinct_rate": 0, "top_word_rate": 0, "line_rate": 0}
#: A document is dropped if the trees give less than this for its quality.
KEEP = 0.3


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in 3-word windows which the text has twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 2_000_000:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(ids), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = twice.copy()
    inside[1:] |= twice[:-1]
    inside[2:] |= twice[:-2]
    return int(inside.sum())


def statistics(text: str) -> tuple:
    """The base counts, then the features, of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeat = repeated(ids, len(index))
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    upper, lower, digits, marks = int(at[65:91].sum()), int(at[97:123].sum()), int(at[48:58].sum()), int(at[33] + at[63])
    d = max(n, 1)
    top = int(np.bincount(ids).max()) if n else 0
    return (n, word_chars, symbols, dup, repeat, float(np.log1p(n)), word_chars / d, symbols / d, dup / max(len(lines), 1), repeat / d, marks / d, upper / max(upper + lower, 1), digits / max(word_chars, 1), len(index) / d, top / d, len(lines) / d)


SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def document_statistics(documents: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = zip(*map(statistics, texts_of(part)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64() if i < len(BASE) else pa.float64()) for i, c in enumerate(columns))], names)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


@dataclass
class Trees:
    """Node arrays, a row for each tree: feature (-1 at a leaf), threshold (x <= goes left), children, value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1 for each row of x."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, lo, hi, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                go = np.where(x[rows, np.maximum(f[at], 0)] <= t[at], lo[at], hi[at])
                at = np.where(inner, go, at)
            total += v[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the log loss. Without rows, or with one class, the model is a constant."""
    n, width = len(y), 2 ** (depth + 1) - 1
    mean = (y.sum() + 1) / (n + 2) if n else 0.5
    out = Trees(float(np.log(mean / (1 - mean))), np.full((trees, width), -1), np.zeros((trees, width)), np.zeros((trees, width), np.int64), np.zeros((trees, width), np.int64), np.zeros((trees, width)))
    if not n or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-12)
        work = [(0, np.arange(n), -np.inf, np.inf)]
        while work:
            node, own, low, high = work.pop()
            gs, hs = g[own].sum(), h[own].sum()
            out.value[t, node] = rate * float(np.clip(gs / (hs + ridge), low, high))
            best = (1e-6, None)
            if node < 2**depth - 1:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(code[own, j], g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[own, j], h[own], len(e) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    lv, rv = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = 2 * lv * gl - lv**2 * (hl + ridge) + 2 * rv * gr - rv**2 * (hr + ridge)
                    fine = (hl >= least / 4) & (hr >= least / 4)
                    if monotone[j]:
                        fine &= (rv - lv) * monotone[j] >= 0
                    v = float(np.clip(gs / (hs + ridge), low, high))
                    gain = np.where(fine, gain - (2 * v * gs - v**2 * (hs + ridge)), -1)
                    if gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (j, k, float(lv[k]), float(rv[k])))
            if best[1] is None:
                score[own] += out.value[t, node]
                continue
            j, k, lv, rv = best[1]
            # Heap order keeps the depth limit: children of node i are 2i + 1 and 2i + 2.
            out.feature[t, node], out.threshold[t, node] = j, edges[j][k]
            out.left[t, node], out.right[t, node] = 2 * node + 1, 2 * node + 2
            goes, middle = code[own, j] <= k, (lv + rv) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
            work += [(2 * node + 1, own[goes], *bounds[0]), (2 * node + 2, own[~goes], *bounds[1])]
    return out


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most `rows` labelled rows. Labels without quality are left out; of several for one id the lowest counts."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Ids whose hash is beyond what `rows` labels need don't reach the sort, so one task sees about `rows` rows of any table.
    share = min(1.0, (1.1 * rows + 1000) / max(known.count(), 1))
    known = known.where(F.xxhash64("doc_id") <= int(share * (2**64 - 1)) - 2**63) if share < 1 else known
    sample = materialize(stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *BASE).limit(rows).select("quality", *FEATURES)).collect()
    x = np.array([r[1:] for r in sample], np.float64).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([float(r[0] > 0) for r in sample]), list(FEATURES.values()))


def judge(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept, one row per document row.

    A null or empty text has no words and fails the base rules; repeated rows get equal rows; a null doc_id keeps its row
    but never counts as labelled. Without usable labels the base rules decide alone. An empty table gives no rows.
    """
    stats = materialize(document_statistics(documents))
    model = train(stats, labels)
    names = ["doc_id", *BASE, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1 + len(BASE) :]], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(BASE)], pa.array(model.score(x))], names)

    scored = stats.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep))
