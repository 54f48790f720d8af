"""Quality by compression: a text is closer to the labelled texts whose zstandard dictionary compresses it better.

One dictionary is built from texts labelled good and one from texts labelled bad. A text is compressed in blocks with each,
so long texts are scored over their whole length and no block learns from the ones before. The difference of the two sizes,
normalised by the text's own bytes, is calibrated to a probability by logistic regression on labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from grovemill.llm.common import held_out, slices, texts_of

#: Bounds of the fit: labelled texts of each class, the length of a text that is used for it, and a dictionary's size.
TRAIN_TEXTS, TRAIN_CHARS, DICTIONARY = 2000, 20_000, 256 << 10
BLOCK, LEVEL, GOOD_FROM = 1024, 3, 0.3


def dictionary(texts: list[str], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """Trained on blocks of the texts; of few texts, their own bytes."""
    blocks = [b[i : i + BLOCK] for b in (t.encode() for t in texts) for i in range(0, len(b), BLOCK)]
    try:
        found = zstandard.train_dictionary(size, blocks)
    except zstandard.ZstdError:
        found = zstandard.ZstdCompressionDict(b"".join(blocks)[:size] or b"\n" * 64, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return found


class Sizes:
    """Bytes of a text under each dictionary, and its own."""

    def __init__(self, *dictionaries: bytes, level: int = LEVEL) -> None:
        self.compress = []
        for d in dictionaries:
            own = zstandard.ZstdCompressionDict(d)
            own.precompute_compress(level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] if len(raw) > BLOCK else [raw]
        return [*(sum(len(f(b)) for b in blocks) for f in self.compress), len(raw)]


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, sizes: np.ndarray) -> np.ndarray:
        """Normalised difference: above 0 if the good dictionary does better."""
        return (sizes[:, 1] - sizes[:, 0]) / np.maximum(sizes[:, 2], 1)

    def score(self, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(sizes) + self.shift, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (never below 0) and shift of a logistic regression, by Newton's method on a scaled x."""
    if not len(y):
        return 1.0, 0.0
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]) / scale, 0.0), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> Classifier:
    """From at most `texts` labelled texts of each class outside the held-out fold, each of at most `chars` characters.

    The texts are those of the ids with the smallest hashes, one for each id: the one with the smallest hash. Equal texts
    count once. Every second text builds the dictionaries, the others calibrate. Of several labels for one id the lowest
    counts; labels without quality are left out.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    picked = [known.where(c).withColumn("hash", F.xxhash64("doc_id")).orderBy("hash", "doc_id").limit(texts) for c in ("quality > 0", "quality <= 0")]
    # At most 2 * texts rows of three numbers: bounded by the parameter. So is what is collected, a text for each of them.
    sample = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text").between(1, chars)).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    own = sample.groupBy("hash", "doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = {r.text: r for r in sorted(own.collect(), key=lambda r: (r.hash, r.doc_id), reverse=True)}
    rows = sorted((r.hash, r.doc_id, r.quality, r.text) for r in rows.values())
    good, bad = ([t for *_, q, t in rows if (q > 0) == want] for want in (True, False))
    out = Classifier(dictionary(good[::2]).as_bytes(), dictionary(bad[::2]).as_bytes())
    if good and bad:
        sizes = Sizes(out.good, out.bad)
        x = out.margin(np.array([sizes(t) for t in [*good[1::2], *bad[1::2]]], np.float64).reshape(-1, 3))
        y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
        out.slope, out.shift = calibrate(x, y)
    else:
        out.shift = 3.0 if good else -3.0 if bad else 0.0
    return out


ADDED = StructType().add("good_bytes", LongType()).add("bad_bytes", LongType()).add("score", DoubleType()).add("predicted", IntegerType())


def classify(documents: DataFrame, model: Classifier, whole: bool = False) -> DataFrame:
    """doc_id (or, if whole, all columns), good_bytes, bad_bytes, score and predicted, for every row.

    Null and empty texts are compressed as empty ones: equal sizes, the score of margin 0. Without labels of both classes
    the score is one constant; without any it is 0.5. Repeated rows get equal scores; an empty table gives no rows.
    """
    documents = documents if whole else documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = documents.columns if whole else ["doc_id"]
    fields = StructType([f for f in documents.schema if f.name in own] + ADDED.fields)
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([sizes(t) for t in texts_of(part)], np.int64).reshape(-1, 3)
                score = model.score(found.astype(np.float64))
                kept = [part.column(part.schema.get_field_index(c)) for c in own]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(score), pa.array((score >= GOOD_FROM).astype(np.int32))], names)

    return documents.mapInArrow(run, fields)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, good_bytes, bad_bytes: fitted outside the held-out fold, scored everywhere."""
    return classify(documents, fit(documents, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "good_bytes", "bad_bytes")


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are predicted good, with all their columns, of any name and type.

    Null and empty texts are judged as empty ones, repeated rows alike; an empty table gives no rows.
    """
    columns = documents.columns
    plain = documents.toDF(*[c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(columns)])
    return classify(plain, fit(documents, labels), whole=True).where("predicted = 1").select(*plain.columns).toDF(*columns)
