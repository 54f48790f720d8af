import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from grovemill.llm import zstd_quality
from grovemill.llm.zstd_quality import Classifier, calibrate, dictionary, fit, good_documents, score_documents
from tests.llm.helpers import documents, empty, text


def labelled(spark, n=400):
    rng = random.Random(8)
    df, rows = documents(spark, 30)
    labels = [(None, 1, 0), (3, None, 0), (7, 1, 0), (7, 1, 1)]
    for i in range(1000, 1000 + n):
        good = rng.random() < 0.7
        body = text(rng, rng.choice([40, 200])) if good else " ".join(f"{rng.choice(['BUY', 'WIN', 'NOW', 'CLICK'])}!! {rng.randint(0, 99)}" for _ in range(rng.choice([20, 100])))
        rows.append((i, body, "en", "b", 1, 1, 2, "x"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, df.schema), rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_awkward_rows(spark):
    df, rows, labels = labelled(spark)
    out = score_documents(df, labels).collect()
    assert len(out) == len(rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    fold = [r for r in out if r.held_out and (r.doc_id or 0) >= 1000]
    assert len(fold) > 40 and np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in fold]) > 0.95
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    same = {}
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        assert same.setdefault(texts[r.doc_id], r.score) == r.score


def test_scores_against_a_row_by_row_computation(spark):
    import zstandard

    df, rows, labels = labelled(spark, 200)
    model, out = fit(df, labels), score_documents(df, labels).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        raw, size = texts[r.doc_id].encode(), {}
        for name, own in (("good", model.good), ("bad", model.bad)):
            pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_content_size=False, write_dict_id=False)
            size[name] = sum(len(pack.compress(raw[i : i + 1024])) for i in range(0, max(len(raw), 1), 1024))
        margin = (size["bad"] - size["good"]) / max(len(raw), 1)
        assert (r.good_bytes, r.bad_bytes) == (size["good"], size["bad"])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))) < 1e-12
    # The fit, from what it is documented to use: every second text, by the hash of its id.
    known = {}
    for r in labels.collect():
        if r.quality is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = min(r.quality, known.get(r.doc_id, 9))
    order = [r.doc_id for r in spark.createDataFrame([(k,) for k in known], "doc_id bigint").orderBy(F.xxhash64("doc_id")).collect()]
    own = [(known[i], texts[i]) for i in order if texts.get(i)]
    good, bad = ([t for q, t in own if q == want] for want in (1, 0))
    assert (model.good, model.bad) == (dictionary(good[::2]).as_bytes(), dictionary(bad[::2]).as_bytes())


def test_repeated_ids_and_texts_stay_within_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(zstd_quality, "dictionary", lambda texts: seen.append(texts) or dictionary(texts))
    rows = [(i % 2, f"text {i} of one id " * 20) for i in range(3000)] + [(i, "the same text " * 30) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 if i else 0) for i in (0, 1, *range(10, 60))], "doc_id bigint, quality int")
    assert isinstance(fit(df, labels, texts=5), Classifier)
    assert all(len(t) <= 3 and len(set(t)) == len(t) for t in seen)


def test_good_documents_keep_their_columns(spark):
    df, rows, labels = labelled(spark, 200)
    kept = good_documents(df.withColumnRenamed("bin", "score"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "fp", "rank"]
    ids = {r.doc_id for r in kept.collect()}
    assert 0 < len([i for i in ids if i and i >= 1000]) < 200


def test_labels_of_one_class_none_and_empty(spark):
    df, rows = documents(spark, 10)
    for labels, want in (([], {0.5}), ([(1, 1, 0)], None)):
        got = {r.score for r in score_documents(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
        assert len(got) == 1 and (want is None or got == want)
    assert score_documents(empty(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_calibration_recovers_a_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, shift = calibrate(x, y)
    assert abs(slope - 2) < 0.15 and abs(shift + 1) < 0.1
