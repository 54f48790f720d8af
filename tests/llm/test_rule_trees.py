import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from grovemill.llm.rule_trees import BASE, FEATURES, document_statistics, fit, judge, repeated, statistics, train
from tests.llm.helpers import documents, empty
from tests.llm.test_zstd_quality import labelled


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1cé|#", max_size=60))
def test_base_counts(text):
    assert statistics(text)[:5] == slow(text)


def test_many_distinct_words():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 4])
    assert repeated(ids, 3_000_000) == repeated(ids, 10) == 6


def test_verdicts(spark):
    df, rows, labels = labelled(spark, 500)
    out = judge(df, labels).collect()
    want = Counter((r[0], *slow(r[1])) for r in rows)
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in out) == want
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = []
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
        if (r.doc_id or 0) >= 1000 and not r.base_failed:
            right.append(r.kept == (truth[r.doc_id] == 1))
    assert np.mean(right) > 0.97


def test_scores_equal_a_walk_of_every_tree():
    rng = np.random.default_rng(5)
    x = rng.random((800, 5))
    model = fit(x, (rng.random(800) < x[:, 0] * x[:, 1]).astype(float), [1, 0, -1, 0, 0], trees=20)

    def walk(row, t, node=0):
        f = model.feature[t, node]
        if f < 0:
            return model.value[t, node]
        return walk(row, t, model.left[t, node] if row[f] <= model.threshold[t, node] else model.right[t, node])

    want = [1 / (1 + np.exp(-(model.start + sum(walk(row, t) for t in range(20))))) for row in x]
    assert np.allclose(model.score(x), want) and len(set(np.round(want, 6))) > 50


def test_the_sample_is_bounded_though_labels_lack_documents(spark):
    df, rows, labels = labelled(spark, 300)
    far = spark.range(100_000, 104_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    model = train(document_statistics(df), labels.unionByName(far), rows=200)
    assert len(set(np.round(model.value[0], 9))) > 1


def test_monotone_in_each_constrained_feature():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = (rng.random(3000) < 0.2 + 0.6 * (np.sin(9 * x[:, 0]) > 0) * x[:, 1]).astype(float)
    model = fit(x, y, [-1, 1, 0, 0])
    probe = rng.random((200, 4))
    for j, sign in ((0, -1), (1, 1)):
        last = None
        for v in np.linspace(-0.1, 1.1, 60):
            probe[:, j] = v
            now = model.score(probe)
            assert last is None or (sign * (now - last) >= -1e-12).all()
            last = now
    p = fit(x, y, [0, 0, 0, 0]).score(x)
    assert np.mean((p > 0.5) == (y > 0.5)) > 0.7


def test_constant_models():
    for y in (np.zeros(0), np.ones(10), np.zeros(10)):
        assert len(set(fit(np.zeros((len(y), 2)), y, [0, 0]).score(np.random.default_rng(0).random((5, 2))))) == 1


def test_without_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df, _ = documents(spark, 20)
    assert all(r.kept == (not r.base_failed) for r in judge(df, labels).collect())
    assert judge(empty(spark), labels).collect() == [] and len(FEATURES) == 11
