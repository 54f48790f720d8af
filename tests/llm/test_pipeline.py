import re
from collections import Counter

import pytest

from grovemill.llm.common import materialize
from grovemill.llm.simhash_tiles import one_of_each
from grovemill.llm.weighted_mix import mix
from grovemill.llm.zstd_quality import score_documents
from tests.llm.helpers import documents, empty
from tests.llm.test_nnls_packing import check
from tests.llm.test_secret_ledger import SECRETS
from tests.llm.test_simhash_tiles import roots
from tests.llm.test_simhash_tiles import slow as fingerprint
from tests.llm.test_zstd_quality import labelled

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def corpus(spark, tmp_path):
    df, rows, labels = labelled(spark, 200)
    extra = [(5000 + i, s + " plain words around", "en", "src1", 3, 1, 2, "x") for i, s in enumerate(SECRETS)]
    df = spark.createDataFrame([*rows, *extra], df.schema).select(*COLUMNS)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(materialize(stage(spark, out[-1], corpus)))
        assert out[-1].columns == COLUMNS, name
    before, good, alone, clean, mixed = ([tuple(r) for r in d.collect()] for d in out)

    score = {(r.doc_id, r.predicted) for r in score_documents(docs, spark.read.parquet(f"{corpus}/labels.parquet")).collect()}
    assert Counter(good) == Counter(r for r in before if (r[0], 1) in score)

    of = {r: fingerprint(r[1]) for r in good}
    root = roots(of.values())
    first = {}
    for r in sorted(good, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(root[of[r]], r[0])
    assert Counter(r[0] for r in alone) == Counter(first.values()) and set(alone) <= set(good)

    texts = {r[0]: r[1] for r in alone}
    assert len(clean) == len(alone)
    for r in clean:
        marked = re.split(r"\[(?:assign|access|hex|pem|jwt|forge) removed\]", r[1] or "")
        assert re.fullmatch(".+".join(map(re.escape, marked)), texts[r[0]] or "", re.DOTALL)
        assert (r[4] == len(r[1] or "")) or r[1] == texts[r[0]]
    assert any("removed]" in (r[1] or "") for r in clean) and not any("hunter22" in (r[1] or "") for r in clean)

    taken = {r.doc_id: int(r.taken / r.size + 0.5) for r in mix(out[3]).collect() if r.size}
    assert Counter(r[0] for r in mixed) == Counter({k: n for k, n in taken.items() if n}) and set(mixed) <= set(clean)

    check(mixed, corpus_pipeline.packing(spark, out[4], corpus).collect())


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert "sequence_id" in out.columns and out.count() > 0
    for keep in ("doc_id is null", "doc_id < 0"):
        few = f"{corpus}/{len(keep)}"
        spark.read.parquet(f"{corpus}/documents.parquet").where(keep).write.parquet(f"{few}/documents.parquet")
        spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{few}/labels.parquet")
        assert (corpus_pipeline.run(spark, few).count() > 0) == (keep == "doc_id is null")


def test_one_of_each_with_repetitions_and_empty(spark):
    rows = [(1, "a b c d", "en", "x", 4), (1, "a b c d", "en", "x", 4), (1, "a b c d", "de", "x", 4), (None, "e f g h i", None, None, None), (None, "e f g h i", None, None, None), (2, None, None, None, 0), (3, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert Counter(map(tuple, one_of_each(df).collect())) == Counter([rows[2], rows[3], rows[5]])
    df, _ = documents(spark, 1)
    assert one_of_each(empty(spark)).schema.names == df.schema.names and one_of_each(empty(spark)).collect() == []
