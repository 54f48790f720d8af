import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from grovemill.llm.nnls_packing import nnls, pack, padded_length, plan
from grovemill.llm.tokens import default_vocabulary
from tests.llm.helpers import documents, empty


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.normal(size=12)
        x = nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and slope.min() > -1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        p = plan(counts, 64)
        used = Counter()
        for use, n in p.strategies:
            assert n > 0 and sum(k * m for k, m in use.items()) <= 64
            for k, m in use.items():
                used[k] += m * n
        want = Counter(counts)
        for k, first in p.cut_from.items():
            n = counts[k] - first
            want[k] -= n
            want[32] += n
            want[k - 32] += n
        assert +want == used


def check(rows, out, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    ids = Counter()
    for r in rows:
        ids[(r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1]))] += 1
    by_doc, by_sequence, of = defaultdict(list), defaultdict(list), {}
    for (d, own), n in ids.items():
        of[(d, len(own))] = (own, n)
    for p in out:
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == of.keys()
    for key, parts in by_doc.items():
        own, n = of[key]
        covered = Counter()
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
            covered.update(range(p.start, p.start + p.length))
        assert set(covered) == set(range(len(own))) and set(covered.values()) == {n}
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(padded_length(sum(p.length for p in s), window) for s in by_sequence.values()), sum(map(len, (o for o, n in of.values() for _ in range(n))))


def test_round_trip(spark):
    df, rows = documents(spark, 150)
    padded, filled = check(rows, pack(df).collect())
    assert padded < 1.25 * filled


def test_small_window_and_ranks_over_many_groups(spark):
    df, rows = documents(spark, 150, seed=5)
    padded, filled = check(rows, pack(df, window=128, unit=4, ranked=5).collect(), 128)
    assert padded < 1.1 * filled


@pytest.mark.parametrize("ranked", [1, 200_000])
def test_one_repeated_row(spark, ranked):
    rows = [(None, None)] * 700 + [(3, "one two three")] * 40
    padded, filled = check(rows, pack(spark.createDataFrame(rows, "doc_id bigint, text string"), window=128, unit=4, ranked=ranked).collect(), 128)
    assert padded < 1.5 * filled + 128


def test_empty(spark):
    assert pack(empty(spark)).collect() == []
