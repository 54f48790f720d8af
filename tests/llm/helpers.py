"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bin int, fp bigint, rank string"
VOCABULARY = "alpha Beta gamma delta epsilon zeta Éta thêta iota kappa ##x a|b don't 12,5 日本語 ß".split()


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.choice([1, 3, 20, 90])), rng.choice(["en", None]), rng.choice(["src0", "src0", "src1", "b", None]), 5, 1, 2, "x") for i in range(n)]
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "src0", 0, 1, 2, "x"), (n + 2, " \t\n ", "en", "src1", 3, 1, 2, "x"), (n + 3, text(rng, 9000), "en", "src0", 9, 1, 2, "x"), (None, "alpha beta gamma delta", "en", "b", 4, 1, 2, "x")]
    rows += [rows[0], rows[0], (n + 4, rows[2][1], "en", "src0", 1, 1, 2, "x"), (n + 5, rows[3][1] + " end", "en", "src0", 1, 1, 2, "x"), (n + 6, "one\x0btwo\x0cthree four", "en", "src1", 1, 1, 2, "x")]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
