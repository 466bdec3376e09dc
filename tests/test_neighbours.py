"""Tokens within two edits by their deletions, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import ranking, text


def edited(rng, w, times):
    for _ in range(times):
        i, kind = rng.randrange(len(w) + 1), rng.randrange(4)
        if kind == 0:
            w = w[:i] + rng.choice("abc") + w[i:]
        elif kind == 1:
            w = w[:i] + w[i + 1 :]
        elif kind == 2:
            w = w[:i] + rng.choice("abc") + w[i + 1 :]
        else:
            w = w[:i] + w[i : i + 2][::-1] + w[i + 2 :]
    return w


@pytest.mark.parametrize("farthest", [1, 2])
def test_neighbours_equal_all_pairs(spark, farthest):
    """Short tokens, empty ones, and long ones about the length from which parts are used."""
    rng = random.Random(farthest)
    base = ["".join(rng.choice("abcd") for _ in range(n)) for n in [1, 2, 3, 4, 6, 8, 26, 27, 28, 29, 30, 31, 32, 33, 40, 70] for _ in range(3)] + ["", "a"]
    left = [edited(rng, w, rng.randint(0, 2)) for w in base for _ in range(3)] + [None]
    right = [edited(rng, w, rng.randint(0, 2)) for w in base for _ in range(3)] + [None]
    frame = lambda rows: spark.createDataFrame([(w,) for w in rows], "token string")
    got = {(r["a"], r["b"]): r["distance"] for r in text.edit_neighbours(frame(left), frame(right), farthest).collect()}
    want = {(a, b): d for a in {*left} - {None} for b in {*right} - {None} if abs(len(a) - len(b)) <= farthest and (d := text.damerau(a, b)) <= farthest}
    assert got == want


def test_coverage_equals_the_full_comparison(spark):
    rng = random.Random(4)
    words = ["red", "bolt", "gear", "small", "widget", "ring"]
    pick = lambda n: [edited(rng, rng.choice(words), rng.randint(0, 3)) for _ in range(n)]
    queries = [pick(rng.randint(0, 3)) for _ in range(8)]
    rows = [(q, i, rng.random(), queries[q], pick(rng.randint(0, 4))) for q in range(8) for i in range(12)] + [(9, 1, 0.5, None, ["red"]), (9, 2, 0.5, ["red"], None)]
    df = spark.createDataFrame(rows, "query_id int, item int, score double, q array<string>, t array<string>")

    def like(a, b):
        if a in b or b in a:
            return 1.0
        d = text.damerau(a, b)
        return 1 - d / max(len(a), len(b)) if d <= 2 else 0.0

    got = {(r["query_id"], r["item"]): r["coverage"] for r in ranking.fuzzy(df, F.col("q"), F.col("t")).collect()}
    assert len(got) == len(rows)
    for query, item, _, q, t in rows:
        best = [max((like(a, b) for b in t or []), default=0.0) for a in q or []]
        matched = [b for b in best if b >= 0.6] if t is not None else []
        assert got[query, item] == pytest.approx(max(matched) * len(matched) / len(q) if matched else 0.0)
