"""Grams are counted a slice of tokens at a time; where the slices end makes no difference."""

import math
import random
from collections import Counter

from lotwise.operators import text


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, rng.choice("abc"), [rng.choice(words[:20] if i % 2 else words) for _ in range(rng.randint(0, 60))]) for i in range(200)]
    return [*rows, (200, "a", None), (201, "b", []), (202, "c", ["w1"]), (203, "c", ["w1", "w1", "w1"]), (204, None, ["w1", "w2"])]


def grams(tokens):
    return {*(tokens or []), *(f"{a} {b}" for a, b in zip(tokens or [], (tokens or [])[1:], strict=False))}


def test_log_odds_and_classes_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(text, "GRAM_TOKENS", 50)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>").coalesce(2)
    n, total, size = Counter(), Counter(), Counter(label for _, label, _ in rows)
    for _, label, tokens in rows:
        for g in grams(tokens):
            n[label, g] += 1
            total[g] += 1
    want = {}
    for (label, g), k in n.items():
        rest, others = total[g] - k, len(rows) - size[label]
        w = math.log(((k + 1) / (size[label] - k + 1)) / ((rest + 1) / (others - rest + 1)))
        if label and w >= 0.2:
            want.setdefault(label, []).append((-round(w, 9), g))
    best = {(label, g): -w for label, x in want.items() for w, g in sorted(x)[:30]}
    weights = text.log_odds(docs, least=0.2, top=30).localCheckpoint()
    got = {(r["label"], r["gram"]): r["weight"] for r in weights.collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-8 for k in best)

    monkeypatch.setattr(text, "MODEL", 10_000)
    few = {r["doc_id"]: (r["label"], round(r["score"], 8)) for r in text.ngram_classify(docs, weights).collect()}
    monkeypatch.setattr(text, "MODEL", 1)
    assert few == {r["doc_id"]: (r["label"], round(r["score"], 8)) for r in text.ngram_classify(docs, weights).collect()}
    assert len(few) == len(rows)


def test_equal_grams_of_a_slice_are_one_row(spark):
    """What is shuffled is a row for each different gram, not for each document that holds it."""
    from pyspark.sql import types as T

    docs = spark.createDataFrame([(i, "a", ["x", "y", "x"]) for i in range(1000)], "doc_id long, label string, tokens array<string>").coalesce(1)
    schema = T.StructType([docs.schema["label"], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    rows = docs.select("label", "tokens").mapInArrow(text._gram_counts(text._arrow_schema(schema), 1 << 20), schema).collect()
    assert sorted(map(tuple, rows)) == [("a", "x", 1000), ("a", "x y", 1000), ("a", "y", 1000), ("a", "y x", 1000)]


def test_parts_follow_the_texts_length(spark, monkeypatch):
    """What a task takes apart is bounded by its texts' characters, also where adaptive execution would join parts."""
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('some words ', 20) AS text")
    monkeypatch.setattr(text, "TASK_CHARS", 2_000)
    tokens = text.doc_tokens(docs, "doc_id", "text")
    assert tokens.groupBy("doc_id").count().rdd.getNumPartitions() == 400 * 220 // 2_000
    assert tokens.count() == 400 * 40
