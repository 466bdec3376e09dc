"""The legs of the hybrid search in one pass give what the products of the tables of vectors give; nothing is stored or dealt for each document."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import legs, text
from lotwise.plans import search
from lotwise.sources import sinks

RNG = random.Random(5)
TEXTS = [
    (1, "Red gear, red GEAR the and x 42"),
    (2, None),
    (3, "... the a"),
    (4, "blue bolt " + " ".join(f"w{i % 17} gear{i}" for i in range(400))),
    (5, "Kelvin İstanbul straße red"),
    *[(10 + i, " ".join(RNG.choice(["red", "bolts", "bolt", "gears", "w1", "the", "ab", "q"]) for _ in range(RNG.randint(1, 12)))) for i in range(60)],
    *[(100 + i, "red bolt ring") for i in range(30)],  # ties
]
TWICE = [*TEXTS, (6, "red bolt"), (6, "bolt bolt gear"), (6, None)]
ASKED = [(1, "red gear bolt the"), (2, "kelvin stanbul gear7 gear8 w3"), (3, "nothing here"), (4, "bolt1 bolt2 red red"), (5, "the")]


def tables(spark, texts=TEXTS):
    asked = spark.createDataFrame(ASKED, "query_id long, t string").select("query_id", F.explode(text.tokenize(F.col("t"))).alias("token"))
    return asked, spark.createDataFrame(texts, "doc_id long, text string")


def told(df, k):
    """The ``k`` best of each query and leg."""
    of = {}
    for r in df.collect():
        of.setdefault((r["source"], r["query_id"]), []).append((-round(r["score"], 9), r["item"]))
    return {q: [(i, -s) for s, i in sorted(rows)[:k]] for q, rows in of.items()}


@pytest.mark.parametrize("texts", [TEXTS, TWICE])
def test_one_pass_equals_the_products_of_the_tables(spark, texts, monkeypatch):
    asked, docs = tables(spark, texts)
    monkeypatch.setattr(text, "GRAM_BYTES", 400)
    monkeypatch.setattr(legs, "TILE_CELLS", 500)
    got = told(legs.found(asked, docs, "doc_id", "text", 7), 7)
    assert got == told(legs.found(asked, docs, "doc_id", "text", 7, most=4 - 1), 7)  # in a grid, for many queries
    tokens, named = text.doc_tokens(docs, "doc_id", "text"), asked.withColumnRenamed("query_id", "doc_id")
    as_query = lambda df: df.withColumnRenamed("doc_id", "query_id")
    plain = {"words": (text.bm25_queries(asked), text.bm25_docs(tokens)), "dense": (as_query(text.hashed_text(named)), text.hashed_text(tokens)), "grams": (as_query(text.ngram_vectors(named)), text.ngram_vectors(tokens))}
    for leg, (q, x) in plain.items():
        want = told(text.sparse_dot(q, x, 7).select(F.lit(leg).alias("source"), "query_id", F.col("doc_id").alias("item"), "score"), 7)
        assert {k: v for k, v in got.items() if k[0] == leg} == want and want, leg


def test_the_best_are_cut_without_loss(spark, monkeypatch):
    import numpy as np

    best, rng = legs._Best(3, 5), np.random.default_rng(1)
    scores = np.round(rng.random((500, 3)), 1) * (rng.random((500, 3)) < 0.9)
    for at in range(0, 500, 20):
        best.add(np.arange(at, at + 20), scores[at : at + 20])
        best.cut()
    q, doc, score = best.cut()
    for j in range(3):
        want = sorted((-s, i) for i, s in enumerate(scores[:, j]) if s > 0)[:5]
        assert sorted(zip(-score[q == j], doc[q == j], strict=True)) == want


def test_no_texts_and_no_queries(spark):
    asked, docs = tables(spark)
    assert legs.found(asked, docs.limit(0), "doc_id", "text", 3).count() == 0
    assert legs.found(asked.limit(0), docs, "doc_id", "text", 3).count() == 0


@pytest.mark.parametrize("name", ["ret_hybrid", "ret_hybrid_dbsf"])
def test_no_vectors_of_all_documents_are_stored(spark, sf, name, monkeypatch):
    kept = []
    for place in (text, sinks, search, legs):
        if hasattr(place, "stored"):
            monkeypatch.setattr(place, "stored", lambda df, name, f=place.stored: kept.append((name, f(df, name))) or kept[-1][1])
    got = getattr(search, name)(spark, sf)
    assert got.count() > 0
    assert [n for n, _ in kept] == (["pool", "pool"] if name == "ret_hybrid" else [])
    if name == "ret_hybrid":  # texts are read again for the pool's items alone
        (_, pool), (_, texts) = kept
        assert texts.count() == pool.select("item").distinct().count() and texts.columns == ["item", "text"]
        assert search.load(spark, sf, "documents").count() > texts.count()


def test_texts_are_dealt_only_where_parts_are_uneven(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    cores = spark.sparkContext.defaultParallelism
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(text.spread(rows, "k"))
    assert text.spread(rows.repartition(9 * cores), "k").rdd.getNumPartitions() == 4 * cores
    assert "RepartitionByExpression" in plan(text.spread(rows.coalesce(1), "k"))
