"""Neighbours from cells about pivots against the full grid."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import vectors


def clustered(rng, n, dims, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
@pytest.mark.parametrize("earlier", [False, True])
def test_cells_equal_the_grid(spark, monkeypatch, spread, earlier):
    """Clusters and noise, repeated rows, vectors of length zero, blocks of a few rows."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    rng = random.Random(3)
    rows = clustered(rng, 900, 8, spread)
    rows += [rows[0]] * 15 + [[0.0] * 8] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    queries = df.where("id % 9 = 0 OR id >= 910").select(F.col("id").alias("query_id"), "v")
    index = vectors.Pivots(df, pivots=30, block=50)
    got, looked = index.search(queries, 7, earlier)
    told = lambda x: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in x.collect())
    assert told(got) == told(vectors.knn(queries, df, 7, earlier=earlier))
    share = looked.agg(F.sum("looked") / F.sum("cells")).first()[0]
    assert looked.count() == queries.count() and (share < 0.35 if spread < 0.1 and not earlier else share <= 1)


def test_small_and_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    ask = one.select(F.col("id").alias("query_id"), "v")
    assert vectors.Pivots(none).search(ask, 3)[0].count() == 0
    assert {(r["query_id"], r["id"]) for r in vectors.Pivots(one).search(ask, 3)[0].collect()} == {(1, 2), (2, 1)}
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert {(r["query_id"], r["id"], r["score"]) for r in vectors.Pivots(zeros).search(ask, 1)[0].collect()} == {(1, 2, 0.5), (2, 1, 0.5)}
