"""The search by words in one pass gives what the product of the two tables of weights gives, and keeps one row for each document."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import text

TEXTS = [
    (1, "Red gear, red GEAR the and x 42"),
    (2, None),
    (3, "... the a"),
    (4, "blue bolt " + " ".join(f"w{i % 17} gear{i}" for i in range(400))),
    (5, "Kelvin İstanbul straße red"),  # letters that become plain ones in lower case
    (6, "red bolt"),
    (6, "bolt bolt gear"),  # a key in two rows
    (6, None),
    *[(10 + i, f"red w{i % 5} bolt{i % 3} " * (1 + i % 4)) for i in range(40)],
]
ASKED = [(1, "red gear bolt the"), (2, "kelvin stanbul gear7 gear8 w3"), (3, "nothing here"), (4, "bolt1 bolt2 red red")]


@pytest.mark.parametrize("size", [1 << 16, 16])
def test_one_pass_equals_the_tables_of_weights(spark, size, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    asked = spark.createDataFrame(ASKED, "query_id long, t string").select("query_id", F.explode(text.tokenize(F.col("t"))).alias("token"))
    kept = {}
    stored = text.stored

    def watched(df, name):
        out = kept[name] = stored(df, name)
        return out

    monkeypatch.setattr(text, "stored", watched)
    told = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    got = told(text.bm25_dot(asked, docs, "doc_id", "text", 7, size, entries=30, query_block=2))
    assert kept["vectors"].count() <= len({i for i, _ in TEXTS})
    want = text.sparse_dot(text.bm25_queries(asked, size), text.bm25_docs(text.doc_tokens(docs, "doc_id", "text"), size), 7)
    assert got == told(want) and len(got) > 15


def test_no_texts_and_no_queries(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red")], "query_id long, token string")
    assert text.bm25_dot(asked, docs.limit(0), "doc_id", "text", 3).count() == 0
    assert text.bm25_dot(asked.limit(0), docs, "doc_id", "text", 3).count() == 0


def test_texts_are_gathered_only_where_keys_repeat(spark, monkeypatch):
    """With a row for each key, texts go to the words as they are dealt."""
    docs = spark.createDataFrame([t for t in TEXTS if t[0] != 6], "doc_id long, text string")
    asked = spark.createDataFrame(ASKED, "query_id long, t string").select("query_id", F.explode(text.tokenize(F.col("t"))).alias("token"))
    plans, stored = {}, text.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(text, "stored", watched)
    told = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    got = told(text.bm25_dot(asked, docs, "doc_id", "text", 7, entries=30))
    assert "collect_list" not in plans["vectors"]
    assert got == told(text.sparse_dot(text.bm25_queries(asked), text.bm25_docs(text.doc_tokens(docs, "doc_id", "text")), 7))


def test_words_are_those_of_the_pattern():
    import re

    import pyarrow as pa

    texts = ["", "a", "ab", "ab cd", "é", "éabcé1", "x1 the zz", "  ab  ab ", "\0ab\0c", "ab😀cd", "z" * 5000, "ab", "cd-ef", ""]
    for some in (pa.array(texts), pa.array(texts).slice(3, 8), pa.array([], pa.string())):
        words, own = text._words(some)
        assert [(int(i), w.decode()) for i, w in zip(own, words.to_pylist(), strict=True)] == [(i, w) for i, t in enumerate(some.to_pylist()) for w in re.findall("[a-z0-9]{2,}", t)]
