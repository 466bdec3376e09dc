"""An index is loaded and read without moving texts or vectors, and says the same where it must move them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lotwise.operators import text
from lotwise.sources import lake

RNG = random.Random(3)
WORDS = ["red", "blue", "bolts", "ring", "the", "w1", "a", "gear42", "straße", "ab"]
TEXTS = [(i, "en", " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(0, 40)))) for i in range(60)] + [(60, None, None), (61, "de", "... the a")]
SCHEMA = "k long, lang string, text string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def index(spark):
    docs, out = spark.createDataFrame(TEXTS, SCHEMA), lake.Index(spark)
    out.load(docs.where("k < 40").withColumn("text", F.when(F.col("k") < 30, F.col("text")).otherwise(F.lit("stale words"))), "k", "text", 0)
    out.load(docs.where("k >= 30"), "k", "text", 1)
    return out


def test_texts_are_moved_only_where_keys_repeat(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    got = plan(lake.encoded(docs, "k", "text"))
    assert "Repartition" not in got and "Window" not in got
    twice = docs.union(docs.where("k = 7").withColumn("lang", F.lit("zz")))
    rows = {r["k"]: r["lang"] for r in lake.encoded(twice, "k", "text").collect()}
    assert len(rows) == lake.encoded(twice, "k", "text").count() == len(TEXTS) and rows[7] == "zz"


@pytest.mark.parametrize("most", [0, 500_000])
def test_points_in_several_loads(spark, most, monkeypatch):
    monkeypatch.setattr(lake, "AGAIN", most)
    got = {r["k"]: r["dl"] for r in index(spark).points().collect()}
    want = {r["doc_id"]: r["n"] for r in text.doc_tokens(spark.createDataFrame(TEXTS, SCHEMA), "k", "text").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: want.get(i, 0) for i, _, _ in TEXTS}


def test_weights_are_made_where_points_are(spark):
    built = index(spark)
    got = built.words("k")
    direct = text.bm25_docs(text.doc_tokens(spark.createDataFrame(TEXTS, SCHEMA), "k", "text"))
    told = lambda df: sorted((r["doc_id"], r["bucket"], round(r["weight"], 9)) for r in df.collect())
    assert told(got) == told(direct)
    assert plan(built.words("k", 7.0)).count("Aggregate") == 1  # of ids and loads
    executed = built.points()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in executed and "BroadcastHashJoin" in executed


def test_slices_and_rare_buckets(spark, monkeypatch):
    """Slices of a few texts, and entries counted in place or sorted, say the same."""
    import numpy as np
    import pyarrow as pa

    some = pa.array([(t or "").lower() + " " for _, _, t in TEXTS])
    took = text.Taken(some)
    row, bucket = took.gram_buckets(1 << 14)
    want = {}
    for i, (_, _, t) in enumerate(TEXTS):
        for w in re.findall("[a-z0-9]{2,}", (t or "").lower()):
            if w not in text.STOPWORDS:
                for b in _grams(w):
                    want[i, b] = want.get((i, b), 0) + 1
    assert {(r, b): n for r, b, n in zip(*(x.tolist() for x in text._counted(row, bucket, len(TEXTS), 1 << 14)), strict=True)} == want
    wide = text._counted(np.repeat(row, 400), np.repeat(bucket, 400), len(TEXTS), 1 << 14)
    assert {(r, b): n for r, b, n in zip(*(x.tolist() for x in wide), strict=True)} == {k: 400 * n for k, n in want.items()}
    parts = [text.Taken(some.slice(i, 7)).dl for i in range(0, len(some), 7)]
    assert np.concatenate(parts).tolist() == took.dl.tolist()


def _grams(w):
    from hashlib import sha256

    m = f"^{w}$"
    return [int.from_bytes(sha256(m[i : i + n].encode()).digest()[:8], "big") % (1 << 14) for n in (3, 4) for i in range(len(m) - n + 1)]
