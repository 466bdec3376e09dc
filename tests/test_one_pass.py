"""Texts are taken apart once: no second pass and no join of tokens with tokens."""

from pyspark.sql import functions as F

from lotwise.operators import text
from lotwise.sources import lake

TEXTS = [(1, "er on red red blue k"), (2, None), (3, "..."), (4, "ere er onn " + " ".join(f"w{i % 7} gear{i}" for i in range(300)))]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_text_needs_no_join(spark):
    assert "Join" not in plan(text.hashed_text(text.doc_tokens(docs(spark), "doc_id", "text")))


def test_synonyms_need_one_pass(spark):
    tokens = text.doc_tokens(docs(spark), "doc_id", "text")
    got = text.synonym_expand(tokens, spark.createDataFrame([("er", "ere"), ("on", "onn"), ("er", "a"), ("er", "b"), ("er", "c")], "a string, b string"))
    assert plan(got).count("regexp_extract_all") == 1
    rows = {(r["doc_id"], r["token"]): r["weight"] for r in got.collect()}
    assert {t: w for (d, t), w in rows.items() if d == 1} == {"er": 1.0, "on": 1.0, "red": 1.0, "blue": 1.0, "a": 0.5, "b": 0.5, "c": 0.5, "onn": 0.5}
    assert (rows[4, "ere"], rows[4, "er"], rows[4, "onn"], rows[4, "on"]) == (1.0, 1.0, 1.0, 0.5)


def test_an_index_encodes_in_one_pass(spark):
    got = lake.encoded(docs(spark), "doc_id", "text")
    assert "Join" not in plan(got) and plan(got).count("regexp_extract_all") == 1
    rows = {r["doc_id"]: r for r in got.collect()}
    assert [(rows[i]["dl"], rows[i]["terms"], rows[i]["dense"], rows[i]["grams"]) for i in (2, 3)] == [(0, [], {}, {})] * 2
    tokens = text.doc_tokens(docs(spark), "doc_id", "text")
    for name, vectors in (("dense", text.hashed_text(tokens)), ("grams", text.ngram_vectors(tokens))):
        want = {(r["doc_id"], r["bucket"]): round(r["weight"], 12) for r in vectors.collect()}
        assert {(i, b): round(w, 12) for i, r in rows.items() for b, w in r[name].items()} == want
    counts = text.term_counts(tokens).select("doc_id", text.hash_bucket(F.col("token"), lake.WORD_BUCKETS).alias("bucket"), "tf", "dl")
    assert sorted((i, x["bucket"], x["tf"], r["dl"]) for i, r in rows.items() for x in r["terms"]) == sorted(map(tuple, counts.collect()))
