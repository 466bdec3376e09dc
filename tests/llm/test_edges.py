"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from lotwise.llm import chat, fingerprint, licenses, lines, packing, pieces, pii, quality, simhash, topk
from lotwise.llm.queries import PIECE_MODEL, tokenizer_path

CLASHING = ["key", "a", "b", "fp", "node", "n_lines", "n_entities", "score", "log_chars", "t", "first", "shard", "next", "license", "__doc", "__again", "row", "gone", "lines", "again", "leaf", "line", "sig", "own", "hashes", "copies", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 977} of text" for i in range(30_000))
    rows = [(1, "Hello there, world of words and lines."), (1, "Hello there, world of words and lines."), (2, None), (3, ""), (4, "   \n\t "), (None, "no id here at all"), (None, None), (5, long), (6, "x"), (7, "\n\n\n"), (8, "é́ ß Straße ﬁ 你好 \U0001f600 \x00 tail")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


RUNS = {
    "fingerprint": lambda d, l: fingerprint.fingerprint_documents(d),
    "edits": lambda d, l: fingerprint.fingerprint_edits(d),
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "near": lambda d, l: simhash.drop_near_copies(d),
    "packing": lambda d, l: packing.pack(d, tokenizer_path()),
    "quality": lambda d, l: quality.score(d, l),
    "keep": lambda d, l: quality.keep_good(d, l, 0.0),
    "lines": lambda d, l: lines.drop_recurring_lines(d),
    "licenses": lambda d, l: licenses.scan_licenses(d),
    "pii": lambda d, l: pii.pseudonymise(d, b"k"),
    "pii_joined": lambda d, l: pii.pseudonymise(d, b"k", -1),
    "pieces": lambda d, l: pieces.encode_documents(d, tokenizer_path(PIECE_MODEL)),
}
SAME = ["fingerprint", "edits", "simhash", "quality", "keep", "lines", "pii", "pii_joined", "pieces"]


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(docs, labels, name):
    got = RUNS[name](docs, labels).collect()
    if name in SAME:
        assert len(got) == docs.count()
        assert sum(r["doc_id"] is None for r in got) == 2


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(docs, labels, name):
    assert RUNS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_every_id_is_packed_once(docs):
    got = packing.pack(docs.drop(*CLASHING), tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"), F.count("*").alias("c")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n"] == by[3]["n"] == 1 and by[1]["n"] == 2 * by[1]["m"] and by[5]["n"] == by[5]["m"] > 4096


def test_own_columns_survive(docs, labels):
    for name in ("keep", "near"):
        assert RUNS[name](docs, labels).columns == docs.columns
    assert set(docs.columns) <= set(RUNS["lines"](docs, labels).columns)
    assert set(docs.columns) <= set(RUNS["pii"](docs, labels).columns) and set(docs.columns) <= set(RUNS["pii_joined"](docs, labels).columns)


def test_vectors_with_odd_components(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    v = df.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in topk.top_k(v, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, 65536), (0, 4, 7, 0)]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_turns_with_nulls(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (2, None, "a\nb", "t")], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, None, 2} and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_no_labels_or_one_kind(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 1 for r in quality.score(docs, one).collect())
