"""The stages on the smallest tables: what each keeps, and that its decisions take effect."""

import corpus_pipeline as p
from lotwise.llm import pii, quality, simhash


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
    before, after = seen["quality"]
    scores = {r["doc_id"]: r["score"] for r in quality.score(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {d for d, s in scores.items() if s >= 0.5}
    before, after = seen["lines"]
    assert before.count() == after.count() and all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["near_copies"]
    groups = simhash.near_groups(before)
    assert after.count() == groups.select("group").distinct().count()
    _, after = seen["pii"]
    assert all(r["text"] is not None for r in after.collect())
    before, after = seen["pii"]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert not [m for r in before.collect() for _, _, _, m in pii.find(r["text"]) if m in texts[r["doc_id"]]]
    before, after = seen["packing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}


def test_run_gives_the_packed_rows(spark, sf):
    got = p.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def tables(spark, folder, docs, labels):
    for name, df in (("documents", docs), ("labels", labels)):
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run_on_odd_and_empty_tables(spark, sf, tmp_path):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(f"w{i}" for i in range(20_000))
    odd = [(1, None), (2, ""), (3, "  "), (None, "no id at all here"), (None, None), (10**6, long), (10**6, long), (10**6 + 1, long), (7, "x"), (7, "x")]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], own.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mixed = tables(spark, tmp_path / "mixed", own.unionByName(rows).withColumn("key", p.F.lit(1)).withColumn("lines", p.F.lit("a")), labels)
    got = p.run(spark, mixed)
    assert got.where(p.F.col("doc_id") == 10**6 + 1).count() == 0 and got.count() > 0
    assert p.run(spark, tables(spark, tmp_path / "none", own.limit(0), labels.limit(0))).count() == 0
    assert p.run(spark, tables(spark, tmp_path / "bare", own.limit(20), labels.limit(0))).count() > 0


def test_run_against_a_plain_program(spark, sf):
    """The five stages by the brute-force versions of their operators, one text after another."""
    from tokenizers import Tokenizer

    from .test_brute_force import line_brute, near_brute

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    left = line_brute({d: t for d, t in texts.items() if scores[d] >= 0.5})
    _, root = near_brute([(d, t.lower()) for d, t in left.items()])
    left = {d: pii.replace(t, p.PII_KEY, {})[0] for d, t in left.items() if root[d] == d}
    own = Tokenizer.from_file(p.tokenizer_path())
    want = {d: len(own.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()}
    got = p.run(spark, sf).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    assert sum(r["length"] for r in got) == sum(want.values())
