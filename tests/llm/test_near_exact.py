"""The exact mode of near copies: groups beyond what one place compares, and long texts, against all pairs."""

import random

from lotwise.llm import common, simhash


def groups_of(texts, least=0.8):
    """By union of all pairs that are near."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y) - 1e-9:
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return {i: find(i) for i in ids}


def test_crowds_in_large_groups_equal_all_pairs(spark, monkeypatch):
    """Texts that share one passage, in clusters of copies about 0.8: block groups are far over what one place compares."""
    monkeypatch.setattr(simhash, "PART", 24)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts, i = {}, 0
    for c in range(60):
        base = [f"c{c}w{k}" for k in range(14)]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"x{i}"
            texts[i] = " ".join(passage + own)
            i += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(df, exact=True).collect()}
    assert got == groups_of(texts)


def test_long_texts_equal_all_pairs(spark):
    """Over 64 parts: texts of about 600 words with edits up to the bound."""
    rng = random.Random(12)
    texts, i = {}, 0
    for c in range(8):
        base = [f"c{c}w{rng.randrange(400)}" for _ in range(600)]
        for k in range(10):
            own = list(base)
            for _ in range(4 + 2 * k):
                own[rng.randrange(len(own))] = f"x{i}"
            texts[i] = " ".join(own)
            i += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(df, exact=True).collect()}
    assert got == groups_of(texts)


def test_the_pipeline_compares_every_pair(spark, monkeypatch):
    """The pipeline's stage leaves no pair to chance in large block groups."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "PART", 24)
    monkeypatch.setattr(simhash, "EXTENSIONS", 1)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts, i = {}, 0
    for c in range(40):
        base = [f"c{c}w{k}" for k in range(14)]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"x{i}"
            texts[i] = " ".join(passage + own)
            i += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").select("doc_id").collect()}
    assert kept == set(groups_of(texts).values())


def test_the_pipeline_asks_for_the_exact_mode(monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(corpus_pipeline, "drop_near_copies", lambda docs, *args, **how: asked.append(how))
    corpus_pipeline.near_copies(None, None, "")
    assert asked == [{"exact": True}]


def test_short_pairs_at_the_bound(spark):
    """Four shingles and the same with a fifth (0.8): with few parts, those without a differing shingle may all be empty."""
    texts = {}
    for i in range(1500):
        base = [f"t{i}w{k}" for k in range(8)]
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join([*base, "x"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(df, exact=True).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_blocks_are_not_stored(spark, tmp_path, monkeypatch):
    """Texts that share nothing leave their fingerprints on disk, not their blocks."""
    import os

    rng = random.Random(13)
    texts = [(i, " ".join(f"{rng.randrange(1 << 20):x}" for _ in range(800))) for i in range(400)]
    monkeypatch.setattr(common, "scratch_dir", lambda spark: str(tmp_path))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert simhash.near_groups(df, exact=True).where("doc_id <> group").count() == 0
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet"))
    assert size < 0.1 * sum(len(t) for _, t in texts)


def test_texts_that_share_a_passage_are_told_apart_before_their_shingles_are_read(spark, monkeypatch):
    """Half of each text is one passage: all share blocks and no two are near. Pairs whose shingles are compared don't grow with the square."""
    rng = random.Random(14)
    passage = [f"p{i}" for i in range(60)]
    texts = {i: " ".join(passage + [f"t{i}w{k}" for k in range(60)]) for i in range(300)}
    for i in range(0, 300, 60):
        own = texts[i].split()
        own[rng.randrange(64, len(own))] = "edited"
        texts[300 + i] = " ".join(own)
    read, verified = [], simhash._verified

    def counted(pairs, *args):
        read.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(simhash, "_verified", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(df, exact=True).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i in texts}
    assert sum(read) < len(texts), read


def test_odd_buckets_bound_the_differing_shingles():
    """As many bits differ as hashes do at most, whatever the sizes."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(15)
    sets = [set(rng.integers(-(1 << 62), 1 << 62, n).tolist()) for n in (0, 1, 5, 300, 5000)]
    sets += [set(list(x)[: len(x) * 9 // 10]) | set(rng.integers(-(1 << 62), 1 << 62, len(x) // 10).tolist()) for x in sets]
    batch = pa.RecordBatch.from_arrays([pa.array([list(x) for x in sets], pa.list_(pa.int64()))], ["hashes"])
    out = simhash._Marks()(batch)
    assert list(out["size"]) == [len(x) for x in sets]
    bits = [np.unpackbits(np.asarray(x, "int64").view("uint8")) for x in out["odd"]]
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            assert (x != y).sum() <= len(a ^ b)
    assert (bits[3] != bits[8]).sum() > 40
