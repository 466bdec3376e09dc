"""Exact dedup, periodic runs and the Merkle manifest against plain programs, and on odd tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lotwise.llm import common, exact, manifest, queries, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["hash", "sha", "row", "n", "run", "range", "entries", "src", "idx", "h", "leaf", "node", "up", "seg", "all", "level", "runs", "start", "task", "__sha", "__id"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977} of text" for i in range(30_000))
    rows = [(1, "Ab"), (1, "aB"), (1, "aB"), (2, None), (3, ""), (None, "AB"), (None, "none"), (None, "NONE"), (5, long), (6, "É é"), (7, "é é"), (8, " \n\t "), (9, "\U0001f600 \x00 tail")]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (2, 8) else "s" if i != 9 else "", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHING})


# exact dedup


def plain_copies(rows, keep):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(lowered(t), []).append((i, n))
    out = []
    for t, group in groups.items():
        ids = [i for i, _ in group if i is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        done = False
        for i, _ in group:
            out.append((str(i), str(best), len(group), i == best and not done, sha(t)))
            done |= i == best
    return sorted(out)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize(("bits", "size"), [(64, exact.RUN), (64, 7), (3, 16), (0, 5)])
def test_copies_of_small_runs_and_colliding_hashes(spark, keep, bits, size):
    """Runs of a few entries take several rounds; hashes of three bits or none collide and are told apart by the SHA-256."""
    rng = random.Random(5)
    rows = [(rng.randrange(300), rng.choice(["Hot Text", "hot text", f"t{rng.randrange(60)}", f"T{rng.randrange(200)}"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = exact.exact_copies(df, keep, bits=bits, size=size).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain_copies(rows, keep)


def test_copies_among_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for keep in ("smallest", "largest"):
        got = exact.exact_copies(odd, keep).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain_copies(rows, keep)
    left = exact.drop_exact_copies(odd)
    assert left.columns == odd.columns and sorted(lowered(r["text"]) for r in left.collect()) == sorted({lowered(t) for _, t in rows})
    assert exact.exact_copies(odd.limit(0)).count() == 0 == exact.drop_exact_copies(odd.limit(0)).count()
    with pytest.raises(ValueError):
        exact.exact_copies(odd, "first")


def test_a_merge_holds_no_more_than_a_run(spark, monkeypatch):
    """Distinct texts: whatever the number of rounds, an entry table stays near the size of a first run."""
    df = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = exact.digests(df).withColumn("task", F.spark_partition_id())
    tasks = rows.agg(F.max("task")).first()[0] + 1
    first = rows.mapInArrow(exact._first_runs(True, tasks, 64), exact.PIECE)
    most = lambda f: f.groupBy("run", "range").agg(F.sum(F.octet_length("entries") / exact.ENTRY.itemsize).alias("n")).agg(F.max("n")).first()[0]
    assert most(first.withColumn("run", F.floor(F.col("run") / exact.FAN))) <= 2 * 64
    second = first.withColumn("run", F.floor(F.col("run") / exact.FAN)).groupBy("run", "range").applyInArrow(exact._round(58), exact.PIECE)
    assert most(second.withColumn("run", F.floor(F.col("run") / exact.FAN))) <= 2 * 64


def test_heavy_groups_join_like_light_ones(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3")
    want = sorted(map(tuple, rows.join(groups, "k", "left").collect()))
    for heavy in (1, 10, 100_000):
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert sorted(map(tuple, common.join_by_weight(rows, groups, ["k"], "n", 1000).select("k", "id", "n").collect()), key=str) == sorted(want, key=str)


# periodic runs


def plain_runs(w, least=12):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, 2 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 4:
            a, p = rng.randrange(n), 1 + rng.randrange(8)
            w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
        for least in (2, 5, 12):
            assert [tuple(r) for r in runs.text_runs(w, least).tolist()] == plain_runs(w, least)


def test_suffix_tree_holds_every_suffix():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))] + [0]
        kids, depth = runs.suffix_tree(s)
        leaves, turns = runs.tour(kids, depth)
        suffixes = sorted(range(len(s)), key=lambda i: s[i:])
        assert leaves.tolist() == suffixes
        for a, b, d in zip(suffixes, suffixes[1:], turns[1:], strict=False):
            assert s[a : a + d] == s[b : b + d] and s[a + d] != s[b + d]
        turned = sorted(range(len(s)), key=lambda i: [-x if x else -9 for x in s[i:]])
        assert runs.tour(kids, depth, down=True)[0].tolist() == turned


def test_queries_rows_follow_from_each_documents_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_runs(spark, sf).collect()}
    some = 0
    for d in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = got.pop(d["doc_id"])
        if n > 1500:  # the plain search is quadratic
            continue
        found = plain_runs(w)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        some += bool(found)
        assert (r["n_runs"], r["runs_sha256"]) == (len(found), sha("".join(f"{s},{size},{q}\n" for s, size, q in found)))
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some > 10 and not got


def test_runs_of_odd_rows(odd, spark):
    got = runs.periodic_runs(odd).collect()
    assert len(got) == odd.count()
    long = next(r for r in got if r["doc_id"] == 5)
    assert [tuple(x) for x in long["runs"]] == [(0, 90_000, 3 * 977)] and len(long["text"].split()) == 3 * 977
    assert {r["text"] for r in got if r["doc_id"] in (2, 3, 8)} == {""}
    assert runs.periodic_runs(odd.limit(0)).count() == 0 == runs.run_digests(runs.periodic_runs(odd.limit(0))).count()
    two = spark.createDataFrame([(1, "a " * 12 + "b " * 13 + "x"), (2, "a b " * 5 + "a")], "doc_id long, text string")
    d = {r["doc_id"]: r for r in runs.run_digests(runs.periodic_runs(two)).collect()}
    assert (d[1]["n_runs"], d[1]["start"], d[1]["length"], d[1]["period"], d[1]["exponent_milli"]) == (2, 12, 13, 1, 13000)
    assert (d[2]["n_runs"], d[2]["start"]) == (0, None)


# Merkle manifest


def plain_manifest(rows):
    """Of (doc_id, text, lang, source, n_chars); trees as lists of levels."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: sha("".join(part(x) for x in (r[0], r[3], r[2], r[4], t)))
    low = lambda x: (x is not None, x or 0)

    def tree(hs):
        levels = [hs]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for hs in levels[:-1]:
            a = i // 16 * 16
            yield hs[a:i], hs[i + 1 : a + 16]
            i //= 16

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (low(r[0]), leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    for at, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = [*path(trees[s], i), *path(top, at)]
            h = trees[s][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                h = leaf(r, lowered(r[1]))
            for a, b in steps:
                h = sha("".join([*a, h, *b]))
            yield str(r[0]), trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(x for a, b in steps for x in [*a, *b])), h, h == top[-1][0]


def check_manifest(df):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect()]
    got = [(str(r[0]), *r[1:]) for r in manifest.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(map(tuple, got)) == sorted(plain_manifest(rows))
    return got


def test_manifest_of_odd_rows(odd):
    got = check_manifest(odd)
    assert {True} <= {g[-1] for g in got}
    check_manifest(odd.where("doc_id = 2"))  # a lone leaf of a lone source is the root
    check_manifest(odd.where("doc_id IN (2, 8)"))
    check_manifest(odd.where("doc_id IN (2, 9)"))
    assert manifest.manifest(odd.limit(0)).count() == 0


@pytest.mark.parametrize("ancestors", [0, manifest.ANCESTORS])
def test_manifest_of_deep_and_wide_trees(spark, monkeypatch, ancestors):
    """A hot source of three levels, sources of 16, 17 and 1 rows, and more sources than a run holds; with and without broadcast ancestors."""
    monkeypatch.setattr(manifest, "ANCESTORS", ancestors)
    rows = [(i, f"Text {i}", "en", "hot", i) for i in range(700)] + [(1000 + i, "Same", None, "even", 1) for i in range(16)] + [(2000 + i, None, "de", "odd", None) for i in range(17)]
    rows += [(3000 + i, f"S{i % 3}", "fr", f"s{i // 2 if i < 30 else i}", 2) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = check_manifest(df)
    assert len({g[3] for g in got}) == 1 and {g[-1] for g in got} == {True, False}


def test_a_changed_row_fails_and_its_neighbours_do_not(spark):
    df = spark.createDataFrame([(i, "ABC", "en", "s", 3) for i in range(40)], SCHEMA)
    for r in manifest.manifest(df).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)
