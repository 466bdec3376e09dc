"""Operators against plain programs that say the same on small tables."""

import hashlib
import random
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from lotwise.llm import chat, components, fingerprint, licenses, lines, packing, pieces, pii, quality, queries, simhash, topk


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.orderBy("doc_id").collect()}


def canon(t):
    form = unicodedata.normalize
    return re.sub(r"\s+", " ", form("NFKC", form("NFKD", form("NFD", t).casefold()).casefold())).strip()


def test_edits_and_fingerprints(docs, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(docs).collect()}
    assert sorted(got) == ids
    prints = {}
    for i, d in enumerate(ids):
        n, after = len(texts[d]), texts[ids[(i + 1) % len(ids)]]
        edited = texts[d][: n - n // 2] + after[: n // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == float(canon(edited) == canon(texts[d])) and r["near_next"] == float(canon(after) == canon(texts[d]))
        for p, t in ((r["fingerprint"], texts[d]), (r["edited_fingerprint"], edited)):
            assert prints.setdefault(p, canon(t)) == canon(t)
    assert len(prints) == len({*prints.values()})


def test_digests_that_collide_are_told_apart_by_bytes(docs, texts):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_documents(docs, bits=3).collect()}
    for a in texts:
        for b in texts:
            assert (got[a] == got[b]) == (canon(texts[a]) == canon(texts[b]))


def test_canonical_folds_form_case_and_space(spark):
    df = spark.createDataFrame([(1, "Ｈello  WORLD"), (2, "hello world "), (3, "hello-world"), (4, "é"), (5, "é")], "doc_id long, text string")
    p = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_documents(df).collect()}
    assert p[1] == p[2] != p[3] and p[4] == p[5]
    alike = [("STRASSE", "stra\u00dfe"), ("\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2"), ("\u01f0", "J\u030c"), ("\ufb01n", "FIN"), ("\u2126", "\u03c9"), ("\u1e9e", "ss")]
    df = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(alike) for j, t in enumerate(pair)], "doc_id long, text string")
    p = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_documents(df).collect()}
    assert all(p[2 * i] == p[2 * i + 1] for i in range(len(alike))) and len({*p.values()}) == len(alike)


def simple_hash(t, k=3):
    from xxhash import xxh64_intdigest

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for x in s:
        v = xxh64_intdigest(x.encode(), seed=42)
        for b in range(64):
            counts[b] += v >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))


def classes(prints, far=2):
    """Smallest key that each reaches by steps of ``far`` bits."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= far:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(docs, texts):
    prints = {d: simple_hash(t) for d, t in texts.items()}
    want = classes(prints)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_links_in_large_block_groups(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {*base}
    for _ in range(500):  # many fingerprints that share blocks
        p = rng.choice(base)
        for _ in range(rng.randint(1, 5)):
            p ^= 1 << rng.randrange(20)
        prints.add(p)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    want = classes({p: p for p in prints})
    edges = simhash.link_fingerprints(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    got = {r["node"] % (1 << 64): r["root"] for r in components.components(edges).collect()}
    sizes = lambda m: sorted(map(len, _groups(m)))
    full = {p: got.get(p, signed(p)) for p in prints}
    assert _groups(full) == _groups(want) and sizes(full)[-1] > 50


def _groups(m):
    out = {}
    for k, v in m.items():
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1001 + i) for i in range(60)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 1000 for i in range(1000, 1061)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_meet_the_similarity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, want, n = [], {}, 0
    for _ in range(40):
        base, first = [word() for _ in range(rng.randint(60, 400))], n
        for c in range(rng.randint(1, 6)):
            w = base[:]
            for _ in range(int(len(w) * 0.012) if c else 0):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            want[n] = first
            n += 1
    crowd = [word() for _ in range(300)]
    for c in range(60):  # a large group of near copies
        w = crowd[:]
        if c:
            w[rng.randrange(300)] = word()
        rows.append((n, " ".join(w)))
        want[n] = n - c
        n += 1
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sure = [d for d in want if d != want[d] and len(sets[d] & sets[want[d]]) >= 0.85 * len(sets[d] | sets[want[d]])]
    assert len(sure) > 100 and sum(got[d] == got[want[d]] for d in sure) >= 0.98 * len(sure)
    assert all(want[d] == want[g] for d, g in got.items())


def test_near_groups_compare_sets(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    refrain = " ".join(word() for _ in range(5)) + " "
    unlike = [refrain * 200 + " ".join(word() for _ in range(300)) for _ in range(2)]
    base = [word() for _ in range(300)]
    alike = [" ".join(base), " ".join(base) + (" " + " ".join(base[:7])) * 100]
    rows = list(enumerate(unlike + alike))
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def near_brute(rows, least=0.8):
    """Smallest id that each reaches over pairs of the similarity, all compared."""
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in rows}
    root = {d: d for d in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = []
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b:
                common = len(sets[a] & sets[b])
                if common >= least * (len(sets[a]) + len(sets[b]) - common):
                    pairs.append((a, b))
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return pairs, {d: find(d) for d in sets}


def test_near_groups_are_those_of_all_pairs(spark):
    """Texts of 4 to 600 words and copies about the least similarity, alone and among texts that share a passage."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, rows = [word() for _ in range(60)], []
    for n in [4, 5, 6, 8, 9, 12, 15, 20, 30, 40, 60, 90, 150, 300, 600] * 4:
        base = [word() for _ in range(n)]
        rows.append(base)
        for share in (0.012, 0.02, 0.024, 0.03, 0.04):
            w = base[:]
            for i in rng.sample(range(n), max(1, round(n * share))):
                w[i] = word()
            rows.append(w if rng.random() < 0.7 else w[: max(1, round(n * 0.85))])
    rows += [[word() for _ in range(20)] + passage + [word() for _ in range(20)] for _ in range(60)]
    rows = list(enumerate(map(" ".join, rows)))
    pairs, want = near_brute(rows)
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 60
    assert all(got[a] == got[b] for a, b in pairs) and got == want


def test_the_same_pairs_whatever_else_the_corpus_holds(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for i in range(40):
        base = [word() for _ in range(200)]
        other = base[:]
        for j in rng.sample(range(200), 4):
            other[j] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    more = [(1000 + i, " ".join(word() for _ in range(30))) for i in range(3000)]
    groups = lambda r: {x["doc_id"]: x["group"] for x in simhash.near_groups(spark.createDataFrame(r, "doc_id long, text string")).collect() if x["doc_id"] < 1000}
    assert groups(rows) == groups(rows + more)


def test_near_groups_join_variants_with_their_original(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, n = [word() for _ in range(300)], 2000
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):  # Jaccard 0.82 or so to the original, 0.68 among themselves
        w = base[:]
        for j in rng.sample(range(300), 6):
            w[j] = word()
        rows.append((i, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    near = [d for d in sets if len(sets[d] & sets[0]) >= 0.8 * len(sets[d] | sets[0])]
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(got[d] == 0 for d in near) / len(near)
    assert len(near) > 1900 and recall >= 0.999, recall


def test_packing_holds_the_tokenizers_ids(docs, texts):
    import numpy as np
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(docs, queries.tokenizer_path(), shard_pieces=60).cache()
    for r in got.collect():
        ids = [*own.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    sequences = {}
    for r in got.collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    p = packing.padding(got).first()
    assert p["tokens"] == sum(len(own.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values()) and p["padding"] <= 0.1 * p["tokens"]


def test_packing_does_not_depend_on_the_layout(spark, docs):
    columns = ["doc_id", "start", "sequence_id", "offset"]
    twice = docs.union(docs.limit(20))
    one = packing.pack(twice.repartition(7), queries.tokenizer_path(), shard_pieces=30).select(*columns).collect()
    two = packing.pack(twice.coalesce(1).orderBy("text"), queries.tokenizer_path(), shard_pieces=30).select(*columns).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_another_tokenizer_goes_through_its_library(docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    own, mine = Tokenizer.from_file(path), packing.WordIds(path)
    some = [*texts.values()][:40] + ["Hello THERE  you", ""]
    assert not mine.by_words and [memoryview(x).cast("I").tolist() for x in mine(some)] == [own.encode(t, add_special_tokens=False).ids for t in some]


def test_words_are_cut_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    own, mine = Tokenizer.from_file(queries.tokenizer_path()), packing.WordIds(queries.tokenizer_path())
    odd = ["a\x1cb c\x85d e\xa0f", "don't <|endoftext|>x <|startoftext|>", "É́ Σas ΟΔΟΣ İstanbul ﬁ ½ ²", "it's!! we'll 123 a1b2 __x__ 你好", "DON'T 'S 1½²x µm ÀÉÿ", "", ".'t"] + [f"a{chr(c)}b.{chr(c)}!1{chr(c)}" for c in range(256)]
    for t, ids in zip(odd, mine(odd), strict=True):
        assert memoryview(ids).cast("I").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    for _ in range(50):
        window = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 80))]
        where, offset = packing.best_fit_decreasing(lengths, window)
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            room = window - offset[i]
            fit = [x for x in rooms if x >= lengths[i]]
            assert room == (min(fit) if fit else window)
            if fit:
                rooms.remove(room)
            rooms.append(room - lengths[i])


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).cache()
    for r in got.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("acc"), F.count("*").alias("n")).first()
    assert held["n"] > 80 and held["acc"] >= 0.97


def plain_statistics(t):
    import math

    if not t:
        return [0.0] * 25
    n, raw = len(t), t.encode()
    among = lambda chars: sum(c in chars for c in t) / n
    words, lines = t.split(), t.split("\n")
    w = max(1, len(words))
    share = lambda f: sum(map(f, words)) / w
    most = max((words.count(x) for x in {*words}), default=0) if len(words) < 3000 else None
    back = next((i for i in range(1, len(words)) if words[i] == words[0]), 0) if len(words) >= 2 else 0
    step = max(1, len(words) // 2 // 64)
    at = range(0, len(words) - back, step)
    return [
        math.log(1 + n), math.log(1 + len(words)), sum(map(len, words)) / w if words else 0.0, math.log(1 + max(map(len, words), default=0)),
        among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among("0123456789"), among(".,;:'\"()?-"), among("#$%&*+/<=>@[\\]^_`{}~"), among("|"), among("!"), among(" \t\n\r"),
        sum(b >= 128 for b in raw) / len(raw), sum(chr(b).isalpha() for b in raw if b < 128) / len(raw),
        math.log(1 + len(lines)), len(words) / len(lines), 1 - len({*lines}) / len(lines), len({*words}) / w, most / w if most is not None else None,
        share(lambda x: len(x) <= 3) if words else 1.0, share(lambda x: len(x) >= 12), share(str.isupper), share(lambda x: not any(c.isalnum() for c in x) or x[-1] in "#$%&*|!"),
        share(lambda x: not x[-1].isalnum()), sum(words[i] == words[i + back] for i in at) / max(1, len(at)) if back else 0.0,
        math.log(1 + len(words) / max(1, t.count(".") + t.count("?"))),
    ]


def test_statistics_against_a_plain_program(texts):
    odd = ["", " ", "one", "a a a a", "x |! y#", "\n\n", "É é ß 你好", "A. B? c"]
    for t in [*texts.values(), *odd]:
        for name, got, want in zip(quality.FEATURES, quality.statistics(t), plain_statistics(t), strict=True):
            assert want is None or got == pytest.approx(want, abs=1e-9), (name, t[:80])


def test_scores_are_those_of_the_rules(spark, docs, sf):
    """Paths against a walk over the trees' own text, and the compiled column against rules that are weighed one by one."""
    import math

    table = quality.with_statistics(docs).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(table, labels)
    assert rules.rules
    for r in table.withColumn("p", rules.column()).collect():
        z = rules.intercept
        for rule, weight in rules.rules:
            if all(r[f] <= x if at_most else r[f] > x for f, at_most, x in rule):
                z += weight
        assert r["p"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = table.join(labels, "doc_id").select(F.col("quality").cast("double").alias("label"), *quality.FEATURES)
    forest = RandomForestClassifier(numTrees=4, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=quality.FEATURES, outputCol="features").transform(rows))
    want = set()
    for tree in forest.trees:
        path = {}
        for line in tree.toDebugString.split("\n"):
            if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)", line):
                path = {k: v for k, v in path.items() if k < len(m[1])} | {len(m[1]): (quality.FEATURES[int(m[2])], m[3] == "<=", float(m[4]))}
                want.add(tuple(path[k] for k in sorted(path)))
    assert {*quality.tree_paths(forest)} == want


def test_sample_is_bounded_and_takes_a_document_once(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    twice = docs.union(docs)
    a, b = (quality.fit(quality.with_statistics(d), labels) for d in (docs, twice))
    assert a == b


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    m = rng.integers(-3, 4, size=(300, 6))
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(m)], "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, candidate_block=40, query_block=2).collect())
    s = m @ m.T
    want = [(q, k + 1, int(i), int(s[q, i])) for q in range(0, 300, 50) for k, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))[:5])]
    assert got == want


def test_top_k_counts_every_row(spark):
    rows = [(0, [1, 0]), (1, [5, 0]), (1, [3, 9]), (2, [4, 0]), (2, [4, 0]), (3, [0, 7]), (50, [2, 1]), (50, [1, 1]), (None, [9, 9]), (4, None)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 50 == 0, 3, candidate_block=2, query_block=1).orderBy("query_id", "rank").collect()]
    known = [r for r in rows if None not in r]
    want = []
    for q in (0, 50):
        pairs = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for i, a in known for j, b in known if i == q != j)
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(pairs[:3])]
    assert got == want


def line_brute(texts):
    """The template tree by its definition, over whole tokens, one leaf after another."""
    from xxhash import xxh64_intdigest

    def byte(w, full=(1 << 64) - 1):
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w.encode())) & full
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & full
        return 1 + ((h ^ h >> 32) >> 40) % 254

    seen = {}  # leaf: {tokens: first document}; and where lines of a leaf are
    where = {}
    for d in sorted(texts):
        for i, line in enumerate(texts[d].split("\n") if texts[d] else []):
            words = line.split()
            n = len(words)
            masked = ["*" if any(c in "0123456789" for c in w) else w for w in words]
            if n < 2:
                continue
            if n < 5 or n - masked.count("*") < 4:
                found, own = [("exact", " ".join(words))], None
            else:
                cut = [masked[: n // 3], masked[n // 3 : 2 * n // 3], masked[2 * n // 3 :]] if n >= 9 else [masked[0::2], masked[1::2]]
                found = [(n, masked[0], j, tuple(x)) for j, x in enumerate(cut) if sum(w != "*" for w in x) >= 2] or [(n, masked[0], tuple(masked))]
                own = tuple(masked)
            for leaf in found:
                seen.setdefault(leaf, {}).setdefault(own, d)
                where.setdefault((leaf, own), set()).add((d, i))
    drop = set()
    code = lambda own: bytes(0 if w == "*" else byte(w) for w in own)

    def merge(lines):
        """(form, first) in order to the template that each joins."""
        made, to = [], {}
        for first, key, form in sorted(lines, key=lambda x: (x[0], x[1])):
            best = None
            for t in made:
                same = [a == b and a != "?" for a, b in zip(form, t["form"], strict=True)]
                fixed = sum(x and a != "*" for x, a in zip(same, form, strict=True))
                if sum(same) >= 0.65 * len(form) - 1e-9 and fixed >= 4 and (best is None or sum(same) > best[0]):
                    best = (sum(same), t, same)
            if best is None:
                made.append({"form": form, "first": first, "leader": key})
                to[key] = made[-1]
            else:
                best[1]["form"] = tuple(a if x else "?" for a, x in zip(best[1]["form"], best[2], strict=True))
                to[key] = best[1]
        return to

    for leaf, lines in seen.items():
        if leaf[0] == "exact":
            first = {None: lines[None]}
        else:
            parts, first, heads = {}, {}, []
            for own, d in lines.items():
                parts.setdefault((xxh64_intdigest(code(own), seed=42) - (1 << 64) * (xxh64_intdigest(code(own), seed=42) >> 63)) % 16, []).append((d, code(own), own))
            part_of = {}
            for rows in parts.values():
                to = merge(rows)
                for _, key, own in rows:
                    part_of[own] = to[key]
                for t in {id(t): t for t in to.values()}.values():
                    heads.append(t)
            shown = lambda t: bytes(255 if w == "?" else 0 if w == "*" else byte(w) for w in t["form"])
            frozen = {id(t): (t["first"], shown(t), t["form"]) for t in heads}
            to = merge(frozen.values())
            for own in lines:
                first[own] = to[frozen[id(part_of[own])][1]]["first"]
        for own in lines:
            drop |= {(d, i) for d, i in where[(leaf, own)] if d != first[own]}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in drop) if t else "" for d, t in texts.items()}


def test_line_dedup(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = line_brute(texts)
    got = {r["doc_id"]: r for r in lines.drop_recurring_lines(docs).collect()}
    assert {d: r["text"] or "" for d, r in got.items()} == want
    assert all(r["n_lines"] == (len(texts[d].split("\n")) if texts[d] else 0) for d, r in got.items())
    assert all((r["n_dropped"] == 0) == (texts[d] == want[d]) for d, r in got.items())


def test_leaves_that_are_joined(spark, docs, texts, monkeypatch):
    want = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs).collect()}
    monkeypatch.setattr(lines, "BROADCAST_LEAVES", -1)
    assert {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs).collect()} == want


def test_templates_generalise_what_differs(spark):
    rows = [(1, "User Alice logged in from Paris"), (2, "User Bob logged in from Rome\nUser Eve logged out on Sunday evening"), (3, "User Carol logged in from Oslo\nSomething else stands in here"), (4, "first words here that differ and then the same last five words follow"), (5, "other ones over here alike or then some very unlike last words end")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "User Eve logged out on Sunday evening", 3: "Something else stands in here", 4: rows[3][1], 5: rows[4][1]}


def test_a_mass_of_lines_of_one_template(spark):
    rng = random.Random(14)
    name = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows = [(i, f"The order of {name()} was sent to the town of {name()} on a {rng.choice(['cold', 'warm'])} day\nown line {name()} {name()} {name()} {name()} {name()} {name()}") for i in range(3000)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == rows[i][1].split("\n")[1] for i in range(1, 3000))


def test_lines_with_fields(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, f"Page 3 of 17 printed for you today\nunique first line of the text here\n{passage}"), (2, f"Page 12 of 99 printed for you today\nanother line that only stands in here\n{passage}"), (3, "A clean document, with nothing shared.\nOf.\nIn."), (4, "The log entry of user alpha was stored in the main table at noon today\nOf."), (5, "The log entry of user beta was stored in the main table at noon today\nIn.")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[4] == rows[3][1]
    assert got[2] == "another line that only stands in here" and got[5] == "In."


def test_short_lines_recur_by_their_exact_text(spark):
    rows = [(1, "All rights reserved.\nPage 3 of 17 2024\nfirst words"), (2, "All  rights reserved.\nPage 3 of 17 2024\nPage 4\nother words"), (3, "All rights reversed.\nPage 4 of 17 2024\nPage 5\nAll rights reserved.")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Page 4\nother words", 3: "All rights reversed.\nPage 4 of 17 2024\nPage 5"}


def test_patience_on_shuffled_texts():
    rng = random.Random(6)
    for _ in range(200):
        a = [str(rng.randrange(30)) for _ in range(rng.randint(0, 60))]
        b = [w for w in a if rng.random() < 0.8]
        for _ in range(rng.randint(0, 8)):
            b.insert(rng.randint(0, len(b)), str(rng.randrange(40)))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.patience(list("abcdef"), list("abXdef"))) == 5


def test_each_license_is_found_as_itself_alone():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for said, places in ((text, 1), (f"Words that come before. {text} And words that follow.", 1), (f"{text} {text}", 2), (f"{text}\n" + "filler of another kind " * 300 + text.upper(), 2)):
            assert [(x[0], x[1], x[4]) for x in scanner.scan(said)] == [(name, 1.0, places)], name
    rng = random.Random(15)
    for name, text in licenses.TEMPLATES.items():
        said = text.split()
        if len(said) > 40:  # every tenth word lost or another, and remarks between
            said = [w for i, w in enumerate(said) if i % 10 or w in ("2", "3", "Lesser", "Affero")] + ["tail"]
            for _ in range(len(said) // 4):
                said.insert(rng.randrange(len(said)), "remark")
            found = scanner.scan(" ".join(said))
            assert [x[0].split("-")[0] for x in found] == [name.split("-")[0]], (name, found)
    both = licenses.TEMPLATES["MIT"] + " and also " + licenses.TEMPLATES["CC-BY-SA-4.0-notice"]
    assert {x[0] for x in scanner.scan(both)} == {"MIT", "CC-BY-SA-4.0-notice"}
    for clean in ("The license of the driver was under the general seat.", "Version 2.0 of the public work is licensed to nobody", "by 4.0 under cc"):
        assert scanner.scan(clean) == []


def test_license_scan_of_whole_tables(docs, texts, spark):
    """Whole results against runs of words that a plain search finds."""
    plain = {d: f" {' '.join(re.findall(r'[^\W_]+(?:[.][0-9]+)*', t.lower()))} " for d, t in texts.items()}
    said = {n: f" {' '.join(re.findall(r'[^\W_]+(?:[.][0-9]+)*', t.lower()))} " for n, t in licenses.TEMPLATES.items()}
    want = {(d, n) for d, t in plain.items() for n in said if said[n] in t}
    assert want and {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()} == want
    mit = licenses.TEMPLATES["MIT"]
    df = spark.createDataFrame([(1, "before it. " + mit.replace("hereby ", "").replace("Software", "Work", 2) + " after it. " * 50 + mit), (2, mit[:200]), (3, "clean words"), (4, None)], "doc_id long, text string")
    r = licenses.scan_licenses(df, {"MIT": mit}).collect()
    assert [(x["doc_id"], x["places"]) for x in r] == [(1, 2)] and r[0]["coverage"] == 1.0


def test_gaps_without_anchors_are_aligned_whatever_their_size():
    a, b = ["x", "y"] * 150, ["y", "x"] * 150
    assert len(licenses.patience(a, b)) >= 298


TEXT = 'x +1 (743) 555-3824 y +1 743 555 3824; 4539578763621486, 70.23.22.57 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Hein.19@mail5.example.com hein.19@mail5.example.com Mr. John Smith and Mr. Smith, Frau Anna Müller. Version 2.0. 2019-12-31'


def test_surrogates_keep_kind_format_and_reference():
    made, n = pii.replace(TEXT, b"k", {})
    assert n == len(pii.find(TEXT)) == 12 and made == pii.replace(TEXT, b"k", {})[0] != pii.replace(TEXT, b"other", {})[0]
    for gone in ("555-3824", "4539578763621486", "70.23.22.57", "24be6443", "hein.19", "John", "Smith", "Müller"):
        assert gone not in made and gone.lower() not in made.lower()
    assert "Version 2.0. 2019-12-31" in made
    again = pii.find(made)
    assert [k for _, _, k, _ in again] == [k for _, _, k, _ in pii.find(TEXT)]
    ids = [pii.identity(k, m) for _, _, k, m in again]
    was = [pii.identity(k, m) for _, _, k, m in pii.find(TEXT)]
    assert all((ids[i] == ids[j]) == (was[i] == was[j]) for i in range(len(ids)) for j in range(len(ids)))
    assert pii._luhn(ids[2])


def test_secrets_without_digits_and_names_of_all_scripts():
    for text, gone in (("password: CorrectHorseBattery", "CorrectHorse"), ("SECRET=abcdefghij", "abcdefghij"), ("API_KEY: abcdEFGHijkl", "EFGHijkl"), ("pwd = opensesameplease", "opensesame"), ("use ghp_" + "abcdeFGHIJ" * 3, "abcde")):
        made, n = pii.replace(text, b"k", {})
        assert n == 1 and gone not in made
    for text, n in (("Prof. Łukasz Żółty spoke. Żółty's view", 3), ("Mr. John Smith came. Smith said so, and so did Smithson", 3), ("Dr. J. Müller-O'Brien", 1), ("Herr Dr. Weiß", 1)):
        made, found = pii.replace(text, b"k", {})
        assert found == n and not any(x in made.replace("Smithson", "") for x in ("ukasz", "Żółty", "John", "Smith", "Müller", "Brien", "Weiß"))
    made = pii.replace("Mr. John Smith came. Smith said so.", b"k", {})[0].split()
    assert made[2] == made[4]


def test_collisions_are_redrawn(spark):
    names = [f"N{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    ids = spark.createDataFrame([("namem", n) for n in names], "kind string, value string")
    again = {(r["kind"], r["value"]): r["attempt"] for r in pii.redraws(ids, b"k").collect()}
    first = [pii.surrogate(b"k", "namem", n) for n in names]
    last = [pii.surrogate(b"k", "namem", n, again.get(("namem", n), 0)) for n in names]
    assert len({*first}) < len(names) == len({*last}) and not {*last} & {*names}


def test_one_surrogate_per_person_and_values_that_run_out():
    said = "Mr. John Smith met Smith. Mr. John left, and Mrs. Smith stayed with John."
    made = re.findall(r"\w+", pii.replace(said, b"k", {})[0])
    was = re.findall(r"\w+", said)
    to = {}
    for a, b in zip(was, made, strict=True):
        assert to.setdefault(a, b) == b and (a == b) == (a not in ("John", "Smith"))
    for kind, value in (("email", "a@b.co"), ("ssn", "123-45-6789"), ("namem", "Νίκος"), ("card", "4539578763621486"), ("secret", "12345678")):
        value = pii.identity(kind, value)
        made = {pii.surrogate(b"k", kind, value, n) for n in range(200)}
        assert len(made) > 150 and pii.dress(kind, value, pii.surrogate(b"k", kind, value, 40))


def test_long_numbers_that_are_no_cards_stay():
    for said in ("order 9807915762804490", "4539578763621487", "1234567890123", "0810992847249404", "20240131120000123"):
        assert pii.replace(said, b"k", {}) == (said, 0)
    for card in ("4539578763621486", "4539 5787 6362 1486", "5105105105105100", "378282246310005", "6011111111111117", "2223003122003222"):
        made, n = pii.replace(f"paid with {card}.", b"k", {})
        assert n == 1 and card not in made and pii.find(made)[0][2] == "card" and [c for c in made if not c.isdigit()] == [c for c in f"paid with {card}." if not c.isdigit()]


def test_a_crowded_format_ends(spark):
    ids = spark.createDataFrame([("email", f"{a}@{b}.co") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], "kind string, value string")
    again = {r["value"]: r["attempt"] for r in pii.redraws(ids, b"k").collect()}
    made = [pii.surrogate(b"k", "email", r["value"], again.get(r["value"], 0)) for r in ids.collect()]
    assert len({*made}) == len(made) == 676 and not {*made} & {r["value"] for r in ids.collect()}


PLAIN = {"email": r"[\w.+-]+@[\w-]+\.[\w.-]*\w", "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])", "card": r"(?<!\d)\d{16}(?!\d)", "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}", "key": r"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])"}


def test_surrogates_against_plain_patterns(spark):
    """What simple patterns of the test's own find is replaced, one value by one value of the same form, and nothing else changes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    was = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    made = {r["doc_id"]: r["text"] or "" for r in pii.pseudonymise(docs, b"k").collect()}
    every, to = re.compile("|".join(PLAIN.values())), {}
    sums = lambda x: sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(x)) % 10 == 0
    found = lambda t: [x for x in every.findall(t) if len(x) != 16 or not x.isdigit() or x[0] == "4" and sums(x)]
    for d, t in was.items():
        a, b = found(t), found(made[d])
        assert len(a) == len(b), d
        for x, y in zip(a, b, strict=True):
            assert x != y and to.setdefault(x.lower(), y.lower()) == y.lower()
            assert [c.isdigit() for c in x if not c.isalpha()] == [c.isdigit() for c in y if not c.isalpha()] or "@" in x or "." in x or len(x) == 40
        if not a and not re.search(r"\d{13}|\d \d{3} \d{3}", t) and not re.search(r"(?i)secret|token|passw|pwd|key|\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Don|Herr|Frau|Sr|Sra|Mme|Madame|Monsieur)\b|\d{3}[ .-]\d|[0-9a-zA-Z]{16}", t):
            assert made[d] == t, d
    assert len(to) > 50 and len({*to.values()}) == len(to) and not {*to} & {*to.values()}


def test_surrogates_in_a_table(docs, texts):
    a = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, b"k").collect()}
    b = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, b"k", -1).collect()}
    assert a == b
    kept = [(m, d) for d, t in texts.items() for _, _, k, m in pii.find(t) if m in a[d]]
    assert not kept and all(a[d] == t for d, t in texts.items() if not pii.find(t))


def test_pieces_are_the_librarys(docs, texts):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_MODEL)
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode_documents(docs, path).cache()
    for r in encoded.collect():
        assert list(r["ids"]) == own.encode(texts[r["doc_id"]]) and r["restored"] and r["n_pieces"] == len(r["ids"])
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, path).collect()}
    assert back == texts
    rng = random.Random(7)
    odd = ["", "  a  b\n c\t é ﬁ", "你好，世界 hello", "aaaa" * 50, " ", "\x00a\x00", "İ é \U0001f600"] + ["".join(rng.choices("abcdetinos .\n", k=200)) for _ in range(100)]
    assert [memoryview(x).cast("I").tolist() for x in pieces.pieces(path).encode(odd)] == own.encode(odd)


def test_runs_longer_than_an_index(texts, monkeypatch):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_MODEL)
    own, mine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.pieces(path)
    monkeypatch.setattr(pieces, "INDEXED", 50)
    mine.known.clear()
    rng = random.Random(16)
    said = ["".join(rng.choices("abcdetinors", k=n)) for n in (49, 50, 51, 99, 1000, 5000)] + ["the" * 400, "x y " * 60, *[*texts.values()][:5]]
    assert [memoryview(x).cast("I").tolist() for x in mine.encode(said)] == own.encode(said)
    assert max(map(len, mine.known)) <= pieces.REMEMBERED


def test_models_of_another_kind_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(queries.tokenizer_path(queries.PIECE_MODEL), "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.Pieces(str(other))


def test_suffix_array_is_sorted():
    import numpy as np

    rng = np.random.default_rng(8)
    for n, top in ((1, 3), (40, 2), (300, 4), (200, 200)):
        codes = rng.integers(0, top, n)
        s = [tuple(codes[i : i + 16].tolist()) for i in pieces.suffix_array(codes, 16)]
        assert s == sorted(s)


def test_template_is_reversible():
    rng = random.Random(9)
    parts = ["\\", "<|", "|>", "im_end", "<|im_end|>", "<|im_start|>", "a", "\n", "<", "|", "assistant"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "a<|b", "\\"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(3)]
        said = "".join(chat.render(*t) for t in turns)
        found = chat.parse(said)
        assert [x[:2] for x in found] == turns and [chat.unescape(said[a:b]) for _, _, a, b in found] == [t for _, t in turns]


def test_layouts_become_turns(spark):
    import json

    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "q", "input": "", "output": "a", "id": 3}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"colour": 1}, None]
    df = spark.createDataFrame([(i, json.dumps(r) if r else r) for i, r in enumerate(records)] + [(9, "{broken")], "id long, record string")
    got = chat.canonical_turns(df, "id", "record").collect()
    for i in range(5):
        assert [(r["role"], r["text"]) for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["turn"])] == [("user", "q"), ("assistant", "a")]
    assert sorted(r["id"] for r in got if r["layout"] == "unknown") == [5, 6, 9]


def test_chat_query_takes_the_mapping_of_its_schema(spark, sf, monkeypatch):
    rows = spark.createDataFrame([("human", 0, 7, "q"), ("gpt", 1, 7, None)], "role string, message_index long, conversation_id long, content string")
    assert [tuple(r) for r in chat.table_turns(rows).collect()] == [(7, "message_rows", 0, "user", "q"), (7, "message_rows", 1, "assistant", None)]
    with pytest.raises(ValueError, match="colour"):
        chat.table_turns(rows.withColumnRenamed("content", "colour"))
    monkeypatch.setattr(chat, "TABLE_REGISTRY", {})
    with pytest.raises(ValueError, match="conv_id"):
        queries.op10_chat(spark, sf)


def test_chat_query_against_a_plain_program(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    convs = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        convs.setdefault(c, []).append((role, text or ""))
    got = {r["conv_id"]: r for r in queries.op10_chat(spark, sf).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
