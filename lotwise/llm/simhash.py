"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming verification, components.

``link_fingerprints`` finds every pair within a Hamming distance of 2: of four 16-bit blocks at least two stay equal, so each
close pair meets under one of six 32-bit keys. Small key groups are joined with themselves and verified. In a large group
(many different fingerprints under one key, as a mass of near copies makes) pairs would grow with the square; there each
fingerprint is sent to itself and to its one-bit variants within the two open blocks, and all that meet at a variant are
linked to the smallest. Two fingerprints meet at a variant just when they differ in two bits or fewer, and no more than 33
can, so no link is lost and none is made in vain.

``near_groups`` is the pipeline's form: five-word shingles and a Jaccard similarity of 0.8 or more. That is about a sixth of a
SimHash's bits, too far for blocks of bits, so the blocks are cut from what the bits are made of: a text's shingles are dealt by
their hashes into as many parts as a near copy may have other shingles, and two more; a part's hashes make a block. By the
pigeonhole principle two near texts have parts without a differing shingle, so they share blocks. How many parts there are
follows from the texts' sizes alone, so a pair meets or doesn't whatever else a corpus holds. Pairs that share a block are
verified by the Hamming distance of their 256-bit SimHashes, by a lower bound on their differing shingles (512 parities) and then by their
shingle sets; no link is made on bits alone.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, row_key, written
from .components import components, joined

SPACES = r"[\x20\x09-\x0D]+"
#: Key groups of up to so many fingerprints are joined with themselves.
SMALL_GROUP = 16


def shingle_hashes(text: Column, words: int) -> Column:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included, as array<bigint>.

    Case is folded for A-Z only and words end at ASCII white space. With fewer words: one hash of the whole sequence; with
    none, or a null text: no hash.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tokens = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), SPACES), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(words)])))
        return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    # bound once by transform over a single cell: the optimiser would otherwise repeat the split in every use
    return F.element_at(F.transform(F.array(tokens), hashes), 1)


class _Vote:
    """Majority of each bit over a document's hashes; lanes past the first from a bijective mix of the hash."""

    def __init__(self, lanes: int):
        self.lanes = lanes

    def __call__(self, batch) -> dict:
        import numpy as np

        column = batch.column("hashes")
        offsets = column.offsets.to_numpy().astype("int64")
        values = column.values.to_numpy(zero_copy_only=False).view("uint64")
        start, sizes = offsets[:-1], np.diff(offsets)
        prints = np.zeros((len(sizes), self.lanes), "uint64")
        full = np.flatnonzero(sizes)
        for i in full if sizes.max(initial=0) > 100_000 else [full] if len(full) else []:
            rows = np.atleast_1d(i)
            lo, hi = start[rows[0]], start[rows[-1]] + sizes[rows[-1]]
            prints[rows] = self.vote(values[lo:hi], start[rows] - lo, sizes[rows])
        out = {name: batch.column(name) for name in batch.schema.names if name != "hashes"}
        if self.lanes == 1:
            return out | {"fp": prints[:, 0].view("int64")}
        return out | {"fp": list(prints.view("int64"))}

    def vote(self, values, start, sizes):
        import numpy as np

        prints = np.zeros((len(sizes), self.lanes), "uint64")
        for lane in range(self.lanes):
            x = values
            if lane:
                with np.errstate(over="ignore"):
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * lane)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    x = x ^ (x >> np.uint64(31))
            counts, step = np.zeros((len(sizes), 64), "int64"), 1 << 18
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for at in range(0, len(x), step):
                bits = np.unpackbits(np.ascontiguousarray(x[at : at + step], "<u8").view("uint8"), bitorder="little").reshape(-1, 64)
                own = owner[at : at + step]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype="int32")
            prints[:, lane] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return prints


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """``keep`` and ``fp``: the 64-bit fingerprint (bigint), or an array of ``lanes`` of them. No words: zero."""
    rows = docs.select(*keep, shingle_hashes(F.col(text), words).alias("hashes"))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("fp", T.LongType() if lanes == 1 else T.ArrayType(T.LongType()))])
    return map_arrow(rows, _Vote(lanes), schema)


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(a, b) links that join all fingerprints (distinct, column ``fp``) within a distance of 2: as many as connect them."""
    fp = F.col("fp")
    block = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = list(combinations(range(4), 2))
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("k")) for c, (i, j) in enumerate(pairs)]))
    keyed = prints.select("fp", keys.alias("x")).select("fp", "x.*")
    shared = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    meets = written(keyed.join(shared, ["c", "k"]))

    small = meets.where(F.col("n") <= SMALL_GROUP)
    other = small.select("c", "k", fp.alias("b"))
    near = small.join(other, ["c", "k"]).where((fp < F.col("b")) & (F.bit_count(fp.bitwiseXOR(F.col("b"))) <= 2)).select(fp.alias("a"), "b")

    open_bits = [[b for b in range(64) if b // 16 not in pair] for pair in pairs]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in bits]) for bits in open_bits])
    variants = meets.where(F.col("n") > SMALL_GROUP).select("c", "fp", F.explode(F.element_at(flips, F.col("c") + 1)).alias("flip"))
    at = variants.select("c", fp.bitwiseXOR(F.col("flip")).alias("v"), "fp")
    least = at.groupBy("c", "v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = at.join(least, ["c", "v"]).where((fp != F.col("b")) & (F.bit_count(fp.bitwiseXOR(F.col("b"))) <= 2)).select(fp.alias("a"), "b")
    return near.unionByName(star)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reached by links of two bits or fewer.

    Null and empty texts have fingerprint zero, which links like any other. Null doc_ids keep their rows; they're left out
    of the minimum, so that a component of nothing else has a null id. Rows that repeat are answered one by one. No rows in,
    none out. Other columns are ignored.
    """
    rows = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], words=words))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_fingerprints(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(linked, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: 64-bit lanes of the longer fingerprint.
LANES = 4
#: 64-bit lanes of the odd buckets: they tell texts of up to about 900 shingles apart.
ODD_LANES = 8
#: Beyond so many differing bits of 256 a pair isn't near (39 at a similarity of 0.8, with a standard deviation of 6; 128 and 8
#: for unlike texts); the shingle sets decide on the others.
FAR_BITS = 80
#: The same bound of the exact mode: nine deviations above a near pair's 39, four below an unlike pair's 128.
EXACT_FAR_BITS = 96
#: Up to so many parts they are one more than a near pair's differing shingles; beyond, an eighth of the shingles: then a pair at
#: 0.8 shares 20 blocks or more on average, and none with a chance of exp(-20).
EXACT_PARTS, PART_SHINGLES = 64, 8
#: In block groups over SMALL_GROUP each text first meets the smallest and so many others that come next in order of fingerprint.
NEIGHBOURS = 3
#: Rounds in large groups go on as long as one new link comes from fewer than so many new pairs.
FEW = 20
#: Members of a block group that are compared in one place.
PART = 1024
#: In what is left of larger groups, a block counts together with so many others of the text.
EXTENSIONS = 8
#: Blocks that texts share are broadcast up to this number (8 bytes each); beyond it they are joined.
BROADCAST_BLOCKS = 500_000


class _Marks:
    """What tells most pairs apart before their shingles are compared: the long fingerprint; ``odd``, a bit for each of 64 * ODD_LANES buckets of the
    different hashes, set where a bucket holds an odd number of them; ``size``, how many there are. A differing hash turns one bit, so two texts differ in as many
    hashes as bits at least: that rules out no near pair."""

    def __init__(self):
        self.vote = _Vote(LANES)

    def __call__(self, batch) -> dict:
        import numpy as np

        column = batch.column("hashes")
        offsets = column.offsets.to_numpy().astype("int64")
        values, sizes = column.values.to_numpy(zero_copy_only=False).view("uint64")[offsets[0] : offsets[-1]], np.diff(offsets)
        odd = np.zeros(len(sizes) * ODD_LANES, "uint64")
        lane = ((values >> np.uint64(6)) % np.uint64(ODD_LANES)).astype("int64")
        np.bitwise_xor.at(odd, np.repeat(np.arange(len(sizes)), sizes) * ODD_LANES + lane, np.uint64(1) << (values & np.uint64(63)))
        return self.vote(batch) | {"odd": list(odd.view("int64").reshape(-1, ODD_LANES)), "size": sizes}


class _Blocks:
    """The marks of a text, and its blocks: of its size class, and of the next one if a near text may be of that.

    Size classes are bounded by powers of 1 / similarity**2, so near texts are in one class or in neighbouring ones.
    """

    def __init__(self, min_similarity: float):
        t = self.least = min(max(min_similarity, 0.05), 1.0)
        self.marks = _Marks()
        grow, bounds = max(1.02, t**-2), [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, math.ceil(grow ** len(bounds))))
        self.bounds = bounds
        self.parts = []
        for hi in bounds[1:]:
            differ = int(2 * (hi - 1) * (1 - t) / (1 + t) + 1e-9)
            self.parts.append(min(differ + 2, max(EXACT_PARTS, hi // PART_SHINGLES)))

    def __call__(self, batch) -> dict:
        import numpy as np

        out = self.marks(batch)
        column = batch.column("hashes")
        offsets = column.offsets.to_numpy().astype("int64")
        values, sizes = column.values.to_numpy(zero_copy_only=False).view("uint64")[offsets[0] : offsets[-1]], np.diff(offsets)
        own = np.searchsorted(self.bounds, sizes, "right") - 1
        near = (sizes / self.least + 1e-9).astype("int64") >= np.array(self.bounds)[own + 1]
        return out | {"own": self._blocks(values, sizes, own, sizes > 0), "next": self._blocks(values, sizes, own + 1, near & (sizes > 0))}

    def _blocks(self, values, sizes, classes, wanted) -> list:
        """For each text the blocks of its parts in order; null for a part without shingles."""
        import numpy as np

        parts = np.where(wanted, np.array(self.parts, "int64")[np.maximum(classes, 0)], 0)
        begin = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(sizes)), sizes)
        held = wanted[owner]
        values, owner = values[held], owner[held]
        with np.errstate(over="ignore"):
            at = begin[owner] + (((values >> np.uint64(32)) * parts[owner].astype("uint64")) >> np.uint64(32)).astype("int64")
            mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            sums, filled = np.zeros(int(parts.sum()), "uint64"), np.zeros(int(parts.sum()), "bool")
            np.add.at(sums, at, mixed ^ (mixed >> np.uint64(32)))
            filled[at] = True
            sums = (sums ^ np.repeat(classes.astype("uint64") + np.uint64(1), parts)) * np.uint64(0x94D049BB133111EB)
        import pyarrow as pa

        flat = pa.array(sums.view("int64"), mask=~filled)
        return pa.ListArray.from_arrays(pa.array(np.r_[begin, parts.sum()].astype("int32")), flat)


#: Hashes that the exact mode takes in one go.
HASH_BYTES = 1_000_000
#: Texts of so few shingles meet by the least of their hashes: parts would be few there, and those without a differing shingle may be empty.
SHORT = 64


class _Keys:
    """node and key, a row for each block of a text, in the exact mode.

    A pair is compared in the class of its smaller text: a text has the blocks of its own class, and of the one below if a near text may be of that.
    Under SHORT shingles blocks are single ones, the least by hash, one more than a near text may lack (prefix filtering). Keys have 48 bits,
    so that tables of them are small; a collision is a pair more to verify.
    """

    def __init__(self, min_similarity: float):
        t = self.least = min(max(min_similarity, 0.05), 1.0)
        bounds = [SHORT]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * t**-2)))
        self.bounds = bounds
        self.parts = [int((hi - 1 + int((hi - 1) / t + 1e-9)) * (1 - t) / (1 + t) + 1e-9) + 2 for hi in bounds[1:]]

    def __call__(self, batch) -> dict:
        import numpy as np

        column = batch.column("hashes")
        offsets = column.offsets.to_numpy().astype("int64")
        values, sizes = column.values.to_numpy(zero_copy_only=False).view("uint64")[offsets[0] : offsets[-1]], np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        fewest = np.ceil(self.least * sizes - 1e-9).astype("int64")
        own = np.searchsorted(self.bounds, sizes, "right") - 1
        below = (own >= 0) & (fewest < np.array(self.bounds)[np.maximum(own, 0)])
        found = [self._firsts(mixed, owner, sizes, fewest, (own < 0) | (below & (own == 0)))]
        found += [self._parts(values, mixed, owner, classes, wanted) for classes, wanted in ((own, own >= 0), (own - 1, below & (own > 0)))]
        texts, keys = (np.concatenate(c) for c in zip(*found, strict=True))
        return {"node": batch.column("node").to_numpy(zero_copy_only=False)[texts], "key": (keys >> np.uint64(16)).view("int64")}

    def _firsts(self, mixed, owner, sizes, fewest, wanted):
        import numpy as np

        held = wanted[owner]
        x, own = mixed[held], owner[held]
        order = np.lexsort((x, own))
        sizes = np.where(wanted, sizes, 0)
        place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[place <= (sizes - fewest)[own]]  # order is by text, so places and texts go together
        return own[order], x[order] * np.uint64(0x94D049BB133111EB)

    def _parts(self, values, mixed, owner, classes, wanted):
        import numpy as np

        parts = np.where(wanted, np.array(self.parts, "int64")[np.maximum(classes, 0)], 0)
        begin = np.cumsum(parts) - parts
        held = wanted[owner]
        values, own = values[held], owner[held]
        at = begin[own] + (((values >> np.uint64(32)) * parts[own].astype("uint64")) >> np.uint64(32)).astype("int64")
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(at) else np.zeros(0, "int64")
        sums = np.add.reduceat(mixed[held][order], first) if len(at) else np.zeros(0, "uint64")
        texts = own[order][first]
        return texts, (sums ^ (classes[texts] + 2).astype("uint64")) * np.uint64(0x94D049BB133111EB)


def _distance(a: str, b: str, lanes: int = LANES) -> Column:
    return sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(lanes))


#: Columns of ``_Marks``.
MARKS = ("fp", "odd", "size")


def _marked(x: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{x}") for c in MARKS]


def _may_be_near(min_similarity: float, exact: bool) -> Column:
    """Of marks of ``a`` and ``b``: not too many differing bits, and no more hashes that must differ than a near pair may have."""
    t = min(max(min_similarity, 0.05), 1.0)
    most = (F.col("size_a") + F.col("size_b")) * ((1 - t) / (1 + t)) + 1e-6
    return (F.abs(F.col("size_a") - F.col("size_b")) <= most) & (_distance("fp_a", "fp_b") <= (EXACT_FAR_BITS if exact else FAR_BITS)) & (_distance("odd_a", "odd_b", ODD_LANES) <= most)


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast up to BROADCAST_BLOCKS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_BLOCKS else table


def _meets_exact(hashed: DataFrame, min_similarity: float) -> DataFrame:
    """key, node, n, least: the blocks that different texts share. Blocks are made twice and never stored whole: first they are counted by their keys
    alone (a text that repeats counts again, so none is missed), then those that recur are made again with their texts."""
    keyed = map_arrow(hashed, _Keys(min_similarity), "node long, key long", HASH_BYTES)
    again = written(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    held = written(keyed.join(_few(again), "key").distinct())
    shared = written(held.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    return written(held.join(_few(shared), "key"))


def _close(candidates: DataFrame, texts: DataFrame, min_similarity: float, exact: bool = False) -> DataFrame:
    """a, b, bits of the candidates (a, b) that may be near by their marks."""
    a, b = (texts.select(F.col("node").alias(x), *_marked(x)) for x in "ab")
    return candidates.join(a, "a").join(b, "b").where(_may_be_near(min_similarity, exact)).select("a", "b", _distance("fp_a", "fp_b").alias("bits"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that no links join as yet."""
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return written(both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    s_a, s_b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return written(pairs.join(s_a, "a").join(s_b, "b").where(common >= min_similarity * (F.size("s_a") + F.size("s_b") - common) - 1e-9).select("a", "b"))


def _least_first(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _meet(members: DataFrame, min_similarity: float, exact: bool = False) -> DataFrame:
    """Pairs (a, b) of members (key, n, node, root, marks, outside) of a key: outsiders with all others that aren't joined to them and
    may be near by their marks. A key's members are compared in bounded parts."""
    parts = F.ceil(F.col("n") / PART)
    whole = members.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"), *_marked("b"), F.pmod(F.xxhash64("node"), parts).alias("part"))
    outside = members.where("outside").select("key", F.col("node").alias("a"), F.col("root").alias("root_a"), *_marked("a"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    o, w = outside.alias("o"), whole.alias("w")
    near = (F.col("o.key") == F.col("w.key")) & (F.col("o.part") == F.col("w.part")) & (F.col("root_a") != F.col("root_b")) & _may_be_near(min_similarity, exact)
    return o.join(w, near).select("a", "b")


def _link_large(large: DataFrame, tested: DataFrame, links: DataFrame, roots: DataFrame, texts: DataFrame, sets: DataFrame, min_similarity: float, exact: bool = False) -> DataFrame:
    """(node, root) after ``links`` (whose components are ``roots``) and those that the block groups ``large`` (key, node) still lack.

    Copies of one original are often near to it alone. So each group's member of most links meets all that aren't joined to
    it, round by round as long as that joins a fair share of them; then what is outside a group's commonest component meets the group. In
    groups over PART, such as texts make that have nothing but a common passage in one part, it meets those with which it shares
    one of EXTENSIONS further blocks as well: a pair at 0.8 that has come so far fails in that with a chance of 0.02 or less. ``exact``: there too it
    meets the whole group, part by part.
    """
    gained, asked = 1, 0
    while True:
        degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        known = large.join(roots, "node", "left").join(degrees, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        mixed = known.groupBy("key").agg(F.max(F.struct("links", "node", "root")).alias("top"), F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n")).where("r <> s")
        known = written(known.join(mixed.select("key", "top", "n"), "key"))
        if known.isEmpty():
            return roots
        if gained * FEW < asked:
            break
        pairs = known.where(F.col("root") != F.col("top.root")).select(F.col("node").alias("a"), F.col("top.node").alias("b"))
        new = written(_least_first(pairs).join(tested, ["a", "b"], "left_anti"))
        near = written(_close(new, texts, min_similarity, exact).select("a", "b"))
        found = _verified(near, sets, min_similarity)
        gained, asked = found.count(), new.count()
        if not gained:
            break
        tested = tested.unionByName(near)
        links, roots = links.unionByName(found), joined(roots, found)

    major = known.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"))
    members = known.join(major, "key").join(texts.drop("doc_id"), "node").withColumn("outside", F.col("root") != F.col("major"))
    held = ["key", "n", "node", "root", *MARKS, "outside"]
    if exact:
        near = written(_least_first(_meet(members.select(*held), min_similarity, exact)).join(tested, ["a", "b"], "left_anti"))
        return joined(roots, _verified(near, sets, min_similarity))
    # the block and those that follow it in its class, round its end
    blocks = F.when(F.array_contains("own", F.col("key")), F.col("own")).otherwise(F.col("next"))
    place = F.array_position(blocks, F.col("key"))
    steps = F.sequence(F.lit(1), F.least(F.lit(EXTENSIONS), F.size(blocks) - 1))
    others = F.transform(steps, lambda k: F.struct(k.alias("k"), F.element_at(blocks, (F.pmod(place - 1 + k, F.size(blocks)) + 1).cast("int")).alias("block")))
    wide = members.where(F.col("n") > PART).withColumn("x", F.explode(others)).where("x.block IS NOT NULL").withColumn("key", F.xxhash64("key", "x.k", "x.block"))
    sizes = wide.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s"), F.max("outside").alias("o")).where("r <> s AND o").select("key", "n")
    wide = wide.drop("n").join(sizes, "key").select(*held)
    pairs = _meet(members.where(F.col("n") <= PART).select(*held), min_similarity).unionByName(_meet(wide, min_similarity))
    near = written(_least_first(pairs).join(tested, ["a", "b"], "left_anti"))
    return joined(roots, _verified(near, sets, min_similarity))


def near_groups(docs: DataFrame, min_similarity: float = 0.8, words: int = 5, exact: bool = False) -> DataFrame:
    """doc_id and group: the smallest doc_id of the documents that near copies connect to it.

    ``exact``: blocks are those of ``_Keys``, as many in long texts as the pigeonhole principle asks for, and what is left of large block groups meets all of them,
    so every pair is compared that shares a block and doesn't differ beyond EXACT_FAR_BITS. Without it pairs in texts over about 280 words and in what is left of groups over PART meet with a
    chance of 0.98 or more, and the work stays linear in such groups.

    Near: a Jaccard similarity of ``min_similarity`` or more between the sets of ``words``-word shingles (case folded for
    A-Z). Equal word sequences, empty ones too, are one text. Rows without a doc_id are left out here.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = rows.select("doc_id", shingle_hashes(F.col("text"), words).alias("hashes")).withColumn("node", F.xxhash64("hashes", F.size("hashes")))
    # the similarity is of sets, so a repeated shingle votes once
    hashed = hashed.withColumn("hashes", F.array_distinct("hashes"))
    if exact:
        prints = written(map_arrow(hashed, _Marks(), "doc_id long, node long, fp array<long>, odd array<long>, size long", HASH_BYTES))
        texts = written(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in MARKS]))
        meets = _meets_exact(hashed.select("node", "hashes"), min_similarity)
    else:
        schema = "doc_id long, node long, fp array<long>, odd array<long>, size long, own array<long>, next array<long>"
        prints = written(map_arrow(hashed, _Blocks(min_similarity), schema))
        texts = written(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in (*MARKS, "own", "next")]))
        keyed = texts.select("node", F.explode(F.array_compact(F.concat("own", "next"))).alias("key"))
        shared = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
        meets = written(keyed.join(_few(shared), "key"))
    few = texts.select("node", "doc_id").join(meets.select("node").distinct(), "node", "left_semi").select(F.col("doc_id"), F.col("node").alias("own_node"))
    # a doc_id may name several texts: the set is that of the text itself
    own = lambda h: F.when(F.xxhash64(h, F.size(h)) == F.col("own_node"), F.array_distinct(h))
    sets = rows.join(_few(written(few)), "doc_id").select(F.col("own_node").alias("node"), F.element_at(F.transform(F.array(shingle_hashes(F.col("text"), words)), own), 1).alias("s"))
    sets = written(sets.where("s IS NOT NULL").groupBy("node").agg(F.first("s").alias("s")))

    small = meets.where(F.col("n") <= SMALL_GROUP)
    pairs = small.join(small.select("key", F.col("node").alias("b")), "key").where(F.col("node") < F.col("b")).select(F.col("node").alias("a"), "b")
    large = meets.where(F.col("n") > SMALL_GROUP)
    star = large.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    order = Window.partitionBy("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART))).orderBy("fp", "node")
    ordered = large.join(texts.select("node", "fp"), "node")
    for i in range(1, NEIGHBOURS + 1):
        ordered = ordered.withColumn(f"b{i}", F.lead("node", i).over(order))
    nexts = ordered.select(F.col("node").alias("a"), F.explode(F.array_compact(F.array(*[f"b{i}" for i in range(1, NEIGHBOURS + 1)]))).alias("b"))
    near = written(_close(_least_first(pairs.unionByName(star).unionByName(nexts)), texts, min_similarity, exact))
    # the nearest smaller text of each is checked first: what that joins needs no further check
    forest = written(near.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"))
    links = _verified(forest, sets, min_similarity)
    roots = written(components(links))
    more = _verified(_apart(near.select("a", "b").join(forest, ["a", "b"], "left_anti"), roots), sets, min_similarity)
    roots = _link_large(large.select("key", "node"), near.select("a", "b"), links.unionByName(more), joined(roots, more), texts, sets, min_similarity, exact)

    rooted = texts.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("doc_id").alias("group"))
    return prints.select("doc_id", "node").join(rooted.join(groups, "root").select("node", "group"), "node").select("doc_id", "group")


def drop_near_copies(docs: DataFrame, min_similarity: float = 0.8, words: int = 5, exact: bool = False) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id; of rows that repeat it, one.

    Documents without a doc_id stay: nothing names them. Columns as in ``docs``.
    """
    groups = near_groups(docs, min_similarity, words, exact)
    kept = groups.where(F.col("doc_id") == F.col("group")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    one = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    chosen = named.join(kept, "doc_id", "left_semi")
    if one.isEmpty():
        unique = chosen
    else:
        unique = chosen.dropDuplicates(["doc_id"])
    return unique.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
