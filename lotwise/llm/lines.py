"""Line dedup by a log-template tree of fixed depth.

A line falls down the tree by its token count, then by its leading token, then to the leaves that its anchors name: the thirds of
a line (every other token of a short one). Tokens with digits are variable fields from the start. Lines of a leaf are compared
with the leaf's templates token by token, in order of their first document: a line joins the template that it agrees with best, if
that leaves enough constant tokens, and the tokens that differ become variable fields; else it starts a template. Lines with
hardly any constant token have their exact text as their template. A template that lines of two documents or more have recurs; its
lines stay in the first of these documents (by doc_id) and are dropped in the others.

Texts are read once, in one narrow pass, which keeps each line's leaves and one byte for each of its tokens. What leaves that two
documents share hold is counted before it is shuffled; a leaf is merged in salted parts first, whose templates are then merged, and
a task holds the templates of one part of a leaf at a time. Which lines go is joined to the documents by row and line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_key, unused, written

#: Shorter lines, and lines with fewer constant tokens, have no fields: their template is their exact text. A single token has
#: no template.
MIN_TOKENS, MIN_CONSTANT = 5, 4
#: Share of a line's tokens that a template keeps. Constant tokens that an anchor has, at least.
AGREEMENT, ANCHORED = 0.65, 2
#: From so many tokens on, anchors are thirds.
THIRDS = 9
#: Parts in which a leaf is merged first.
SALTS = 16
#: Leaves that documents share are broadcast up to this number (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000

#: Bytes of a variable field: one that was masked, and one that merging made. Others are 1 to 254, by the token.
MASKED, MERGED = 0, 255
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20
_FIELD, _STEP, _PLACE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x):
    """A bijection of 64 bits (arrays of uint64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tokens_of(lines: list[str]) -> tuple:
    """Of each token of all lines: a hash of its UTF-8 bytes b0, b1, ... (the mix of the sum of (b + 1) * STEP**k), whether it has a
    digit, its line and its place there. All tokens at once."""
    import numpy as np

    data = np.frombuffer("\n".join(" ".join(line.split()) for line in lines).encode(), "uint8")
    gap = (data == 32) | (data == 10)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]]) if len(data) else np.zeros(0, "int64")
    if not len(starts):
        return (np.zeros(0, "uint64"), np.zeros(0, "bool"), starts, starts)
    sizes = np.diff(np.r_[starts, len(data)])
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), _STEP, "uint64")], dtype="uint64")
    worth = np.where(gap[starts[0] :], np.uint64(0), (data[starts[0] :].astype("uint64") + np.uint64(1)) * powers[place])
    at = starts - starts[0]
    hashes = _mix(np.add.reduceat(worth, at))
    digit = np.add.reduceat(((data >= 48) & (data <= 57))[starts[0] :], at, dtype="int64") > 0
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    index = np.arange(len(starts)) - np.searchsorted(line, line)
    return hashes, digit, line, index


def leaves(lines: list[str]) -> tuple[list[int], list[list[int]], list[bytes]]:
    """Of each line that has a template: its number, its leaves, and its tokens as bytes (none for a template of exact text)."""
    import numpy as np

    if not lines:
        return [], [], []
    hashes, digit, line, index = tokens_of(lines)
    n = np.bincount(line, minlength=len(lines))
    begin = np.cumsum(n) - n
    constant = n - np.bincount(line, weights=digit, minlength=len(lines)).astype("int64")
    fields = (n >= MIN_TOKENS) & (constant >= MIN_CONSTANT)
    plain = (n >= 2) & ~fields
    size = n[line]
    own = fields[line]
    shown = np.where(digit & own, np.uint64(_FIELD), hashes)
    placed = _mix(shown ^ ((index.astype("uint64") + np.uint64(1)) * np.uint64(_PLACE)))
    part = np.where(size >= THIRDS, (index >= size // 3).astype("int64") + (index >= 2 * size // 3), index % 2)
    sums, told = np.zeros(3 * len(lines), "uint64"), np.bincount(3 * line + part, weights=~digit, minlength=3 * len(lines))
    np.add.at(sums, 3 * line + part, placed)
    sums = sums.reshape(-1, 3)
    lead = np.zeros(len(lines), "uint64")
    lead[n > 0] = shown[begin[n > 0]]
    top = _mix(lead ^ _mix(n.astype("uint64")))
    found = _mix(sums + np.arange(1, 4, dtype="uint64") * np.uint64(_STEP)) ^ top[:, None]
    anchored = (told.reshape(-1, 3) >= ANCHORED) & fields[:, None]
    whole = _mix(sums.sum(axis=1) + np.where(fields, np.uint64(7), np.uint64(11))) ^ top
    alone = plain | fields & ~anchored.any(axis=1)
    rows, cols = np.nonzero(np.c_[anchored, alone])
    leaf = np.c_[found, whole][rows, cols]
    sig = np.where(digit, MASKED, (hashes >> np.uint64(40)) % np.uint64(254) + np.uint64(1)).astype("uint8").tobytes()
    ends, from_ = (begin + n).tolist(), begin.tolist()
    told = [sig[from_[i] : ends[i]] if f else b"" for i, f in enumerate(fields.tolist())]
    known, at = np.unique(rows, return_index=True)
    leaf, at = leaf.view("int64").tolist(), [*at.tolist(), len(rows)]
    known = known.tolist()
    return known, [leaf[a:b] for a, b in zip(at, at[1:], strict=False)], [told[i] for i in known]


def _tell(batch) -> dict:
    """Line numbers, leaves and bytes of each text's lines, in slices of bounded size."""
    import numpy as np

    out = {"text": [], "line": [], "leaves": [], "sig": []}
    lines, owner, number, size = [], [], [], 0

    def flush() -> None:
        rows, leaf, sig = leaves(lines)
        out["text"].extend([owner[i] for i in rows])
        out["line"].extend([number[i] for i in rows])
        out["leaves"].extend(leaf)
        out["sig"].extend(sig)

    for k, text in enumerate(batch.column("text").to_pylist()):
        if text:
            said = text.split("\n")
            lines += said
            owner += [k] * len(said)
            number += range(len(said))
            size += len(text)
        if size > SLICE:
            flush()
            lines, owner, number, size = [], [], [], 0
    flush()
    rows = np.array(out.pop("text"), "int64")
    return out | {"doc": batch.column("doc").take(rows), "row": batch.column("row").take(rows)}


def _shared(told: DataFrame) -> DataFrame:
    """Rows (with ``leaf``) of the leaves that two documents or more fall to."""
    told = told.select("doc", "row", "line", "sig", F.explode("leaves").alias("leaf"))
    ends = told.groupBy("leaf").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    both = written(ends.where("first <> last").select("leaf"))
    return written(told.join(F.broadcast(both) if both.count() <= BROADCAST_LEAVES else both, "leaf", "left_semi"))


class _Leaf:
    """Templates of one leaf: the form of each, its first document and its first line."""

    def __init__(self, size: int):
        import numpy as np

        self.forms, self.first, self.leader = np.zeros((4, size), "uint8"), [], []

    def add(self, sig: bytes, first: int) -> int:
        """The place of the template that a line (or template) joins or starts."""
        import numpy as np

        own, n = np.frombuffer(sig, "uint8"), len(self.first)
        if n:
            same = (self.forms[:n] == own) & (own != MERGED)
            kept = same.sum(axis=1)
            fine = (kept >= AGREEMENT * len(own) - 1e-9) & ((same & (own != MASKED)).sum(axis=1) >= MIN_CONSTANT)
            if fine.any():
                at = int(np.argmax(np.where(fine, kept, -1)))
                self.forms[at][~same[at]] = MERGED
                return at
        if n == len(self.forms):
            self.forms = np.vstack([self.forms, np.zeros_like(self.forms)])
        self.forms[n] = own
        self.first.append(first)
        self.leader.append(sig)
        return n


_MERGED = "leaf long, part long, sig binary, leader binary, first long, form binary"


def _merge(frames):
    """Streams lines, sorted by leaf, part, first document and bytes: for each its template's first line and document; at the end
    of a part of a leaf, for each template its form (null for lines)."""
    import pandas as pd

    own, at = None, None
    names = ["leaf", "part", "sig", "leader", "first", "form"]

    def forms() -> list:
        return [(*at, None, own.leader[k], own.first[k], own.forms[k].tobytes()) for k in range(len(own.first))] if own else []

    for pdf in frames:
        rows = []
        for leaf, part, first, sig in zip(pdf["leaf"].tolist(), pdf["part"].tolist(), pdf["first"].tolist(), pdf["sig"], strict=True):
            if (leaf, part) != at:
                rows += forms()
                own, at = _Leaf(len(sig)), (leaf, part)
            k = own.add(sig, first)
            rows.append((leaf, part, sig, own.leader[k], own.first[k], None))
        yield pd.DataFrame(rows, columns=names)
    yield pd.DataFrame(forms(), columns=names)


def templates(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lines (leaf, sig, doc) of leaves that documents share: (leaf, sig, first), the first document of each line's template,
    and (leaf, form, first), the templates with a byte for each token, 0 and 255 for variable fields."""
    lines = told.groupBy("leaf", "sig").agg(F.min("doc").alias("first"))
    exact = lines.where(F.length("sig") == 0)
    parts = lines.where(F.length("sig") > 0).withColumn("part", F.pmod(F.xxhash64("sig"), F.lit(SALTS)))
    ordered = lambda df: df.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "first", "sig")
    one = written(ordered(parts).mapInPandas(_merge, _MERGED))
    heads = one.where("form IS NOT NULL").select("leaf", F.lit(0).cast("long").alias("part"), F.col("form").alias("sig"), "first", F.col("leader").alias("head"))
    two = written(ordered(heads).select("leaf", "part", "sig", "first").mapInPandas(_merge, _MERGED))
    # a part's template by its form: forms that are equal join the same template
    joined = two.where("form IS NULL").groupBy("leaf", "sig").agg(F.min("first").alias("first"))
    of_part = heads.select("leaf", "head", "sig").join(joined, ["leaf", "sig"]).groupBy("leaf", "head").agg(F.min("first").alias("first"))
    members = one.where("form IS NULL").select("leaf", "sig", F.col("leader").alias("head")).join(of_part, ["leaf", "head"]).select("leaf", "sig", "first")
    forms = two.where("form IS NOT NULL").select("leaf", "form", "first")
    return members.unionByName(exact.select("leaf", "sig", "first")), forms


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with ``text`` freed of recurring lines, and n_lines, n_dropped.

    Lines end at ``\\n`` alone. Null and empty texts have no lines and stay as they are; a text of which every line goes
    becomes empty. Rows with one doc_id count as one document, as do all rows without; the latter come last. No rows in,
    none out. Columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    key = row_key(F.col("doc_id"), F.col("text"))
    told = map_arrow(docs.select(order.alias("doc"), key.alias("row"), "text"), _tell, "doc long, row struct<a:long,b:long>, line int, leaves array<long>, sig binary")
    told = _shared(written(told))
    first, _ = templates(told)
    gone = told.join(first, ["leaf", "sig"]).where(F.col("first") != F.col("doc")).groupBy("row").agg(F.collect_set("line").alias("gone"))
    at, own, lines = (unused(x, docs.columns) for x in ("row", "gone", "lines"))
    none = F.array().cast("array<int>")
    rows = docs.withColumn(at, key).join(gone.select(F.col("row").alias(at), F.col("gone").alias(own)).hint("shuffle_hash"), at, "left")
    rows = rows.withColumn(own, F.coalesce(own, none)).withColumn(lines, F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)))
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(own, i)), "\n")
    rows = rows.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.size(own).cast("long"))
    return rows.withColumn("text", F.when(F.col("n_dropped") > 0, kept).otherwise(F.col("text"))).select(*docs.columns, "n_lines", "n_dropped")
