"""Exact dedup: a tree-merge of sorted digest runs.

Every row of the table becomes one entry: a 64-bit xxhash of its normalised text, by which runs are sorted, the SHA-256 of that
text, which verifies that entries of one hash are copies, the row's id and number, and a count. Tasks cut their rows into runs
of at most ``RUN`` entries, each sorted, with copies already made one entry. Then runs are merged in binomial rounds: in a
round, ``FAN`` runs with neighbouring numbers meet, and each of them is cut by the next bits of the hash, so that a merge
takes one piece of each run and gives one run of a narrower range. While the number of runs falls by ``FAN``, the number of
ranges grows by it: a merge always holds about as many entries as one first run does, however large the table is, and a text
that fills a third of it is one entry of each run that it meets. In every merge, the entries of one hash are verified by their
SHA-256 before they become one, with the winning id and the summed count. After the last round the runs are the sorted
groups of the whole table.

Rows get their group by an equi-join; groups so large that they would burden one task are broadcast, and by their size there
are only so many of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_weight, map_arrow, unused, written

#: Entries of a first run; runs that meet in a merge.
RUN, FAN = 1 << 16, 8
ENTRY = np.dtype([("hash", "<u8"), ("sha", "<u8", (4,)), ("order", "<i8"), ("null", "u1"), ("row", "<i8"), ("n", "<i8")])
PIECE = "run long, range long, entries binary"


def digests(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, row, hash, sha of every row, in the shared folder. Fewer ``bits`` only so that tests can make hashes collide."""
    import xxhash

    mask = (1 << 64) - (1 << (64 - bits))

    def seal(batch) -> dict:
        texts = [(t or b"").lower() for t in batch.column("text").to_pylist()]  # of bytes, lower() changes A-Z alone
        hashes = np.array([xxhash.xxh64_intdigest(t) & mask for t in texts], "<u8").view("<i8")
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "hash": hashes, "sha": [hashlib.sha256(t).digest() for t in texts]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    return written(map_arrow(rows, seal, "doc_id long, row long, hash long, sha binary"))


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs to one: entries of one text become one, with the first id by ``order`` (then row) and the sum of the counts."""
    both = runs[0] if len(runs) == 1 else np.concatenate(runs)
    if not len(both):
        return both
    both = both[np.argsort(both["hash"], kind="stable")]  # runs that are in order are merged, not sorted anew
    sha = both["sha"]
    if ((both["hash"][1:] == both["hash"][:-1]) & (sha[1:] != sha[:-1]).any(1)).any():  # a hash that texts share
        both = both[np.lexsort((*sha.T, both["hash"]))]
        sha = both["sha"]
    starts = np.concatenate([[True], (both["hash"][1:] != both["hash"][:-1]) | (sha[1:] != sha[:-1]).any(1)])
    group, first = np.cumsum(starts), np.flatnonzero(starts)
    best = np.lexsort((both["row"], both["order"], both["null"], group))[first]
    out = both[best]
    out["n"] = np.add.reduceat(both["n"], first)
    return out


def _pieces(run: np.ndarray, number: int, cell: int, shift: int) -> list[tuple]:
    """``run`` cut into the ``FAN`` ranges of the next bits of its hashes."""
    part = (run["hash"] >> np.uint64(shift)).astype("i8") & (FAN - 1)
    ends = np.searchsorted(part, np.arange(FAN + 1))
    return [(number, cell * FAN + i, run[a:b].tobytes()) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]


def _batch(pieces: list[tuple]):
    import pyarrow as pa

    columns = zip(*pieces, strict=True) if pieces else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["run", "range", "entries"])


def _first_runs(least: bool, tasks: int, size: int):
    """Rows of a task to sorted runs of at most ``size`` entries, cut for the first round."""

    def made(batches: Iterator) -> Iterator:
        held, n, chunk = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                if n + some.num_rows > size:
                    yield _batch(_pieces(merge([_sorted(held)]), chunk * tasks + pid, 0, 61))
                    held, n, chunk = [], 0, chunk + 1
                pid = some.column("task")[0].as_py()
                held.append(_entries(some, least))
                n += some.num_rows
        if held:
            yield _batch(_pieces(merge([_sorted(held)]), chunk * tasks + pid, 0, 61))

    return made


def _sorted(held: list[np.ndarray]) -> np.ndarray:
    run = np.concatenate(held)
    return run[np.argsort(run["hash"], kind="stable")]


def _entries(batch, least: bool) -> np.ndarray:
    out = np.zeros(batch.num_rows, ENTRY)
    ids = batch.column("doc_id")
    out["hash"] = batch.column("hash").to_numpy().view("<u8")
    out["sha"] = np.frombuffer(b"".join(batch.column("sha").to_pylist()), "<u8").reshape(-1, 4)
    at = ids.fill_null(0).to_numpy()
    out["order"], out["null"] = at if least else ~at, ids.is_null().to_numpy(zero_copy_only=False)
    out["row"], out["n"] = batch.column("row").to_numpy(), 1
    return out


def _round(shift: int):
    """One merge: the pieces that lie in one range of ``FAN`` neighbouring runs."""

    def met(key, table):
        import pyarrow as pa

        run = merge([np.frombuffer(b, ENTRY) for b in table.column("entries").to_pylist()])
        return pa.Table.from_batches([_batch(_pieces(run, key[0].as_py(), key[1].as_py(), shift))])

    return met


def merged_groups(rows: DataFrame, least: bool = True, size: int = RUN) -> DataFrame:
    """``digests`` to groups of copies: hash, sha, keep_id, keep_row, n. ``least``: the smallest id of a group wins, else the largest."""
    rows = rows.withColumn("task", F.spark_partition_id())
    counted = rows.groupBy("task").agg(F.count("*").alias("n")).agg(F.max("task").alias("last"), F.max("n").alias("most")).first()
    tasks = (counted["last"] or 0) + 1
    # a batch never straddles two runs, so a run is at least half full
    left = tasks * (2 * -(-(counted["most"] or 1) // size))
    runs, shift = rows.mapInArrow(_first_runs(least, tasks, size), PIECE), 61
    while True:
        shift, left = max(0, shift - 3), -(-left // FAN)
        meets = runs.withColumn("run", F.floor(F.col("run") / FAN))
        runs = meets.groupBy("run", "range").applyInArrow(_round(shift), PIECE)
        if left <= 1:
            break

    def unpacked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for packed in batch.column("entries").to_pylist():
                e = np.frombuffer(packed, ENTRY)
                keep = e["order"] if least else ~e["order"]
                ids = pa.array(keep, pa.int64(), mask=e["null"] == 1)
                shas = pa.array([s.tobytes() for s in e["sha"]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(e["hash"].view("<i8")), shas, ids, pa.array(e["row"]), pa.array(e["n"])], names=["hash", "sha", "keep_id", "keep_row", "n"])

    return runs.mapInArrow(unpacked, "hash long, sha binary, keep_id long, keep_row long, n long")


def exact_copies(docs: DataFrame, keep: str = "smallest", bits: int = 64, size: int = RUN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the row with the ``keep`` ('smallest' or 'largest') doc_id stays.

    Texts are equal when identical after lower-casing A-Z. Null texts count as empty. Rows that repeat an id and a text: one of
    them stays. A null doc_id loses to any other; a group without ids keeps one row, and its keep_id is null. Other columns are
    ignored, whatever their names; no rows in, none out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    rows = digests(docs, bits)
    groups = written(merged_groups(rows, keep == "smallest", size).where("n > 1"))
    found = join_by_weight(rows, groups, ["hash", "sha"], "n", rows.count())
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha, ident = unused("__sha", docs.columns), unused("__id", docs.columns)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    stay = exact_copies(docs, keep).where("kept").select(F.col("text_sha256").alias(sha), key.alias(ident))
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = docs.withColumns({sha: F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), az, az.lower()), 256), ident: key})
    return rows.join(stay, [sha, ident], "left_semi").dropDuplicates([sha, ident]).drop(sha, ident)
