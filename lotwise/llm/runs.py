"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a stretch of words with smallest period q, of length 2q or more, that neither neighbour extends. By the runs theorem,
each run holds a Lyndon word of length q that is the longest one at its first word, in one of the two orders of the alphabet. So the
candidates are one word's position and the end of its longest Lyndon word, twice per position: the next position whose
suffix is smaller. Each candidate is extended to the right by the longest common extension of its two ends, and to the
left by that of the reversed text; what is long enough is a run.

Extensions come from Ukkonen trees of the text and of its reversal: the lowest common ancestor of two leaves is the least depth
between them in the Euler tour, found in constant time in a table of minima over powers of two. Only the tour's turning
points are kept (the lowest node between a leaf and the next), since the least of them is the least of the tour.

Most words of prose can't lie in a run, so the trees are built over stretches: every word of a run of at least ``LEAST`` words is
covered by a window of ``LEAST`` / 2 words that the run holds twice (its first and its last half hold only such windows).
Words that no repeated window covers are where the text is cut, again and again until nothing falls away. Windows are told apart by
a hash, and one that collides makes a stretch longer, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words of the shortest run.
LEAST = 12


def suffix_tree(s: list[int]) -> tuple[list[dict], list[int]]:
    """Ukkonen's tree of ``s``, whose last item occurs once: children by first item, and depths, of the inner nodes.

    Node 0 is the root; a leaf is the complement of its suffix's start. An edge isn't stored: a node knows its depth and the start of one
    suffix below it, so the item at depth d on the way to it is ``s[start + d]``.
    """
    kids, depth, below, link = [{}], [0], [0], [0]
    node = length = suffix = 0  # the active point is ``length`` items below ``node``, along s[i - length:i]
    for i, c in enumerate(s):
        open_ = 0  # the node that waits for its suffix link
        while suffix <= i:
            if length:
                side = s[i - length]
                child = kids[node][side]
                if child >= 0:
                    if length >= (span := depth[child] - depth[node]):
                        node, length = child, length - span
                        continue
                    start = below[child]
                else:
                    start = ~child
                at = depth[node] + length
                if s[start + at] == c:
                    if open_:
                        link[open_] = node
                    length += 1
                    break
                new = len(kids)
                kids.append({s[start + at]: child, c: ~suffix})
                depth.append(at)
                below.append(start)
                link.append(0)
                kids[node][side] = new
                if open_:
                    link[open_] = new
                open_ = new
            else:
                if open_:
                    link[open_] = node
                    open_ = 0
                if c in kids[node]:
                    length = 1
                    break
                kids[node][c] = ~suffix
            suffix += 1
            if node:
                node = link[node]
            elif length:
                length -= 1
    return kids, depth


def tour(kids: list[dict], depth: list[int], down: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Leaves left to right, and the depth of the turning point before each. ``down``: larger items first, after the closing 0."""
    leaves, turns, stack = [], [], [(0, 0)]
    while stack:
        node, turn = stack.pop()
        if node < 0:
            leaves.append(~node)
            turns.append(turn)
            continue
        some = kids[node]
        order = sorted(some, reverse=not down)  # the stack gives back the last one first
        if down and order[0] == 0:
            order.append(order.pop(0))
        own = depth[node]
        stack.extend([(some[c], own) for c in order])
        stack[-1] = (stack[-1][0], turn)
    return np.array(leaves), np.array(turns, "i4")


class Extensions:
    """Longest common extensions of the suffixes of a text."""

    def __init__(self, s: list[int], lyndon: bool = False):
        kids, depth = suffix_tree(s)
        leaves, turns = tour(kids, depth)
        self.rank = _inverse(leaves)
        self.other = _inverse(tour(kids, depth, down=True)[0]) if lyndon else None
        self.least = [turns]
        while (step := 1 << (len(self.least) - 1)) * 2 <= len(turns):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the suffixes at ``a`` and at ``b``, which differ."""
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(y - x + 1)[1] - 1
        out = np.empty(len(x), "i8")
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][x[at]], self.least[k][y[at] - (1 << int(k)) + 1])
        return out


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank: where the longest Lyndon word of each place ends. The closing item is the smallest."""
    ranks, out, stack = rank.tolist(), [0] * (len(rank) - 1), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, "i8")


def maximal_runs(items: list[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of ``items`` (numbers above 0) with ``least`` items or more, by start and period."""
    n = len(items)
    if n < max(2, least):
        return np.empty((0, 3), "i8")
    ahead, back = Extensions([*items, 0], lyndon=True), Extensions([*items[::-1], 0])
    first, found = np.arange(n), []
    for rank in (ahead.rank, ahead.other):
        end = _next_smaller(rank)
        period = end - first
        left = back(n - first, n - end)  # up to the words before the two ends; before the first word is the closing item
        start, stop = first - left, end + ahead(first, end)
        good = stop - start >= np.maximum(least, 2 * period)
        found.append(np.stack([start, stop - start, period], 1)[good])
    return np.unique(np.concatenate(found), axis=0)


def stretches(items: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of ``items`` outside of which no run of ``least`` items or more has any item."""
    size = least // 2
    mixed = items.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    if len(items) < least:
        return []
    prints = np.zeros(len(items) - size + 1, "u8")
    for j in range(size):
        prints = prints * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + len(prints)]
    todo, out = [(0, len(items))], []
    while todo:
        a, b = todo.pop()
        own = prints[a : b - size + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        twice = np.zeros(len(own), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cover = np.zeros(b - a + 1, "i4")
        starts = np.flatnonzero(twice)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + size, -1)
        held = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(held[1:] != held[:-1]).reshape(-1, 2) + a
        for x, y in edges.tolist():
            if y - x == b - a:
                out.append((x, y))
            elif y - x >= least:
                todo.append((x, y))
    return sorted(out)


def text_runs(words: list[bytes], least: int = LEAST) -> np.ndarray:
    """The runs of a text's words: (start, length, period), by start and period."""
    if len(words) < least:
        return np.empty((0, 3), "i8")
    number: dict[bytes, int] = {}
    items = np.fromiter(map(number.setdefault, words, count(1)), "i8", len(words))
    found = [maximal_runs(items[a:b].tolist(), least) + (a, 0, 0) for a, b in stretches(items, least)]
    return np.concatenate(found) if found else np.empty((0, 3), "i8")


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, "i8")
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period) and text: the kept words, joined by one blank.

    Words are what blanks and the controls 9 to 13 part. ``prepare`` may change a document's words (of doc_id and words) before. Null
    and empty texts have no runs and an empty text; rows with a null or repeated doc_id are each a document; other
    columns are ignored, whatever their names; no rows in, none out. Each document is read by one task, whose memory follows the
    longest stretch of repeated windows (about 700 bytes a word), not the table.
    """

    def scan(batch) -> dict:
        out = {"doc_id": batch.column("doc_id"), "runs": [], "text": []}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = (text or b"").split()  # of bytes: at blanks and the controls 9 to 13, nothing else
            if prepare:
                words = prepare(doc_id, words)
            runs = text_runs(words, least)
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
            out["text"].append(b" ".join(collapsed(words, runs)).decode())
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_arrow(rows, scan, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def run_digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as digests: doc_id, n_runs, the longest run (ties: smallest start, then period) and two SHA-256."""
    best = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.sign(b["length"] - a["length"])).when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(F.sign(a["period"] - b["period"])).cast("int"))
    rows = found.withColumn("best", F.get(best, F.lit(0)))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
