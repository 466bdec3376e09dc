"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks.

Rows are integer vectors; a vector's nonzero components are its terms. The stated query set meets all candidates in a grid of
bounded cells: candidates are dealt into blocks by the hash of their id, queries likewise, and a cell holds one block of each.
In a cell every term scatters its postings, weighted for each query row that has it, into dense arrays of scores; a partition
selection keeps the k best, and a grouped top-k merges the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates and of queries, about: what a task holds.
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 65_536
#: Scores are accumulated for so many queries and candidates at a time, so that they stay in a core's cache.
QUERY_TILE, CANDIDATE_TILE = 64, 4_096


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component, x as a double; null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(finite, F.lit(False)), F.transform(x, lambda v: F.floor(v * factor).cast("long")))


def _cell(k: int):
    def best(candidates, queries):
        import numpy as np
        import pandas as pd

        out = [(np.zeros(0, "int64"),) * 3]
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids, own = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            width = max(map(len, (*candidates["v"], *queries["v"])), default=0)
            a, b = _matrix(candidates["v"], width), _matrix(queries["v"], width)
            # the greatest score that these vectors can have tells how wide an integer must be
            narrow = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width) < 2**31 - 1
            a, b = (x.astype("int32" if narrow else "int64") for x in (a, b))
            tiles = [(ids[at : at + CANDIDATE_TILE], _postings(a[at : at + CANDIDATE_TILE])) for at in range(0, len(ids), CANDIDATE_TILE)]
            out += [_answer(b[at : at + QUERY_TILE], own[at : at + QUERY_TILE], tiles, k) for at in range(0, len(b), QUERY_TILE)]
        return pd.DataFrame({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return best


def _matrix(rows, width: int):
    import numpy as np

    m = np.zeros((len(rows), width), "int64")
    for i, v in enumerate(rows):
        m[i, : len(v)] = v
    return m


def _postings(rows) -> list:
    """For each term the rows that have it and their weights; a term that most rows have is kept as a whole column (None for the rows)."""
    import numpy as np

    places = [np.flatnonzero(rows[:, t]) for t in range(rows.shape[1])]
    return [(None, np.ascontiguousarray(rows[:, t])) if 2 * len(where) > len(rows) else (where, rows[where, t]) for t, where in enumerate(places)]


def _answer(queries, own, tiles, k: int) -> tuple:
    """(query_id, vec_id, score) of the k best of each query over all tiles, ties to the smaller id."""
    import numpy as np

    none = np.iinfo(queries.dtype).min
    rows, names, values = [], [], []
    for ids, postings in tiles:
        scores = np.zeros((len(queries), len(ids)), queries.dtype)
        for t, (where, weights) in enumerate(postings):
            said = np.flatnonzero(queries[:, t])
            if not len(weights) or not len(said):
                continue
            # a term's weighted postings for all queries that have it
            if where is not None:
                scores[np.ix_(said, where)] += np.multiply.outer(queries[said, t], weights)
            elif 2 * len(said) > len(queries):
                scores += np.multiply.outer(queries[:, t], weights)
            else:
                scores[said] += np.multiply.outer(queries[said, t], weights)
        first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(first < last):
            scores[i, first[i] : last[i]] = none
        least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), none)
        i, j = np.nonzero((scores >= least[:, None]) & (scores > none))  # with every tie
        rows.append(i)
        names.append(ids[j])
        values.append(scores[i, j].astype("int64"))
    rows, names, values = (np.concatenate(x) for x in (rows, names, values))
    order = np.lexsort((names, -values, rows))
    rows, names, values = rows[order], names[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < k
    return own[rows[kept]], names[kept], values[kept]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of the highest inner product for each query row.

    ``vectors``: vec_id and an array of integers ``v``; rows with a null in either take no part. Rows of a query's own id are
    no candidates for it; ties go to the smaller id; with fewer candidates all are returned. Rows that repeat an id are each a
    candidate, and as queries they are answered together: the best of all their pairs. Shorter vectors count as filled up with
    zeros. Scores are exact below 2**63.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("q"))
    # of rows that are alike k can be among the best, so a mass of copies is k rows
    rows = rows.groupBy("vec_id", "v", "q").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), "n")))
    n, queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    across, down = max(1, -(-n // candidate_block)), max(1, -(-queries // query_block))
    block = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v", "n"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("vec_id", "v", block(across, "c").alias("x"), every(down).alias("y"))
    right = rows.where("q").select("vec_id", "v", block(down, "q").alias("y"), every(across).alias("x"))
    cells = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
