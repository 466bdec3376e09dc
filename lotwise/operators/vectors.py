"""Dense vectors: norms, exact nearest neighbours in blocks, centroids, k-means, topic subtraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import model

#: Rows in a block of the corpus and of the queries.
CORPUS_BLOCK, QUERY_BLOCK = 20_000, 20_000
#: Scores that a task holds at a time: of so many queries and rows.
ASKED_TILE, TILE = 128, 4_096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Of length one; the zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def truncate(v: Column, dims: int) -> Column:
    return unit(F.slice(v, 1, dims))


def _cell(k: int, earlier: bool):
    """The ``k`` best rows of a block for each query of a block."""

    def cell(c, q):
        import numpy as np

        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        scale = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        a, b = scale(np.stack(c["v"]).astype("float64")), scale(np.stack(q["v"]).astype("float64"))
        ids, own, out = c["id"].to_numpy(), q["query_id"].to_numpy(), []
        for at in range(0, len(b), ASKED_TILE):
            asked, tops = own[at : at + ASKED_TILE], []
            for start in range(0, len(a), TILE):
                some = ids[start : start + TILE]
                s = b[at : at + ASKED_TILE] @ a[start : start + TILE].T
                np.round(s, 9, out=s)
                s[(some >= asked[:, None]) if earlier else (some == asked[:, None])] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if len(some) > k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # with every tie
                tops.append(first(i, some[j], s[i, j]))
            i, j, s = first(*(np.concatenate(x) for x in zip(*tops, strict=True)))
            out.append(pd.DataFrame({"query_id": asked[i], "id": j, "score": (s + 1) / 2}))
        return pd.concat(out)

    def first(i, j, s):
        """The ``k`` best of each query: ties to the smaller id."""
        import numpy as np

        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[best], j[best], s[best]

    return cell


_NEAR = "query_id long, id long, score double"


def _first(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int, corpus_block: int = CORPUS_BLOCK, query_block: int = QUERY_BLOCK, earlier: bool = False) -> DataFrame:
    """query_id, id, score = (cosine + 1) / 2, rank of the ``k`` nearest rows by matrix products over a grid of blocks.

    queries: query_id, v; corpus: id, v. A query's own id is left out; with ``earlier`` all ids but
    smaller ones are. Ties to the smaller id.
    """
    n, m = corpus.count(), queries.count()
    across, down = max(1, -(-n // corpus_block)), max(1, -(-m // query_block))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = corpus.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int").alias("x"), every(down).alias("y"))
    right = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("y"), every(across).alias("x"))
    return _first(left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(_cell(k, earlier), _NEAR), k)


#: Pivots at most; cells that each query looks into first.
PIVOTS, FIRST_CELLS = 256, 2
#: Rounding of distances, on the safe side.
_SLACK = 1e-6


def _distances(vectors, matrix):
    """Of vectors (scaled to length one) to each pivot, and which have no length."""
    import numpy as np

    a = np.stack(vectors).astype("float64") if len(vectors) else np.zeros((0, matrix.shape[1]))
    size = np.linalg.norm(a, axis=1)
    a = a / np.maximum(size, 1e-300)[:, None]
    return np.sqrt(np.maximum(2 - 2 * a @ matrix.T, 0)), size == 0


class Pivots:
    """Exact nearest neighbours by cells about pivots.

    Vectors are scaled to length one, where the cosine follows from the distance, and each lies in the cell of its nearest pivot. A query looks into the cells nearest to it first;
    its k-th score there says how far a better row can be. By the triangle inequality a cell can't hold one if its pivot is farther from the query than that distance
    and the cell's radius together, or nearer than its inner radius less it. So the answer is that of the full grid. Pivots and radii are a bounded model; cells
    are compared in blocks of bounded size. Vectors of length zero lie in a cell that is always looked into.
    """

    def __init__(self, corpus: DataFrame, pivots: int | None = None, block: int = CORPUS_BLOCK):
        """corpus: id, v."""
        import numpy as np

        from lotwise.sources.sinks import stored

        n = corpus.count()
        wanted = max(1, min(PIVOTS, int(n**0.5))) if pivots is None else pivots
        some = corpus.where(norm(F.col("v")) > 0).orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        matrix = np.array([r["v"] for r in some], "float64").reshape(len(some), len(some[0]["v"]) if some else 0)
        self.matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        self.corpus = stored(corpus.select("id", "v", self._nearest()(F.col("v")).alias("c")).select("id", "v", "c.cell", "c.far"), "cells")
        rows = self.corpus.groupBy("cell").agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.count("*").alias("n")).collect()
        self.cells = {r["cell"]: (r["inner"], r["outer"], r["n"], max(1, -(-r["n"] // block))) for r in rows}

    def _nearest(self):
        matrix = self.matrix

        @F.pandas_udf("cell int, far double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            import numpy as np

            if not len(matrix):
                return pd.DataFrame({"cell": np.full(len(v), -1), "far": np.zeros(len(v))})
            d, none = _distances(v, matrix)
            cell = d.argmin(axis=1)
            return pd.DataFrame({"cell": np.where(none, -1, cell), "far": np.where(none, 0.0, d[np.arange(len(d)), cell])})

        return nearest

    def _routes(self, k: int, first: int):
        """Of each query the cells to look into first (as many as hold more than ``k`` rows, ``first`` at least), and of each other one how near a row of it can be."""
        import numpy as np

        names = np.array(sorted(c for c in self.cells if c >= 0), "int64")
        inner, outer, size = (np.array([self.cells[c][i] for c in names.tolist()], "float64") for i in range(3))
        always, matrix = [-1] if -1 in self.cells else [], self.matrix

        @F.pandas_udf("start array<int>, rest array<struct<cell:int,least:double>>")
        def routes(v: pd.Series) -> pd.DataFrame:
            start, rest = [], []
            d, none = _distances(v, matrix) if len(names) else (np.zeros((len(v), 0)), np.zeros(len(v), "bool"))
            for row, zero in zip(d[:, names] if len(names) else d, none, strict=True):
                order = np.argsort(row, kind="stable")
                enough = len(order) if zero else min(len(order), max(first, int(np.searchsorted(np.cumsum(size[order]), k, "right")) + 1))
                start.append([*always, *names[order[:enough]].tolist()])
                least = np.maximum(np.maximum(row - outer, inner - row), 0)
                rest.append([{"cell": int(names[i]), "least": float(least[i])} for i in order[enough:]])
            return pd.DataFrame({"start": start, "rest": rest})

        return routes

    def _look(self, routed: DataFrame, k: int, earlier: bool) -> DataFrame:
        """The best rows of (query_id, v, cell): cells' blocks with blocks of the queries that look into them."""
        blocks = F.create_map(*[F.lit(x) for c, (_, _, _, n) in self.cells.items() for x in (c, n)])
        m = routed.groupBy("cell").agg(F.count("*").alias("m")).withColumn("down", F.ceil(F.col("m") / QUERY_BLOCK).cast("int")).select("cell", "down")
        m = F.broadcast(m)  # a row for each cell
        every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
        left = self.corpus.join(m, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), blocks[F.col("cell")]).cast("int").alias("x"), every(F.col("down")).alias("y"))
        right = routed.join(m, "cell").select("query_id", "v", "cell", every(blocks[F.col("cell")]).alias("x"), F.pmod(F.xxhash64("query_id"), F.col("down")).cast("int").alias("y"))
        return left.groupBy("cell", "x", "y").cogroup(right.groupBy("cell", "x", "y")).applyInPandas(_cell(k, earlier), _NEAR)

    def search(self, queries: DataFrame, k: int, earlier: bool = False, first: int = FIRST_CELLS) -> tuple[DataFrame, DataFrame]:
        """As ``knn`` of queries (query_id, v); and query_id, looked, cells: how many cells each looked into, of all."""
        from lotwise.sources.sinks import stored

        if not self.cells:
            return knn(queries, self.corpus.select("id", "v"), k, earlier=earlier), queries.select("query_id", F.lit(0).alias("looked"), F.lit(0).alias("cells"))
        routed = stored(queries.select("query_id", "v", self._routes(k, first)(F.col("v")).alias("r")).select("query_id", "v", "r.start", "r.rest"), "routes")
        found = stored(_first(self._look(routed.select("query_id", "v", F.explode("start").alias("cell")), k, earlier), k).drop("rank"), "near")
        # a k-th score of s is a cosine of 2 s - 1, a distance of 2 (1 - s)**0.5; with fewer rows than k anything is near enough
        reach = found.groupBy("query_id").agg(F.when(F.count("*") >= k, 2 * F.sqrt(F.greatest(1 - F.min("score"), F.lit(0.0)) + _SLACK)).alias("reach"))
        left = routed.join(reach, "query_id", "left").withColumn("more", F.filter("rest", lambda c: F.col("reach").isNull() | (c["least"] <= F.col("reach") + _SLACK)))
        left = stored(left.select("query_id", "v", F.transform("more", lambda c: c["cell"]).alias("more"), F.size("start").alias("n")), "routes")
        also = self._look(left.select("query_id", "v", F.explode("more").alias("cell")), k, earlier)
        looked = left.select("query_id", (F.col("n") + F.size("more")).alias("looked"), F.lit(len(self.cells)).alias("cells"))
        return _first(found.unionByName(also), k), looked


def centroids(vectors: DataFrame, label: str, v: str) -> DataFrame:
    """The mean of each label's vectors, of length one."""
    cells = vectors.select(label, F.posexplode(v).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return rows.select(label, unit(F.col("c")).alias("centroid"))


def best_centroids(vectors: DataFrame, cents: DataFrame, label: str, v: str, keep: int, least: float = -2.0, own: str | None = None) -> DataFrame:
    """``vectors`` with ``near``: up to ``keep`` structs (label, score) of the best cosines, the best first, ties by label. With ``own`` centroids of a row's own
    label are left out, and scores up to ``least``. A vector of length zero or NULL is alike to all by 0.

    The centroids are a model of bounded size, which travels with the tasks as one matrix. A batch of vectors is multiplied with it in place: no row for
    each vector and centroid, and nothing is shuffled.
    """
    import numpy as np

    kind = dict(cents.dtypes)[label]
    rows = model(cents.select(F.col(label).alias("l"), F.col("centroid").alias("c"))).orderBy("l").collect()
    named = [r["l"] for r in rows]
    matrix = np.array([r["c"] for r in rows], "float64").reshape(len(rows), len(rows[0]["c"]) if rows else 0)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf(f"array<struct<label:{kind},score:double>>")
    def near(rows: pd.Series, mine: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(rows))]
        if named and len(rows):
            a = np.array([np.zeros(matrix.shape[1]) if x is None else x for x in rows], "float64")
            a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
            labels, owned, some = np.array(named, "object"), mine.to_numpy(), min(keep, len(named))
            for at in range(0, len(a), 512):
                s = np.round(a[at : at + 512] @ matrix.T, 9) + 0.0
                s[(owned[at : at + 512, None] == labels[None, :]) | (s <= least)] = -np.inf
                edge = np.partition(s, -some, axis=1)[:, -some]
                for i, (r, e) in enumerate(zip(s, edge, strict=True), at):
                    j = np.flatnonzero((r >= e) & (r > -np.inf))  # with every tie, in the order of labels
                    out[i] = [{"label": named[x], "score": float(r[x])} for x in j[np.argsort(-r[j], kind="stable")][:keep]]
        return pd.Series(out, dtype="object")

    return vectors.withColumn("near", near(F.col(v), F.col(own) if own else F.lit(None).cast(kind)))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, label: str, v: str, id_col: str, floor: float = 0.0, margin: float = 0.0) -> DataFrame:
    """The label of the best cosine where it and its lead are high enough, else NULL. Centroids are as few as labels."""
    best = best_centroids(vectors.select(id_col, v), cents, label, v, 2)
    top, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    sure = (top["score"] >= floor) & (F.coalesce(top["score"] - second["score"], F.lit(1.0)) >= margin)
    return best.select(id_col, F.when(sure, top["label"]).alias("label"), top["score"].alias("score"))


def kmeans(vectors: DataFrame, v: str, k: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """Spherical k-means by MLlib; adds ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector(unit(F.col(v))))
    fitted = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine", predictionCol="cluster").fit(rows.where(norm(F.col(v)) > 0))
    return fitted.transform(rows).drop("features")


def subtract_topics(v: Column, topics: list[Column], alpha: float) -> Column:
    """unit(v - alpha * the sum of topics)."""
    out = v
    for t in topics:
        out = F.zip_with(out, t, lambda x, y: x.cast("double") - alpha * y.cast("double"))
    return unit(out)
