"""Searches by words, hashed words and character n-grams in one pass over the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.sources.sinks import stored

from . import text as t

#: Queries that travel to the texts; more are compared in a grid of blocks. Cells of a tile of documents.
ASKED, TILE_CELLS = 1_500, 1_000_000
#: Buckets of words, hashed words and grams.
SIZES = {"words": 1 << 16, "dense": 256, "grams": 1 << 14}
#: Stands for a key that is NULL, which comes last.
_NONE = (1 << 63) - 1


class _Best:
    """The ``k`` best documents of each query so far; ties (to 9 places) to the smaller key."""

    def __init__(self, queries: int, k: int):
        import numpy as np

        self.queries, self.k, self.least = queries, k, np.full(queries, -np.inf)
        self.held, self.n = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))], 0

    def add(self, ids, scores) -> None:
        """scores: a row for each document, a column for each query; 0 where no bucket is shared."""
        import numpy as np

        i, j = np.nonzero((scores > 0) & (np.round(scores, 9) >= self.least))
        self.held.append((j, ids[i], scores[i, j]))
        self.n += len(i)
        if self.n > 2 * self.queries * self.k + 100_000:
            self.cut()

    def cut(self):
        import numpy as np

        q, doc, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        rounded = np.round(score, 9)
        order = np.lexsort((doc, -rounded, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[place == self.k - 1]
        self.least[q[last]] = rounded[last]
        keep = order[place < self.k]
        self.held, self.n = [(q[keep], doc[keep], score[keep])], len(keep)
        return self.held[0]


def _lengths(batches):
    """Words of each text that has any."""
    import pyarrow as pa

    for some in t._slices(batches, t.GRAM_BYTES):
        dl = t.Taken(some.column("__text")).dl
        yield pa.RecordBatch.from_arrays([pa.array(dl[(dl > 0) & some.column("doc_id").is_valid().to_numpy(zero_copy_only=False)])], ["dl"])


def _matrices(asked, queries: int) -> dict:
    """For each leg the column of each bucket that a query names (-1: none does), and the queries' weights, a row for each column."""
    import numpy as np

    out = {}
    for leg, size in SIZES.items():
        q, bucket, weight = asked[leg]
        names = np.unique(bucket)
        column = np.full(size, -1, "int32")
        column[names] = np.arange(len(names))
        m = np.zeros((len(names), queries))
        m[column[bucket], q] = weight
        out[leg] = column, m
    return out


def _search(asked, ids: list[int], k: int, mean: float, k1: float = 1.2, b: float = 0.75):
    """``asked``: for each leg the places of queries in ``ids``, buckets and weights."""
    def search(batches):
        import numpy as np
        import pyarrow as pa

        legs = _matrices(asked, len(ids))
        best = {leg: _Best(len(ids), k) for leg in legs}
        idf = 1 + np.log(1.0 + np.arange(256))
        idf[0] = 0.0

        def dots(leg, rows, row, column, weigh, keys):
            """Tiles of documents, of which ``weigh`` makes weights from their entries."""
            m = legs[leg][1]
            wide = m.shape[0]
            step = max(1, TILE_CELLS // max(1, wide))
            for at in range(0, rows if wide else 0, step):
                stop = min(rows, at + step)
                a, z = np.searchsorted(row, [at, stop])
                cells = weigh((row[a:z] - at).astype("int64") * wide + column[a:z], slice(a, z), (stop - at) * wide).reshape(stop - at, wide)
                scores = cells @ m
                if leg != "grams":  # as in SQL, where these are joined by their key
                    scores[keys[at:stop] == _NONE] = 0.0
                best[leg].add(keys[at:stop], scores)

        def saturated(rows, took):
            column = legs["words"][0][took.word_buckets(SIZES["words"])][took.code]
            met = column >= 0
            every, at, tf = np.unique(took.row[met] * max(1, len(took.words)) + took.code[met], return_index=True, return_counts=True)
            row, column = took.row[met][at], column[met][at]
            weight = (k1 + 1) * tf / (k1 * (1 - b + b * took.dl[row] / mean) + tf)
            return row, column, lambda cell, s, n: np.bincount(cell, weight[s], n)

        def hashed(rows, took):
            bucket = took.hashed_buckets("s", SIZES["dense"])[took.code]
            counts = np.bincount(took.row * SIZES["dense"] + bucket, minlength=rows * SIZES["dense"]).reshape(rows, -1)
            norm = np.sqrt((counts * counts).sum(axis=1))
            row, bucket = np.nonzero(counts)
            column, weight = legs["dense"][0][bucket], counts[row, bucket] / norm[row]
            met = column >= 0
            row, column, weight = row[met], column[met], weight[met]
            return row, column, lambda cell, s, n: np.bincount(cell, weight[s], n)

        def grams(rows, took):
            row, bucket = took.gram_buckets(SIZES["grams"])
            column = legs["grams"][0][bucket]
            met = column >= 0

            def weigh(cell, _, n):
                c = np.bincount(cell, minlength=n)
                return idf[c] if not len(c) or c.max() < len(idf) else np.where(c > 0, 1 + np.log(1.0 + c), 0.0)

            return row[met], column[met], weigh

        for some in t._slices(batches, t.GRAM_BYTES):
            took, rows = t.Taken(some.column("__text")), some.num_rows
            keys = some.column("doc_id").fill_null(_NONE).to_numpy()
            for leg, entries in (("words", saturated), ("dense", hashed), ("grams", grams)):
                dots(leg, rows, *entries(rows, took), keys)
        for leg, found in best.items():
            q, doc, score = found.cut()
            yield pa.RecordBatch.from_arrays([pa.array([leg] * len(q), pa.string()), pa.array(np.array(ids, "int64")[q]), pa.array(doc, mask=doc == _NONE), pa.array(score)], ["source", "query_id", "item", "score"])

    return search


def found(asked: DataFrame, docs: DataFrame, key: str, text: str, k: int, most: int = ASKED) -> DataFrame:
    """source, query_id, item, score: for queries' tokens (query_id, token) the ``k`` best texts by their words (``bm25_dot``), by hashed words and by character n-grams
    (inner products of ``hashed_text`` and ``ngram_vectors``), or a few more.

    Up to ``most`` queries travel as matrices to where the texts are: a slice of texts is taken apart once, its vectors are multiplied and forgotten, and a task keeps the
    ``k`` best of each query and leg, so that neither texts nor vectors are shuffled or stored. More queries are compared leg by leg in grids of bounded blocks.
    """
    named = asked.withColumnRenamed("query_id", "doc_id")
    vectors = {"words": t.bm25_queries(asked, SIZES["words"]).withColumnRenamed("query_id", "doc_id"), "dense": t.hashed_text(named, SIZES["dense"]), "grams": t.ngram_vectors(named, SIZES["grams"])}
    if asked.select("query_id").distinct().limit(most + 1).count() > most:
        tokens = t.doc_tokens(docs, key, text)
        as_query = lambda leg: vectors[leg].withColumnRenamed("doc_id", "query_id")
        legs = {"words": t.bm25_dot(asked, docs, key, text, k), "dense": t.sparse_dot(as_query("dense"), t.hashed_text(tokens), k), "grams": t.sparse_dot(as_query("grams"), t.ngram_vectors(tokens), k)}
        rows = [df.select(F.lit(leg).alias("source"), "query_id", F.col("doc_id").alias("item"), "score") for leg, df in legs.items()]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])
    import numpy as np

    every = [v.select(F.lit(leg).alias("source"), F.col("doc_id").cast("long").alias("query_id"), "bucket", F.col("weight").cast("double").alias("weight")) for leg, v in vectors.items()]
    rows = every[0].unionByName(every[1]).unionByName(every[2]).where("query_id IS NOT NULL").toPandas()
    ids = sorted({*rows["query_id"].tolist()})
    place = np.searchsorted(ids, rows["query_id"]) if ids else np.zeros(0, "int64")
    asked_of = {leg: (place[(rows["source"] == leg).to_numpy()], *(rows.loc[rows["source"] == leg, c].to_numpy(kind) for c, kind in (("bucket", "int64"), ("weight", "float64")))) for leg in SIZES}
    texts = t.whole_texts(docs, key, text)
    mean = texts.mapInArrow(_lengths, "dl long").agg(F.avg("dl")).first()[0]
    return texts.mapInArrow(_search(asked_of, ids, k, mean or 1.0), "source string, query_id long, item long, score double")
