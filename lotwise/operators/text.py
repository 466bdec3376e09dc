"""Text operators: tokens, segments, compounds, synonyms, sparse vectors, n-gram classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.sources.sinks import stored

from .sizes import MODEL, small

STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was"]
# Compound top-level domains of two labels.
COMPOUND_TLDS = ["co.uk", "org.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.in", "com.mx", "co.za"]


def tokenize(text: Column, min_chars: int = 2, stopwords: list[str] = STOPWORDS, cap: int | None = None) -> Column:
    """Runs of a-z and 0-9, lower case, in order; all of them, or the first ``cap`` (for queries)."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    stop = F.array(*[F.lit(s) for s in stopwords])
    kept = F.filter(words, lambda w: (F.length(w) >= min_chars) & ~F.array_contains(stop, w))
    return kept if cap is None else F.slice(kept, 1, cap)


#: Characters of the texts that a task takes apart, about.
TASK_CHARS = 4_000_000


def doc_tokens(docs: DataFrame, key: str, text: str, name: str = "doc_id") -> DataFrame:
    """(``name``, token) of each text. Texts are dealt by their key before they are taken apart: so counts by (document, token), lengths and
    vectors all stay where the text is, and one shuffle of texts replaces one of tokens for each of them. The number of parts follows from the texts' length and
    isn't left to adaptive execution, which would judge by the texts what a task can hold of their tokens and grams."""
    texts = dealt(docs.select(F.col(key).alias(name), F.col(text).alias("__text")), name, "__text")
    return texts.select(name, F.explode(tokenize(F.col("__text"))).alias("token"))


def dealt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows by their key, in parts of about TASK_CHARS of text."""
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), key)


def spread(docs: DataFrame, key: str) -> DataFrame:
    """Rows as they are read, where the parts are about even, in four parts for each core at most; else dealt by their key. For tasks that read a slice at a time and so may have any size."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    sizes = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.count("*").alias("parts"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if (sizes["most"] or 0) * cores > 3 * (sizes["n"] or 0):
        return docs.repartition(4 * cores, key)
    return docs.coalesce(4 * cores) if sizes["parts"] > 4 * cores else docs


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether rows share a key. Only keys are read."""
    return not docs.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def whole_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id and __text, one row for each key, in lower case with a space at the end. Texts are moved only where keys repeat or parts are uneven."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    if repeated(rows, "doc_id"):
        texts = dealt(rows, "doc_id", "__text").groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("__text")).alias("__text"))
    else:
        texts = spread(rows, "doc_id")
    return texts.select("doc_id", F.concat(F.lower("__text"), F.lit(" ")).alias("__text"))


def normalise(text: Column) -> Column:
    """Compatible forms made one and accents stripped; ICU comes with Spark."""
    apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.when(text.isNotNull(), F.regexp_replace(apart, r"\p{Mn}", ""))


def idn_decode(label: Column) -> Column:
    """A punycode label in its own script, case folded; as it is if it can't be read."""
    return F.when(label.startswith("xn--"), F.lower(F.reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), label))).otherwise(label)


def segment(host: Column) -> Column:
    """struct(sld, tld, tokens) of a host: the TLD may have two labels; labels are decoded from punycode; the one before the TLD splits
    into runs of letters and digits, or, if it isn't ASCII, is one token without accents."""
    labels = F.split(F.lower(F.rtrim(F.trim(host), F.lit("."))), r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))
    double = (n >= 3) & two.isin(*COMPOUND_TLDS)
    sld = F.when(double, F.element_at(labels, -3)).when(n >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, -1))
    tld = F.when(double, two).when(n >= 2, idn_decode(F.element_at(labels, -1))).otherwise(F.lit(""))
    own = idn_decode(sld)
    tokens = F.when(own.rlike(r"^[\x00-\x7F]*$"), F.regexp_extract_all(own, F.lit("([a-z]+|[0-9]+)"), 1)).otherwise(F.array(normalise(own)))
    return F.struct(own.alias("sld"), tld.alias("tld"), tokens.alias("tokens"))


def split_compound(word: str, costs: dict[str, float], unknown: float = 10.0, bonus: float = 0.1, most: int = 6) -> list[str]:
    """The cheapest split of a word into dictionary words and single characters; longer words have a bonus; whole if over ``most`` parts."""
    n = len(word)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
    longest = max(map(len, costs), default=1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            piece = word[i:j]
            cost = costs[piece] - bonus * len(piece) if piece in costs else unknown if j - i == 1 else None
            if cost is not None and best[i][0] + cost < best[j][0]:
                best[j] = (best[i][0] + cost, i)
    parts, j = [], n
    while j:
        parts.append(word[best[j][1] : j])
        j = best[j][1]
    return parts[::-1] if len(parts) <= most else [word]


def compound_udf(costs: dict[str, float]):
    """The splitter over a column; the dictionary is a fixed, bounded one and travels with the task."""
    @F.pandas_udf("array<string>")
    def split(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else split_compound(w, costs))

    return split


def damerau(a: str, b: str) -> int:
    """Edits with transpositions of neighbours."""
    rows = [[*range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def damerau_udf():
    """Each different pair of a batch is measured once."""
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [*zip(a, b, strict=True)]
        known = {(x, y): None if x is None or y is None else damerau(x, y) for x, y in {*pairs}}
        return pd.Series([known[p] for p in pairs], dtype="Int64")

    return distance


#: From this length on tokens meet by their parts instead of by their deletions.
LONG_TOKEN, PART_CHARS = 30, 6


def _deletions(token: str, most: int) -> set[str]:
    """A token without up to ``most`` of its letters."""
    every, last = {token}, {token}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        every |= last
    return every


def _meeting_keys(farthest: int, asked: bool):
    """Keys under which tokens within ``farthest`` edits meet: each edit, a transposition too, is undone by one deletion on either side, so near tokens have a
    common deletion. A long token would have too many: it is cut into twice as many parts as there may be edits and one more, of which one is untouched (a transposition
    touches two at most), and its beginning is among the other's runs of letters."""
    parts = 2 * farthest + 1
    long = max(LONG_TOKEN, parts * PART_CHARS)

    @F.pandas_udf("array<string>")
    def keys(tokens: pd.Series) -> pd.Series:
        out = []
        for w in tokens:
            own = set()
            if len(w) < long or not asked and len(w) < long + farthest:
                own |= {f"d{x}" for x in _deletions(w, farthest)}
            if asked and len(w) >= long:
                cuts = [len(w) * i // parts for i in range(parts)]
                own |= {f"p{w[c : c + PART_CHARS]}" for c in cuts}
            if not asked and len(w) >= long - farthest:
                own |= {f"p{w[i : i + PART_CHARS]}" for i in range(len(w) - PART_CHARS + 1)}
            out.append(sorted(own))
        return pd.Series(out, dtype="object")

    return keys


def edit_neighbours(left: DataFrame, right: DataFrame, farthest: int = 2) -> DataFrame:
    """(a, b, distance) of the different tokens (column token) of both sides that are within ``farthest`` edits, transpositions of neighbours counting as one.

    Tokens meet under their deletions, so distances are taken of candidates alone and there is no pair of all tokens with all others.
    """
    side = lambda df, name, asked: df.select(F.col("token").alias(name)).where(F.col(name).isNotNull()).distinct().withColumn("__k", F.explode(_meeting_keys(farthest, asked)(name)))
    near = (F.length("a") - F.length("b")).between(-farthest, farthest)
    met = side(left, "a", True).join(side(right, "b", False), "__k").where(near).select("a", "b").distinct()
    return met.withColumn("distance", damerau_udf()("a", "b")).where(F.col("distance") <= farthest)


def coverage(lists: DataFrame, query: Column, item: Column, farthest: int = 2, least: float = 0.6) -> DataFrame:
    """``lists`` with ``coverage``, 0..1, of query tokens by an item's tokens (arrays): the best likeness times the share of query tokens that have a match.

    A pair is alike by 1 if one holds the other, else by 1 - distance / the longer length up to ``farthest`` edits (with transpositions);
    ``least`` makes a match. Distances are known from the neighbours of the different tokens of all rows; a row looks its own up.
    """
    rows = lists.withColumn("__q", query).withColumn("__t", item)
    asked = rows.select("__q").where("__q IS NOT NULL").distinct()
    near = edit_neighbours(asked.select(F.explode("__q").alias("token")), rows.select(F.explode("__t").alias("token")), farthest)
    like = near.select(F.col("a").alias("__w"), F.struct("b", (1 - F.col("distance") / F.greatest(F.length("a"), F.length("b"), F.lit(1))).alias("like")).alias("__n"))
    alike = like.groupBy("__w").agg(F.map_from_entries(F.collect_list("__n")).alias("__n"))
    known = asked.select("__q", F.explode(F.array_distinct("__q")).alias("__w")).join(alike, "__w").groupBy("__q").agg(F.map_from_entries(F.collect_list(F.struct("__w", "__n"))).alias("__known"))
    rows = rows.join(known, "__q", "left")
    holds = lambda x: F.exists("__t", lambda y: F.contains(y, x) | F.contains(x, y))
    best = F.transform("__q", lambda x: F.when(holds(x), 1.0).otherwise(F.array_max(F.transform("__t", lambda y: F.coalesce(F.col("__known")[x][y], F.lit(0.0))))))
    matched = F.filter(best, lambda b: b >= least)
    share = F.array_max(matched) * F.size(matched) / F.size("__q")
    return rows.withColumn("coverage", F.when(F.size(matched) > 0, share).otherwise(0.0)).drop("__q", "__t", "__known")


def synonym_expand(tokens: DataFrame, synonyms: DataFrame, weight: float = 0.5, cap: int = 3) -> DataFrame:
    """(doc_id, token) with (a, b) pairs, read both ways: originals weigh 1, up to ``cap`` synonyms each ``weight``, none that is an original."""
    both = synonyms.select("a", "b").union(synonyms.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    met = both.groupBy(F.col("a").alias("token")).agg(F.slice(F.array_sort(F.collect_list("b")), 1, cap).alias("__b"))
    own = tokens.select("doc_id", "token").distinct().join(small(met), "token", "left")
    # originals and synonyms in one pass where the texts are: a synonym that is an original too counts as that
    every = F.concat(F.array(F.struct("token", F.lit(True).alias("own"))), F.transform(F.coalesce("__b", F.array().cast("array<string>")), lambda b: F.struct(b.alias("token"), F.lit(False).alias("own"))))
    rows = own.select("doc_id", F.explode(every).alias("__x")).groupBy("doc_id", "__x.token").agg(F.max("__x.own").alias("__own"))
    return rows.select("doc_id", "token", F.when(F.col("__own"), 1.0).otherwise(float(weight)).alias("weight"))


def synonym_misses(tokens: DataFrame, synonyms: DataFrame, least: int) -> DataFrame:
    known = synonyms.select(F.col("a").alias("token")).union(synonyms.select("b"))
    return tokens.join(known, "token", "left_anti").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def hash_bucket(term: Column, size: int) -> Column:
    """The first 8 bytes of sha256 modulo ``size``."""
    if size & (size - 1) == 0 and size <= 1 << 28:  # the last of these bytes tell it
        digits = -(-(size.bit_length() - 1) // 4) or 1
        return (F.conv(F.substring(F.sha2(term, 256), 17 - digits, digits), 16, 10).cast("int") % size).cast("int")
    return (F.conv(F.substring(F.sha2(term, 256), 1, 16), 16, 10).cast("decimal(20,0)") % size).cast("int")


def term_counts(tokens: DataFrame) -> DataFrame:
    """doc_id, token, tf, dl (the document's tokens) of (doc_id, token): what a weight is made of, whatever the corpus."""
    tf = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return tf.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id")))  # one document's different tokens


def saturated(tf: Column, dl: Column, mean: Column | float, k1: float = 1.2, b: float = 0.75) -> Column:
    return (k1 + 1) * tf / (k1 * (1 - b + b * dl / mean) + tf)


def bm25_docs(tokens: DataFrame, size: int = 1 << 16, k1: float = 1.2, b: float = 0.75, mean: float | None = None) -> DataFrame:
    """doc_id, bucket, weight of (doc_id, token): saturated term frequencies, summed where terms share a bucket. ``mean``: the length that counts as
    usual; without it that of these documents."""
    terms = term_counts(tokens)
    if mean is None:
        lengths = tokens.groupBy("doc_id").agg(F.count("*").alias("dl")).agg(F.avg("dl").alias("mean"))
        terms = terms.join(F.broadcast(lengths), F.lit(True))
    w = saturated(F.col("tf"), F.col("dl"), F.col("mean") if mean is None else F.lit(float(mean)), k1, b)
    return terms.select("doc_id", hash_bucket(F.col("token"), size).alias("bucket"), w.alias("w")).groupBy("doc_id", "bucket").agg(F.sum("w").alias("weight"))


def bm25_queries(tokens: DataFrame, size: int = 1 << 16, synonyms: DataFrame | None = None, weight: float = 0.5, cap: int = 3) -> DataFrame:
    """query_id, bucket, weight of (query_id, token): 1 + ln(1 + tf), and for synonyms (pairs a, b, read both ways) ``weight`` times that of
    one occurrence; no synonym is an original."""
    tf = tokens.groupBy("query_id", "token").agg(F.count("*").alias("tf")).select("query_id", "token", (1 + F.ln(1 + F.col("tf"))).alias("w"))
    if synonyms is not None:
        more = synonym_expand(tokens.select(F.col("query_id").alias("doc_id"), "token"), synonyms, weight, cap).where(F.col("weight") != 1.0)
        tf = tf.unionByName(more.select(F.col("doc_id").alias("query_id"), "token", (weight * (1 + F.ln(F.lit(2.0)))).alias("w")))
    return tf.select("query_id", hash_bucket(F.col("token"), size).alias("bucket"), "w").groupBy("query_id", "bucket").agg(F.sum("w").alias("weight"))


#: Entries of documents' vectors in a block, about, and queries in one: what a task of the sparse product holds; documents of a range within it.
DOT_ENTRIES, DOT_QUERIES, DOT_RANGE = 250_000, 10_000, 16


class _Postings:
    """A block's documents by bucket, in ranges of ``DOT_RANGE`` with the greatest weight of each bucket and range.

    Documents are ordered by their own greatest weight, so that the ranges differ in what they can reach.
    """

    def __init__(self, docs):
        import numpy as np

        self.ids, at = np.unique(docs["doc_id"].to_numpy(), return_inverse=True)
        bucket, weight = docs["bucket"].to_numpy(), docs["weight"].to_numpy()
        most = np.full(len(self.ids), -np.inf)
        np.maximum.at(most, at, weight)
        order = np.argsort(-most, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.ids, at = self.ids[order], place[at]
        order = np.lexsort((at, bucket))
        bucket, self.at, self.weight = bucket[order], at[order], weight[order]
        part = self.at // DOT_RANGE
        self.start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        self.stop = np.r_[self.start[1:], len(bucket)]
        self.bucket, self.part, self.most = bucket[self.start], part[self.start], np.maximum.reduceat(weight[order], self.start)
        self.ranges = -(-len(self.ids) // DOT_RANGE)

    @staticmethod
    def _spread(start, stop):
        """Which of the given stretches each place lies in, and the places of all of them."""
        import numpy as np

        size = stop - start
        own = np.repeat(np.arange(len(size)), size)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + start[own]

    def best(self, buckets, weights, k: int):
        """Documents and scores of one query, with every tie of the ``k``-th, and the ranges that were passed over: their greatest weights don't add up to the
        ``k``-th score. Weights aren't negative."""
        import numpy as np

        term, entry = self._spread(np.searchsorted(self.bucket, buckets), np.searchsorted(self.bucket, buckets, "right"))
        own, part = weights[term], self.part[entry]
        reach = np.bincount(part, own * self.most[entry], self.ranges)
        order = np.argsort(-reach, kind="stable")
        order = order[reach[order] > 0]
        found, said, least, done, step = [], [], -np.inf, 0, max(4, -(-2 * k // DOT_RANGE))
        while done < len(order):
            some = order[done : done + step]
            some = some[reach[some] >= least - 1e-6]
            if not len(some):
                break
            inside = np.zeros(self.ranges, "bool")
            inside[some] = True
            e = np.flatnonzero(inside[part])
            which, at = self._spread(self.start[entry[e]], self.stop[entry[e]])
            doc = self.at[at]
            score = np.bincount(doc, own[e][which] * self.weight[at], len(self.ids))
            met = np.zeros(len(self.ids), "bool")
            met[doc] = True
            doc = np.flatnonzero(met)
            found.append(doc)
            said.append(score[doc])
            done, step = done + len(some), 2 * step
            every = np.round(np.concatenate(said), 9)
            if len(every) >= k:
                least = np.partition(every, len(every) - k)[len(every) - k]
        if not found:
            return np.zeros(0, "int64"), np.zeros(0), 0
        docs, scores = np.concatenate(found), np.concatenate(said)
        keep = np.round(scores, 9) >= least
        return self.ids[docs[keep]], scores[keep], len(order) - done


def _sparse_cell(k: int, entries=None):
    """``entries``: makes rows of doc_id, bucket and weight of a block's documents, where they aren't that already."""
    def best(docs, queries):
        import numpy as np

        out = {"query_id": [], "doc_id": [], "score": [], "ranges": [], "skipped": []}
        if len(docs) and len(queries):
            cell = _Postings(entries(docs) if entries else docs)
            queries = queries.sort_values(["query_id", "bucket"])
            q, bucket, weight = (queries[c].to_numpy() for c in ("query_id", "bucket", "weight"))
            ends = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True])
            for a, b in zip(ends, ends[1:], strict=False):
                ids, scores, skipped = cell.best(bucket[a:b], weight[a:b], k)
                top = np.lexsort((ids, -np.round(scores, 9)))[:k]
                for name, value in (("query_id", q[a]), ("ranges", cell.ranges), ("skipped", skipped)):
                    out[name].append(np.full(len(top), value))
                out["doc_id"].append(ids[top])
                out["score"].append(scores[top])
        kinds = {n: "float64" if n == "score" else "int64" for n in out}
        return pd.DataFrame({n: np.concatenate(v).astype(kinds[n]) if v else np.zeros(0, kinds[n]) for n, v in out.items()})

    return best


def sparse_cells(queries: DataFrame, docs: DataFrame, k: int, entries: int = DOT_ENTRIES, query_block: int = DOT_QUERIES) -> DataFrame:
    """query_id, doc_id, score: the ``k`` best documents of each block of documents for each query; and of that block the ranges, and how many of
    them were skipped."""
    docs = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "bucket", "weight"), "vectors")
    return _cells(queries, docs, docs.count(), k, entries, query_block)


def _cells(queries: DataFrame, docs: DataFrame, n: int, k: int, size: int, query_block: int, entries=None) -> DataFrame:
    queries = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), "bucket", "weight"), "queries")
    across, down = max(1, -(-n // size)), max(1, -(-queries.select("query_id").distinct().count() // query_block))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = docs.withColumn("x", F.pmod(F.xxhash64("doc_id"), F.lit(across)).cast("int")).withColumn("y", every(down))
    right = queries.withColumn("y", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int")).withColumn("x", every(across))
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(_sparse_cell(k, entries), "query_id long, doc_id long, score double, ranges long, skipped long")


def sparse_dot(queries: DataFrame, docs: DataFrame, k: int, entries: int = DOT_ENTRIES, query_block: int = DOT_QUERIES) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` documents of the highest inner product for each query, of those that share a bucket with it.

    A grid of bounded blocks: documents are dealt by the hash of their ids, queries likewise. A block keeps its postings in ranges with the greatest weight of
    each; a query takes the ranges by what they can reach and ends at the first one that can't reach its ``k``-th score, so the result is exact.
    A frequent bucket is spread over all blocks and no table of (query, document) pairs is made. Weights aren't negative. Ties (to 9 places) go to the smaller id.
    """
    return _best(sparse_cells(queries, docs, k, entries, query_block), k)


def _best(cells: DataFrame, k: int) -> DataFrame:
    cells = cells.drop("ranges", "skipped")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Bytes of texts that are taken apart in one go; with their grams.
TERM_BYTES, GRAM_BYTES = 8_000_000, 1_000_000


def _words(texts):
    """The runs of two or more of a-z and 0-9 in an array of strings, as one array of bytes, and each one's row."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    first = offsets[0]
    flat = np.frombuffer(texts.buffers()[2], "uint8")[first : offsets[-1]] if texts.buffers()[2] else np.zeros(0, "uint8")
    letter = np.zeros(256, "bool")
    letter[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", "uint8")] = True
    inside = letter[flat]
    cut = np.zeros(len(flat) + 1, "bool")
    cut[1:-1] = inside[1:] != inside[:-1]
    cut[offsets - first] = True
    at = np.flatnonzero(cut)
    own = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, offsets - first)))
    kind, width = (pa.binary(), "int32") if len(flat) < 1 << 31 else (pa.large_binary(), "int64")
    runs = pa.Array.from_buffers(kind, len(own), [None, pa.py_buffer(at.astype(width)), pa.py_buffer(flat)])
    word = inside[at[:-1]] & (np.diff(at) >= 2)
    return runs.filter(pa.array(word)), own[word]


def _asked_terms(asked: list[int], size: int):
    """Of batches of texts in lower case, for each row: ``dl``, its words in all; ``buckets`` and ``tfs``, bucket and frequency of its different words that fall into one of the
    ``asked`` buckets, and ``n``, how many buckets these are. Words are as ``tokenize`` takes them; a word's bucket is made once for each slice of texts."""
    def terms(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        wanted, stop = np.zeros(size, "bool"), {w.encode() for w in STOPWORDS}
        wanted[asked] = True

        def buckets(words) -> np.ndarray:
            """-2: no token; -1: none that is asked for."""
            _, ends, data = words.buffers()
            ends = np.frombuffer(ends, "int64" if words.type == pa.large_binary() else "int32")[: len(words) + 1].tolist()
            data = data.to_pybytes() if data else b""
            each = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            at = (np.frombuffer(b"".join([sha256(w).digest()[:8] for w in each]), ">u8") % np.uint64(size)).astype("int64")
            return np.where([w in stop for w in each], -2, np.where(wanted[at], at, -1)).astype("int64")

        for some in _slices(batches, TERM_BYTES):
            rows = some.num_rows
            words, own = _words(some.column("__text").fill_null(""))
            words = words.dictionary_encode()
            code = words.indices.to_numpy().astype("int64")
            told = buckets(words.dictionary)
            place = told[code] if len(code) else code
            dl = np.bincount(own[place > -2], minlength=rows)
            met = place >= 0
            every, tf = np.unique(own[met] * max(1, len(told)) + code[met], return_counts=True)
            row, at = every // max(1, len(told)), told[every % max(1, len(told))] if len(told) else every
            order = np.lexsort((tf, at, row))
            row, at, tf = row[order], at[order], tf[order]
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype("int32"))
            first = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])][: len(row)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype("int32"))) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(dl.astype("int64")), *lists, pa.array(np.bincount(row[first], minlength=rows).astype("int64"))], ["doc_id", "dl", "buckets", "tfs", "n"])

    return terms


def _slices(batches, most: int):
    """Batches in slices of about ``most`` bytes."""
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def _weighed(mean: float, k1: float, b: float, size: int):
    """Entries of packed rows, with weights as ``bm25_docs`` makes them."""
    def entries(docs):
        import numpy as np

        own = np.repeat(np.arange(len(docs)), [len(x) for x in docs["buckets"]])
        tf, dl = np.concatenate(docs["tfs"].tolist()), docs["dl"].to_numpy()[own]
        every, at = np.unique(own * size + np.concatenate(docs["buckets"].tolist()), return_inverse=True)
        weight = np.bincount(at, (k1 + 1) * tf / (k1 * (1 - b + b * dl / mean) + tf), len(every))
        return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy()[every // size], "bucket": every % size, "weight": weight})

    return entries


def bm25_dot(asked: DataFrame, docs: DataFrame, key: str, text: str, k: int, size: int = 1 << 16, k1: float = 1.2, b: float = 0.75, entries: int = DOT_ENTRIES, query_block: int = DOT_QUERIES) -> DataFrame:
    """``sparse_dot`` of ``bm25_queries`` of tokens (query_id, token) and ``bm25_docs`` of all texts' tokens, in one pass over the texts.

    Only buckets that a query names can meet, so no other word is kept: a document is one row with its length and its words in these buckets (``size`` at most), and stays one row
    up to the block that it is compared in, where its weights are made. Rows of one key are one document.
    """
    queries = stored(bm25_queries(asked, size), "queries")
    wanted = sorted(r[0] for r in queries.select("bucket").distinct().collect())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    texts = dealt(rows, "doc_id", "__text")
    if rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        texts = texts.select("doc_id", F.lower("__text").alias("__text"))
    else:  # only then are texts gathered by their key
        texts = texts.groupBy("doc_id").agg(F.lower(F.concat_ws(" ", F.collect_list("__text"))).alias("__text"))
    packed = stored(texts.mapInArrow(_asked_terms(wanted, size), "doc_id long, dl long, buckets array<int>, tfs array<int>, n long").where("dl > 0"), "vectors")
    told = packed.agg(F.avg("dl").alias("mean"), F.sum("n").alias("n")).first()
    return _best(_cells(queries, packed.where("n > 0").drop("n"), told["n"] or 0, k, entries, query_block, _weighed(told["mean"] or 1.0, k1, b, size)), k)


def narrow_dot(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, item, score of given (query_id, item) pairs: only the vectors that they name are read, and only their shared buckets meet."""
    wanted = pairs.select(F.col("item").alias("doc_id")).distinct()
    named = docs.join(small(wanted), "doc_id", "left_semi").select(F.col("doc_id").alias("item"), "bucket", F.col("weight").alias("__w"))
    asked = pairs.join(small(queries), "query_id").select("query_id", "item", "bucket", "weight")
    return asked.join(named, ["item", "bucket"]).groupBy("query_id", "item").agg(F.sum(F.col("weight") * F.col("__w")).alias("score"))


def char_ngrams(token: Column, low: int = 3, high: int = 4) -> Column:
    """All n-grams of ``^token$``."""
    marked = F.concat(F.lit("^"), token, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in range(low, high + 1)]
    return F.concat(*grams)


def ngram_vectors(tokens: DataFrame, size: int = 1 << 14, low: int = 3, high: int = 4) -> DataFrame:
    """doc_id, bucket, weight of (doc_id, token): 1 + ln(1 + tf) of character n-grams. Tokens are counted before they are taken apart."""
    counts = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    grams = counts.select("doc_id", "n", F.explode(char_ngrams(F.col("token"), low, high)).alias("gram"))
    tf = grams.groupBy("doc_id", hash_bucket(F.col("gram"), size).alias("bucket")).agg(F.sum("n").alias("tf"))
    return tf.select("doc_id", "bucket", (1 + F.ln(1 + F.col("tf"))).alias("weight"))


def hashed_text(tokens: DataFrame, dims: int = 256, seed: str = "s") -> DataFrame:
    """doc_id, bucket, weight: token counts by hash bucket, of length one."""
    bucket = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col("token")), 256), 1, 8), 16, 10).cast("long") % dims).cast("int")
    words = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))  # a word's bucket is made once for each text
    counts = words.groupBy("doc_id", bucket.alias("bucket")).agg(F.sum("n").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("doc_id")))  # one document's buckets
    return counts.select("doc_id", "bucket", (F.col("c") / norm).alias("weight"))


def ngrams(tokens: Column) -> Column:
    """Single tokens and neighbouring pairs, each once."""
    pairs = F.when(F.size(tokens) >= 2, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tokens, pairs))


#: Tokens of a batch that are taken apart in one go.
GRAM_TOKENS = 1_000_000


def _token_slices(batches, most: int):
    """Batches with a column ``tokens``, cut into slices of about ``most`` tokens: the slice, its different tokens, its documents' grams as (row, key) in order of both, each once, and the keys' base: a
    token's key is its code, that of a pair of neighbours is the second one's code plus base times (the first one's + 1)."""
    import numpy as np

    for batch in batches:
        sizes = np.r_[0, np.cumsum(np.nan_to_num(batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)).astype("int64"))]
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            some = batch.slice(at, stop - at)
            own = np.repeat(np.arange(stop - at), np.diff(sizes[at : stop + 1]))
            at = stop
            words = some.column("tokens").flatten().dictionary_encode()
            code, base = words.indices.to_numpy().astype("int64"), len(words.dictionary) + 1
            both = np.flatnonzero(own[1:] == own[:-1])
            row, key = np.r_[own, own[both]], np.r_[code, code[both + 1] + base * (code[both] + 1)]
            every = np.unique(row * base * base + key)
            yield some, words.dictionary, every // (base * base), every % (base * base), base


def _gram_counts(schema, most: int):
    """label, gram and the number of a slice's documents that hold it."""
    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for some, words, row, key, base in _token_slices(batches, most):
            labels = some.column("label").dictionary_encode("encode")
            label = labels.indices.to_numpy().astype("int64")[row]
            found, n = np.unique(label * base * base + key, return_counts=True)
            label, key = found // (base * base), found % (base * base)
            second, first = pa.array(key % base), key // base
            grams = pc.if_else(pa.array(first > 0), pc.binary_join_element_wise(words.take(pa.array(np.maximum(first - 1, 0))), words.take(second), " "), words.take(second))
            yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(label)).cast(schema.field("label").type), grams.cast(pa.string()), pa.array(n)], schema=schema)

    return count


def _gram_hits(wanted: list[str], schema, most: int):
    """doc_id and gram of the documents that hold one of the wanted grams."""
    def hits(batches):
        import numpy as np
        import pyarrow as pa

        apart = [w.split(" ") for w in wanted]
        for some, words, row, key, base in _token_slices(batches, most):
            code = {w: i for i, w in enumerate(words.to_pylist())}
            known = [(code[w[-1]] + base * (code[w[0]] + 1 if len(w) == 2 else 0), i) for i, w in enumerate(apart) if all(x in code for x in w)]
            if known:
                keys, names = (np.array(x, "int64") for x in zip(*sorted(known), strict=True))
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = keys[at] == key
                grams = pa.array(wanted, pa.string()).take(pa.array(names[at[met]]))
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(row[met])).cast(schema.field("doc_id").type), grams], schema=schema)

    return hits


#: Signs of grams: a-z, 0-9, the beginning and the end of a word.
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789^$"
#: Buckets of all grams of three and four signs by their code, as far as they were met, by the number of buckets.
_KNOWN_GRAMS: dict = {}


class Taken:
    """Texts in lower case, taken apart as ``tokenize`` does: ``words``, the different ones; of each token its text (``row``) and its word (``code``); ``dl``, the tokens of each text.
    Each text ends with a space or is empty."""

    def __init__(self, texts):
        import numpy as np
        import pyarrow as pa

        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
        first = offsets[0]
        flat = np.frombuffer(texts.buffers()[2], "uint8")[first : offsets[-1]] if texts.buffers()[2] else np.zeros(0, "uint8")
        sign = np.full(256, 255, "uint8")
        sign[np.frombuffer(_SIGNS[:36].encode(), "uint8")] = np.arange(36)
        self.signs = sign[flat]
        inside = self.signs < 36
        cut = np.zeros(len(flat) + 1, "bool")
        cut[1:-1] = inside[1:] != inside[:-1]
        cut[offsets - first] = True
        at = np.flatnonzero(cut)
        self.own, self.sizes = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, offsets - first))), np.diff(at)
        kind, width = (pa.binary(), "int32") if len(flat) < 1 << 31 else (pa.large_binary(), "int64")
        runs = pa.Array.from_buffers(kind, len(self.own), [None, pa.py_buffer(at.astype(width)), pa.py_buffer(flat)])
        kept = np.flatnonzero(inside[at[:-1]] & (self.sizes >= 2))
        words = runs.take(pa.array(kept)).dictionary_encode()
        self.words, code, stop = words.dictionary.to_pylist(), words.indices.to_numpy().astype("int64"), {w.encode() for w in STOPWORDS}
        counts = ~np.array([w in stop for w in self.words], "bool")[code] if len(code) else np.zeros(0, "bool")
        self.kept = kept[counts]
        self.row, self.code = self.own[self.kept], code[counts]
        self.dl = np.bincount(self.row, minlength=len(texts)).astype("int64")

    def word_buckets(self, size: int):
        """Of each word, as ``hash_bucket`` says."""
        from hashlib import sha256

        import numpy as np

        return (np.frombuffer(b"".join([sha256(w).digest()[:8] for w in self.words]), ">u8") % np.uint64(size)).astype("int64")

    def hashed_buckets(self, seed: str, dims: int):
        """Of each word, as ``hashed_text`` says."""
        from hashlib import sha256

        import numpy as np

        begun = sha256(f"{seed}|".encode())

        def head(w):
            h = begun.copy()
            h.update(w)
            return h.digest()[:4]

        return (np.frombuffer(b"".join([head(w) for w in self.words]), ">u4") % np.uint32(dims)).astype("int64")

    def gram_buckets(self, size: int):
        """Text and bucket of each occurrence of a gram of three or four signs, in the order of texts, as ``ngram_vectors`` says. A gram's code tells its place in a table, so it is hashed once for a worker's life."""
        from hashlib import sha256

        import numpy as np

        n = len(_SIGNS)
        known = _KNOWN_GRAMS.setdefault(size, np.full(n**3 + n**4, -1, "int32"))
        run = np.zeros(len(self.own), "bool")
        run[self.kept] = True
        pad = lambda x, v: np.r_[np.array([v], x.dtype), x, np.array([v, v], x.dtype)]
        inside, signs = pad(np.repeat(run, self.sizes), False), pad(self.signs, 0).astype("int32")
        row = np.repeat(self.own.astype("int32"), self.sizes)
        start, end = np.where(inside, signs, n - 2), np.where(inside, signs, n - 1)
        two = start[:-3] * n + signs[1:-2]  # a gram's second sign is always a letter, the place that it is counted at
        three, four = two * n + end[2:-1], n**3 + (two * n + signs[2:-1]) * n + end[3:]
        here = inside[1:-2]
        both = here & inside[2:-1]
        # grams of a text stand together: those at the same letter follow each other
        codes = np.full((int(here.sum()), 2), -1, "int32")
        codes[:, 0], codes[both[here], 1] = three[here], four[both]
        codes, rows = codes.ravel(), np.repeat(row[here], 2)
        met = codes >= 0
        codes, rows = codes[met], rows[met]
        new = np.unique(codes[known[codes] < 0])
        for c in new.tolist():
            long, x, gram = c >= n**3, c - n**3 * (c >= n**3), ""
            for _ in range(4 if long else 3):
                x, s = divmod(x, n)
                gram = _SIGNS[s] + gram
            known[c] = int.from_bytes(sha256(gram.encode()).digest()[:8], "big") % size
        return rows, known[codes]


def _counted(row, bucket, rows: int, size: int):
    """Text, bucket and number of the different (text, bucket), in order. Where they are dense they are counted in place, some texts at a time, else sorted; ``row`` ascends."""
    import numpy as np

    if 8 * len(row) < rows * size:
        every, n = np.unique(row.astype("int64") * size + bucket, return_counts=True)
        return every // size, every % size, n.astype("int64")
    step, out = max(1, 1_000_000 // size), []
    for at in range(0, rows, step):
        stop = min(rows, at + step)
        a, z = np.searchsorted(row, [at, stop])
        n = np.bincount((row[a:z] - at).astype("int64") * size + bucket[a:z], minlength=(stop - at) * size)
        cell = np.flatnonzero(n)
        out.append((cell // size + at, cell % size, n[cell]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def encodings(schema, sizes: tuple[int, int, int], most: int = GRAM_BYTES):
    """Of batches with a column ``__text`` (as in ``Taken``), for each row: ``terms``, bucket and frequency of its different words, and ``dl``, its words in all; ``dense`` and ``grams``, the entries of
    ``hashed_text`` and ``ngram_vectors`` as maps; the other columns of ``schema`` as they are. A word's buckets are made once for each slice of texts, a gram's once."""
    def encode(batches):
        import numpy as np
        import pyarrow as pa

        for some in _slices(batches, most):
            took, rows = Taken(some.column("__text")), some.num_rows
            offsets = lambda r, rows=rows: pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=rows))].astype("int32"))
            every, n = np.unique(took.row * max(1, len(took.words)) + took.code, return_counts=True)
            row, own = every // max(1, len(took.words)), took.word_buckets(sizes[0])[every % max(1, len(took.words))]
            order = np.lexsort((n, own, row))
            terms = pa.StructArray.from_arrays([pa.array(own[order].astype("int32")), pa.array(n[order])], names=["bucket", "tf"])
            r, b, c = _counted(took.row, took.hashed_buckets("s", sizes[1])[took.code], rows, sizes[1])
            hashed = pa.MapArray.from_arrays(offsets(r), pa.array(b.astype("int32")), pa.array(c / np.sqrt(np.bincount(r, c * c, rows))[r]))
            r, b, c = _counted(*took.gram_buckets(sizes[2]), rows, sizes[2])
            grams = pa.MapArray.from_arrays(offsets(r), pa.array(b.astype("int32")), pa.array(1 + np.log(1.0 + c)))
            new = {"terms": pa.ListArray.from_arrays(offsets(row), terms), "dl": pa.array(took.dl), "dense": hashed, "grams": grams}
            yield pa.RecordBatch.from_arrays([(new[f.name] if f.name in new else some.column(f.name)).cast(f.type) for f in schema], schema=schema)

    return encode


#: Points whose weights are made in one go.
WEIGHED_ROWS = 250


def weighed_terms(schema, mean: float, k1: float = 1.2, b: float = 0.75):
    """Of batches with ``__terms`` (bucket and frequency, in the order of buckets) and ``__dl``, the other columns with ``words``: the weight of each bucket, as ``bm25_docs`` says."""
    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        for some in (batch.slice(at, WEIGHED_ROWS) for batch in batches for at in range(0, batch.num_rows, WEIGHED_ROWS)):
            terms, rows = some.column("__terms"), some.num_rows
            row = np.repeat(np.arange(rows), np.nan_to_num(terms.value_lengths().to_numpy(zero_copy_only=False)).astype("int64"))
            bucket, tf = (x.to_numpy().astype("int64") for x in terms.flatten().flatten())
            w = (k1 + 1) * tf / (k1 * (1 - b + b * some.column("__dl").to_numpy()[row] / mean) + tf)
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])][: len(row)])
            weight = np.add.reduceat(w, first) if len(first) else w
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[first], minlength=rows))].astype("int32"))
            words = pa.MapArray.from_arrays(offsets, pa.array(bucket[first].astype("int32")), pa.array(weight))
            yield pa.RecordBatch.from_arrays([(words if f.name == "words" else some.column(f.name)).cast(f.type) for f in schema], schema=schema)

    return weigh


def _arrow_schema(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def log_odds(docs: DataFrame, least: float = 0.5, top: int = 50, smooth: float = 1.0) -> DataFrame:
    """label, gram, weight: smoothed log-odds of an n-gram's documents inside a class against the others, the best of each class.

    docs: doc_id, label, tokens (no token has a space or is NULL). Grams are counted where the texts are, a slice of tokens at a time, so what is shuffled is a row for each different gram of a slice.
    """
    schema = T.StructType([docs.schema["label"], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    counts = docs.select("label", "tokens").mapInArrow(_gram_counts(_arrow_schema(schema), GRAM_TOKENS), schema)
    grams = counts.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    sizes = docs.groupBy("label").agg(F.count("*").alias("size"))
    whole = sizes.agg(F.sum("size").alias("all"))
    total = grams.withColumn("total", F.sum("n").over(Window.partitionBy("gram")))  # a gram has a row for each label
    j = total.join(small(sizes), "label").join(F.broadcast(whole), F.lit(True))
    inside = (F.col("n") + smooth) / (F.col("size") - F.col("n") + smooth)
    rest = F.col("total") - F.col("n")
    outside = (rest + smooth) / (F.col("all") - F.col("size") - rest + smooth)
    w = j.select("label", "gram", F.ln(inside / outside).alias("weight")).where(F.col("weight") >= least)
    order = Window.partitionBy("label").orderBy(F.desc(F.round("weight", 9)), "gram")
    return w.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")


def ngram_classify(docs: DataFrame, weights: DataFrame, threshold: float = 1.0, margin: float = 0.1) -> DataFrame:
    """doc_id, label, score: the class of the highest sum of weights, where that and its lead are high enough, else NULL. Weights are a bounded model."""
    weights = stored(weights, "weights")  # it is asked for more than once
    wanted = [r["gram"] for r in weights.select("gram").distinct().limit(MODEL + 1).collect()]
    if len(wanted) > MODEL:
        grams = docs.select("doc_id", F.explode(ngrams(F.col("tokens"))).alias("gram"))
    else:
        schema = T.StructType([docs.schema["doc_id"], T.StructField("gram", T.StringType())])
        grams = docs.select("doc_id", "tokens").mapInArrow(_gram_hits(wanted, _arrow_schema(schema), GRAM_TOKENS), schema)
    scores = grams.join(small(weights), "gram").groupBy("doc_id", "label").agg(F.sum("weight").alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "label")
    best = scores.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("k = 1")
    sure = (F.col("score") >= threshold) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin)
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.when(sure, F.col("label")).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"))
