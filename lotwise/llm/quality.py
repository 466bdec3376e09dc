"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees fitted to labelled rows give paths; each path (and its beginnings) is a conjunctive rule over statistics; a logistic
model with a lasso penalty keeps few of them; the kept rules become one Spark column expression. Statistics are taken over
whole texts in one narrow pass, and nothing but the bounded training sample is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, row_key, written

#: Labelled rows that the classifier learns from, at most; the smallest hashes of doc_id, so the same rows at every run.
TRAINING_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.002
FEATURES = [
    "log_chars", "log_words", "mean_word", "max_word", "upper", "digit", "punctuation", "symbol", "pipe", "exclaim", "space", "other", "alpha",
    "lines", "words_per_line", "repeated_lines", "distinct_words", "top_word", "short_words", "long_words", "upper_words", "symbol_words", "ends_marked", "periodic", "sentence_words",
]
_BYTES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "punctuation": b".,;:'\"()?-", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "pipe": b"|", "exclaim": b"!", "space": b" \t\n\r"}


def statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text; a null or empty text has zeros."""
    import math

    import numpy as np

    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, "uint8"), minlength=256)
    n = len(text)
    share = {k: float(counts[list(v)].sum()) / n for k, v in _BYTES.items()}
    other = float(counts[128:].sum()) / len(data)
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), "int64", len(words)) if words else np.zeros(1, "int64")
    tally: dict[str, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    upper = sum(map(str.isupper, words)) / w
    marked = sum(1 for x in words if not x[-1].isalnum()) / w
    symbols = sum(c * (not any(map(str.isalnum, x)) or x[-1] in "#$%&*|!") for x, c in tally.items()) / w
    half = len(words) // 2
    step = max(1, half // 64)
    probe = words[: half : step] if half else []
    # a text that repeats itself: words met again at the distance of the first word's next place
    back = words.index(words[0], 1) if half and tally[words[0]] > 1 else 0
    periodic = sum(words[i] == words[i + back] for i in range(0, len(words) - back, step)) / max(1, len(range(0, len(words) - back, step))) if back and probe else 0.0
    sentences = max(1, text.count(".") + text.count("?"))
    return [
        math.log1p(n), math.log1p(len(words)), float(lengths.mean()), math.log1p(int(lengths.max())), share["upper"], share["digit"], share["punctuation"], share["symbol"], share["pipe"], share["exclaim"], share["space"], other, float(counts[65:91].sum() + counts[97:123].sum()) / len(data),
        math.log1p(len(lines)), len(words) / len(lines), 1 - len(set(lines)) / len(lines), len(tally) / w, max(tally.values(), default=0) / w, float((lengths <= 3).sum()) / w, float((lengths >= 12).sum()) / w, upper, symbols, marked, periodic, math.log1p(len(words) / sentences),
    ]


def _measure(batch) -> dict:
    import numpy as np

    rows = np.array([statistics(t.as_py()) for t in batch.column("text")], "float64").reshape(-1, len(FEATURES))
    out = {name: batch.column(name) for name in batch.schema.names if name != "text"}
    return out | {f: rows[:, i] for i, f in enumerate(FEATURES)}


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row) and FEATURES; one narrow pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    return map_arrow(rows, _measure, "doc_id long, key struct<a:long,b:long>, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from. A null id counts as not held out and, having no label, isn't learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (feature, at most?, threshold) and their weights."""

    intercept: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]

    def column(self) -> Column:
        """The probability of label 1 as a Spark expression over FEATURES."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(conjunction(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def conjunction(rule) -> Column:
    out = F.lit(True)
    for feature, at_most, threshold in rule:
        out = out & ((F.col(feature) <= threshold) if at_most else (F.col(feature) > threshold))
    return out


def tree_paths(model) -> list[tuple]:
    """Conjunctions along the paths of a fitted forest, beginnings included, each once."""
    found: dict[tuple, None] = {}

    def walk(node, path):
        if path:
            found[path] = None
        if node.subtreeDepth():
            split = node.split()
            name, threshold = FEATURES[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, True, threshold)))
            walk(node.rightChild(), (*path, (name, False, threshold)))

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


def fit(statistics_table: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Rules:
    """Learns from labelled rows that aren't held out, ``rows`` of them at most.

    With labels of one value only (or none at all) there is nothing to tell apart: no rules, and the share of label 1 as the
    score of all (one half without labels). A document with several labels counts once, with the smallest;
    of several rows of a document the one of the least statistics counts.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # ``rows`` bounds the broadcast, and with one row of a document also what is gathered
    chosen = statistics_table.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct(*FEATURES)).alias("s"))
    # one sorted partition: the forest draws its samples by place, so the same rows give the same rules
    table = written(chosen.select("doc_id", "label", "s.*").repartition(1).sortWithinPartitions("doc_id")).cache()
    n, positive = table.agg(F.count("*"), F.sum("label")).first()
    share = (positive or 0) / n if n else 0.5
    if not n or share in (0.0, 1.0):
        table.unpersist()
        return Rules(_logit(share), [])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.7, maxBins=64, minInstancesPerNode=5).fit(vectors)
    paths = tree_paths(forest)
    if not paths:  # too few rows to split
        table.unpersist()
        return Rules(_logit(share), [])
    ruled = table.select("label", *[conjunction(p).cast("double").alias(f"r{i}") for i, p in enumerate(paths)])
    ruled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="features").transform(ruled)
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(ruled.select("label", "features"))
    table.unpersist()
    return Rules(float(model.intercept), [(p, float(w)) for p, w in zip(paths, model.coefficients.toArray(), strict=True) if w])


def _logit(p: float) -> float:
    import math

    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, key, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if 0.5 or more) of every document.

    Null and empty texts have statistics of zero and are scored like any other. Repeated rows are scored one by one.
    Columns other than doc_id and text aren't read; no rows in, none out.
    """
    table = written(with_statistics(docs))
    rules = fit(table, labels, rows)
    scored = table.select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns. One pass: scoring needs no join."""
    rules = fit(with_statistics(docs.join(F.broadcast(_sampled(labels)), "doc_id", "left_semi")), labels)
    beside = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    schema = T.StructType([beside.schema["__row"], *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    return map_arrow(beside, _measure, schema).where(rules.column() >= threshold).select("__row.*")


def _sampled(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Ids of the rows to learn from; ``rows`` at most, so they can be broadcast."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    return known.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(rows)
