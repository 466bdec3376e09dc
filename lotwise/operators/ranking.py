"""Ranked lists: fusion, boosts, diversification, votes. Rows are (query_id, item, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = 60, top: int = 150) -> DataFrame:
    """(query_id, source, item, score) fused by reciprocal ranks; ties by item."""
    placed = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "item")))
    w = F.lit(1.0)
    for source, weight in (weights or {}).items():
        w = F.when(F.col("source") == source, weight).otherwise(w)
    fused = placed.groupBy("query_id", "item").agg(F.sum(w / (k + F.col("r"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "item")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def slice_max(lists: DataFrame, bonus: float = 0.1) -> DataFrame:
    """The best score of an item over slices, raised where two or more hold it."""
    out = lists.groupBy("query_id", "item").agg(F.max("score").alias("best"), F.countDistinct("source").alias("slices"))
    return out.select("query_id", "item", (F.col("best") * F.when(F.col("slices") >= 2, 1 + bonus).otherwise(1.0)).alias("score"), "slices")


def dbsf(lists: DataFrame) -> DataFrame:
    """Fusion of scores scaled to three deviations about each source's mean."""
    w = Window.partitionBy("query_id", "source")
    lo, hi = F.avg("score").over(w) - 3 * F.stddev_pop("score").over(w), F.avg("score").over(w) + 3 * F.stddev_pop("score").over(w)
    scaled = lists.withColumn("s", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.5))
    return scaled.groupBy("query_id", "item").agg(F.sum("s").alias("score"))


def mmr(lists: DataFrame, penalty: float = 0.5, head: int = 50) -> DataFrame:
    """Greedy maximal marginal relevance by token overlap over each query's first ``head`` rows; the rest keep their order.

    lists: query_id, item, rank, tokens. A query's group is its head only, so it is bounded; adds ``new_rank``.
    """
    front, rest = lists.where(F.col("rank") <= head), lists.where(F.col("rank") > head)

    def choose(pdf):
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        sets = [set(t) for t in pdf["tokens"]]
        base = [1 / (1 + r) for r in pdf["rank"]]
        near, left, order = [0.0] * len(sets), list(range(len(sets))), []
        while left:
            best = max(left, key=lambda i: ((1 - penalty) * base[i] - penalty * near[i], -i))
            order.append(best)
            left.remove(best)
            for i in left:
                either = len(sets[i] | sets[best])
                near[i] = max(near[i], len(sets[i] & sets[best]) / either if either else 0.0)
        out = pdf.iloc[order][["query_id", "item", "rank"]].copy()
        out["new_rank"] = range(1, len(out) + 1)
        return out

    types = dict(lists.dtypes)
    schema = f"query_id {types['query_id']}, item {types['item']}, rank int, new_rank int"
    picked = front.groupBy("query_id").applyInPandas(choose, schema)
    return picked.unionByName(rest.select("query_id", "item", F.col("rank").cast("int").alias("rank"), F.col("rank").cast("int").alias("new_rank")))


# What full coverage adds to a score.
FUZZY_BOOST = 0.5


def fuzzy(lists: DataFrame, query_tokens: Column, item_tokens: Column, boost: float = FUZZY_BOOST) -> DataFrame:
    """Adds ``coverage`` of the query's tokens by the item's and ``reranked``, the score raised by it, and orders each query's list anew."""
    from .text import coverage

    out = coverage(lists, query_tokens, item_tokens).withColumn("reranked", F.col("score") + boost * F.col("coverage"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("reranked", 9)), "item")))


# The vowel share, lengths, consonant run and penalties of a brandable label, and what the score adds to a rank.
BRANDABLE = {"vowels": 0.4, "shortest": 3, "longest": 15, "consonants": 3, "digit": 0.3, "hyphen": 0.3, "boost": 0.25}


def brandability(label: Column) -> Column:
    """0 to 1: the mean of three marks (short, vowels in balance, no long run of consonants), less a penalty if there is a digit and
    one if there is a hyphen. An empty label has 0; one without letters has the mark of its length alone."""
    b, low, none, one = BRANDABLE, F.lower(label), F.lit(0.0), F.lit(1.0)
    unit = lambda x: F.greatest(none, F.least(one, x))
    letters = F.regexp_replace(low, r"[^\p{L}]", "")
    n = F.length(letters)
    vowels = F.length(F.regexp_replace(letters, "[^aeiou]", "")) / n
    run = F.array_max(F.transform(F.split(letters, "[aeiou]"), lambda x: F.length(x)))
    short = unit(1 - (F.length(low) - b["shortest"]) / (b["longest"] - b["shortest"]))
    balance = F.when(n > 0, unit(1 - F.abs(vowels - b["vowels"]) / b["vowels"])).otherwise(none)
    said = F.when(n > 0, unit(1 - F.greatest(run - b["consonants"], F.lit(0)) / n)).otherwise(none)
    cost = F.when(low.rlike(r"\d"), b["digit"]).otherwise(none) + F.when(F.contains(low, F.lit("-")), b["hyphen"]).otherwise(none)
    return F.when(F.length(low) > 0, unit((short + balance + said) / 3 - cost)).otherwise(none)


def brandable_boost(score: Column, label: Column) -> Column:
    return score * (1 + BRANDABLE["boost"] * brandability(label))


def engagement(score: Column, signals: list[tuple[Column, float]], weight: float = 0.30) -> Column:
    """score * (1 + weight * the sum of signals, each scaled by its cap to 0..1): weights .35, .15, .30, .20."""
    shares = (0.35, 0.15, 0.30, 0.20)
    mix = sum(w * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(s.cast("double"), F.lit(0.0)) / cap)) for w, (s, cap) in zip(shares, signals, strict=False))
    return score * (1 + weight * mix)


def soft_keywords(df: DataFrame, keywords: Column, tokens: Column, score: str, weight: float = 0.2) -> DataFrame:
    """Adds precision, recall, f1 of wanted keywords (array of struct(term, p)) in tokens and the raised score."""
    hits = F.filter(keywords, lambda k: F.array_contains(tokens, k["term"]))
    mass = F.aggregate(hits, F.lit(0.0), lambda s, k: s + k["p"])
    recall = F.when(F.size(keywords) > 0, F.size(hits) / F.size(keywords)).otherwise(0.0)
    precision = F.when(F.size(tokens) > 0, F.size(hits) / F.size(tokens)).otherwise(0.0)
    out = df.withColumn("recall", recall).withColumn("precision", precision)
    f1 = F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)
    out = out.withColumn("f1", f1)
    return out.withColumn("boosted", F.col(score) + weight * mass * (0.5 + 0.5 * F.col("f1")))


def complement(lists: DataFrame, key: str, leanings: DataFrame, cap: float = 0.2, w_g: float = 0.6, w_a: float = 0.4) -> DataFrame:
    """score + cap * (w_g * g + w_a * a) by key, ranked anew; unknown keys add nothing. ``leanings`` is a dimension: key, g, a."""
    out = lists.join(leanings, key, "left").withColumn("score", F.col("score") + cap * (w_g * F.coalesce("g", F.lit(0.0)) + w_a * F.coalesce("a", F.lit(0.0)))).drop("g", "a")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item")))


def keyword_threshold(keywords: Column, floor: float) -> Column:
    return F.filter(keywords, lambda k: (F.trim(k["term"]) != "") & (k["p"] >= floor))


def ensemble(votes: DataFrame, veto: str | None = None) -> DataFrame:
    """(item, voter, label, weight, confidence): the label of the largest weighted sum, its share, mean confidence and band; a voter named
    ``veto`` overrides with a confidence of 0.9 or more."""
    tally = votes.groupBy("item", "label").agg(F.sum(F.col("weight") * F.col("confidence")).alias("mass"), F.count("*").alias("n"))
    best = tally.groupBy("item").agg(F.min_by("label", F.struct((-F.round("mass", 9)).alias("d"), F.col("label"))).alias("label"), F.max_by("n", F.struct(F.round("mass", 9).alias("d"), F.col("label"))).alias("__n"))
    every = votes.groupBy("item").agg(F.count("*").alias("voters"), F.avg("confidence").alias("confidence"), F.max(F.when((F.col("voter") == veto) & (F.col("confidence") >= 0.9), F.col("label"))).alias("__veto"))
    out = every.join(best, "item").withColumn("label", F.coalesce("__veto", "label"))
    agreed = votes.join(out.select("item", F.col("label").alias("chosen")), "item").groupBy("item").agg(F.avg((F.col("label") == F.col("chosen")).cast("double")).alias("agreement"))
    band = F.when(F.col("agreement") >= 0.8, "direct").when(F.col("agreement") >= 0.5, "review").otherwise("fallback")
    return out.drop("__n", "__veto").join(agreed, "item").withColumn("band", band)
