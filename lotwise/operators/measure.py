"""Measurement, offline evaluation, calibration and training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import quantiles

# -- measurement


def rate(df: DataFrame, hit: Column, threshold: float | None = None, least: int = 1, by: list[str] = (), below: bool = True) -> DataFrame:
    """n, value and status of a share: insufficient_data under ``least`` rows, else ok or breach against a threshold."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("value"))
    bad = F.lit(False) if threshold is None else (F.col("value") > threshold if below else F.col("value") < threshold)
    return out.withColumn("status", F.when(F.col("n") < least, "insufficient_data").when(bad, "breach").otherwise("ok"))


def capped_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` over rows of ``b``, 1 at most; NULL without ``b``."""
    counts = a.agg(F.count("*").alias("a")).join(b.agg(F.count("*").alias("b")), F.lit(True))
    return counts.select("a", "b", F.when(F.col("b") > 0, F.least(F.lit(1.0), F.col("a") / F.col("b"))).alias("value"))


def sum_ratio(df: DataFrame, hits: str, misses: str) -> DataFrame:
    total = F.sum(hits) + F.sum(misses)
    return df.agg(F.sum(hits).alias("hits"), total.alias("total"), F.when(total > 0, F.sum(hits) / total).alias("value"))


def served_ndcg(df: DataFrame, lists: list[str], order: list[Column], gain: str, k: int = 10) -> DataFrame:
    """``lists`` and ndcg: the discounted gain of each list's first ``k`` rows as served (by ``order``), over that of its ``k`` greatest gains. Gains count
    as they are, NULL as 0; a list without gain has NULL."""
    value = F.coalesce(F.col(gain).cast("double"), F.lit(0.0))
    rows = df.select(*lists, value.alias("__g"), F.row_number().over(Window.partitionBy(*lists).orderBy(*order)).alias("__i"), F.row_number().over(Window.partitionBy(*lists).orderBy(value.desc())).alias("__j"))
    part = lambda at: F.sum(F.when(F.col(at) <= k, F.col("__g") / F.log2(F.col(at) + 1)))
    both = rows.groupBy(*lists).agg(part("__i").alias("__dcg"), part("__j").alias("__ideal"))
    return both.select(*lists, F.when(F.col("__ideal") > 0, F.col("__dcg") / F.col("__ideal")).alias("ndcg"))


def suite_summary(df: DataFrame, suite: str, query: str, order: list[Column], value: str, gain: str, right: Column, sla: float, k: int = 10) -> DataFrame:
    """Per suite and over all (suite NULL): n, mean, p50, p95, sla (the share of slow rows), routed (the share of ``right`` rows), cost and the mean ndcg of its lists."""
    v = F.col(value)
    out = df.rollup(F.col(suite).alias("suite")).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg((v > sla).cast("double")).alias("sla"), F.avg(right.cast("double")).alias("routed"), (F.sum(v) / 1000).alias("cost"))
    both = lambda rows: rows.select(F.col(suite).alias("suite"), F.lit(0).alias("level"), v).unionByName(rows.select(F.lit(None).alias("suite"), F.lit(1).alias("level"), v))
    qs = quantiles.grouped(both(df), ["suite", "level"], value, {"p50": 0.5, "p95": 0.95}, "linear").drop("n")
    ndcg = served_ndcg(df, [suite, query], order, gain, k).rollup(F.col(suite).alias("suite")).agg(F.grouping_id().alias("level"), F.avg("ndcg").alias("ndcg"))
    for more in (qs, ndcg):
        more = F.broadcast(more.withColumnsRenamed({"suite": "__suite", "level": "__level"}))  # one row for each suite
        out = out.join(more, out["suite"].eqNullSafe(more["__suite"]) & (out["level"] == more["__level"]), "left").drop("__suite", "__level")
    return out.drop("level")


def latency(df: DataFrame, value: str, qs: dict[str, float], by: list[str] = ()) -> DataFrame:
    return quantiles.grouped(df, list(by), value, qs, "nearest_rank")


def signals_per_day(df: DataFrame, ts: str) -> DataFrame:
    span = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    return df.agg(F.count("*").alias("n"), F.when(span > 0, F.count("*") * 86400 / span).alias("per_day"))


def followups(df: DataFrame, session: str, ts: str, first: Column, then: Column, seconds: int) -> DataFrame:
    """n, followed, value: rows of ``first`` with one of ``then`` in the same session within (t, t + seconds]."""
    a = df.where(first).select(F.col(session).alias("s"), F.col(ts).alias("t"), F.monotonically_increasing_id().alias("id"))
    b = df.where(then).select(F.col(session).alias("s2"), F.col(ts).alias("t2"))
    near = (F.col("s") == F.col("s2")) & (F.col("t2") > F.col("t")) & (F.col("t2") <= F.col("t") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    met = a.join(b, near, "left_semi").agg(F.count("*").alias("followed"))
    return a.agg(F.count("*").alias("n")).join(met, F.lit(True)).withColumn("value", F.when(F.col("n") > 0, F.col("followed") / F.col("n")))


#: Seconds of a slice of time in running sums and rolling windows: a task holds one slice.
SLICE_S = 3600


def _before(slices: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """Per slice what ``columns`` (windows over earlier slices) say. One row per slice, so the window is short."""
    earlier = Window.partitionBy(*by).orderBy("__slice")
    return slices.select(*by, "__slice", *[c.over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, c in columns.items()])


def running_sums(df: DataFrame, ts: str, columns: list[str], by: list[str] = (), slice_s: int = SLICE_S) -> DataFrame:
    """``columns`` as sums of all rows up to each row in order of time, without one sorted partition: sums within slices of time and what the slices
    before add up to. Rows of one instant are in the order of their ``columns``."""
    by = list(by)
    rows = df.withColumn("__slice", F.floor(F.unix_timestamp(ts) / slice_s))
    totals = rows.groupBy(*by, "__slice").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    before = _before(totals, by, {f"__b_{c}": F.sum(f"__t_{c}") for c in columns})
    upto = Window.partitionBy(*by, "__slice").orderBy(ts, *columns).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(before, [*by, "__slice"])
    return rows.withColumns({c: F.coalesce(F.col(f"__b_{c}"), F.lit(0)) + F.sum(c).over(upto) for c in columns}).drop("__slice", *[f"__b_{c}" for c in columns])


def miss_storm(df: DataFrame, ts: str, hits: str, misses: str, seconds: int = 300, floor: float = 0.5, by: list[str] = (), slice_s: int = SLICE_S) -> DataFrame:
    """Rolling hit rate from cumulative counters (a fall is a reset: no delta), breach state and its edges.

    Time is cut into slices. A slice gets the last row before it from the slices' own last rows, and the rows of the ``seconds`` before it as
    copies, so no task orders the whole table.
    """
    by, slice_s = list(by), max(slice_s, seconds)
    own, place = Window.partitionBy(*by, "__slice"), F.floor(F.unix_timestamp(ts) / slice_s)
    rows = df.withColumn("__slice", place)
    ends = rows.groupBy(*by, "__slice").agg(F.max(F.struct(ts, F.col(hits).alias("h"), F.col(misses).alias("m"))).alias("__e")).select(*by, "__slice", F.col("__e.h").alias("__h"), F.col("__e.m").alias("__m"))
    before = _before(ends, by, {"__bh": F.last("__h"), "__bm": F.last("__m")})
    rows = rows.join(before, [*by, "__slice"])
    delta = lambda c, b: F.greatest(F.coalesce(F.col(c) - F.coalesce(F.lag(c).over(own.orderBy(ts, hits, misses)), F.col(b)), F.lit(0)), F.lit(0))
    rows = rows.withColumn("__dh", delta(hits, "__bh")).withColumn("__dm", delta(misses, "__bm")).withColumn("__t", F.unix_timestamp(ts)).drop("__bh", "__bm")
    into = F.when(F.col("__t") >= (F.col("__slice") + 1) * slice_s - seconds, F.array("__slice", F.col("__slice") + 1)).otherwise(F.array("__slice"))
    rows = rows.withColumn("__home", F.col("__slice")).withColumn("__slice", F.explode(into))
    span = own.orderBy("__t").rangeBetween(-seconds, 0)
    rows = rows.withColumn("__hs", F.sum("__dh").over(span)).withColumn("__ms", F.sum("__dm").over(span)).where(F.col("__home") == F.col("__slice"))
    total = F.col("__hs") + F.col("__ms")
    rows = rows.withColumn("hit_rate", F.when(total > 0, F.col("__hs") / total)).withColumn("breached", F.coalesce(F.col("hit_rate") < floor, F.lit(False)))
    last = _before(rows.groupBy(*by, "__slice").agg(F.max_by("breached", ts).alias("__x")), by, {"__was": F.last("__x")})
    rows = rows.join(last, [*by, "__slice"])
    was = F.coalesce(F.lag("breached").over(own.orderBy(ts)), F.col("__was"), F.lit(False))
    edge = F.when(F.col("breached") & ~was, "start").when(~F.col("breached") & was, "end")
    return rows.withColumn("edge", edge).select(*df.columns, "hit_rate", "breached", "edge")


def cost_buckets(df: DataFrame, ts: str, cost: str, grain: str, cap: float) -> DataFrame:
    """Spend per bucket, the sum so far within the day, and whether the bucket is over its cap."""
    per = df.groupBy(F.date_trunc(grain, ts).alias("bucket")).agg(F.sum(cost).alias("spend"))
    day = Window.partitionBy(F.to_date("bucket")).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("so_far", F.sum("spend").over(day)).withColumn("over", F.col("spend") > cap)


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value) against limits: pass or fail; a missing value is skipped."""
    out = F.lit(None).cast("string")
    for name, (op, limit) in limits.items():
        fine = F.col("value") <= limit if op == "<=" else F.col("value") >= limit
        out = F.when(F.col("metric") == name, F.when(F.col("value").isNull(), "skip").when(fine, "pass").otherwise("fail")).otherwise(out)
    return metrics.withColumn("gate", F.coalesce(out, F.lit("none")))


# -- evaluation


def ranking_metrics(ranked: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """query_id, dcg, ndcg, precision, recall, mrr at ``k``: ranked (query_id, item, rank), gains (query_id, item, gain).

    Gains count as 2**g - 1 over log2(rank + 1); an item without a gain has 0; queries with no relevant item have ndcg and recall NULL.
    """
    g = gains.where("gain > 0")
    j = ranked.where(F.col("rank") <= k).join(g, ["query_id", "item"], "left")
    worth = (F.pow(F.lit(2.0), F.coalesce("gain", F.lit(0))) - 1) / F.log2(F.col("rank") + 1)
    got = j.groupBy("query_id").agg(F.sum(worth).alias("dcg"), F.count("gain").alias("hits"), F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "item")
    placed = g.withColumn("r", F.row_number().over(order))
    ideal = placed.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("r") + 1))).alias("idcg"), F.count("*").alias("relevant"))
    out = got.join(ideal, "query_id", "left")
    return out.select("query_id", "dcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).alias("ndcg"), (F.col("hits") / k).alias("precision"), F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def holdout(key: Column, stratum: Column, share: float, seed: str = "0") -> Column:
    """md5(seed|stratum|key): its first 32 bits over 2**32 - 1 below ``share``."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), stratum, key)), 1, 8), 16, 10).cast("double")
    return h / 0xFFFFFFFF < share


def set_agreement(df: DataFrame, a: str, b: str, drops_a: str | None = None, drops_b: str | None = None) -> DataFrame:
    """n, exact and jaccard of two set columns; with drops (sets that a side is known to have left out) also ``restored``: the share that is equal once each
    side has back what it dropped and the other still has."""
    same = lambda x, y: F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y))
    either = F.size(F.array_union(a, b))
    jac = F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(1.0)
    back = []
    if drops_a or drops_b:
        give = lambda own, other, drops: F.array_union(own, F.array_intersect(F.array_except(other, own), drops)) if drops else F.col(own)
        back = [F.avg(same(give(a, b, drops_a), give(b, a, drops_b)).cast("double")).alias("restored")]
    return df.agg(F.count("*").alias("n"), F.avg(same(F.col(a), F.col(b)).cast("double")).alias("exact"), F.avg(jac).alias("jaccard"), *back)


def all_agree(df: DataFrame, sets: list[str]) -> DataFrame:
    """n and the share of rows in which all of several set columns are equal."""
    plain = [F.array_sort(F.array_distinct(c)) for c in sets]
    return df.agg(F.count("*").alias("n"), F.avg(reduce(lambda x, y: x & y, [plain[0] == p for p in plain[1:]]).cast("double")).alias("exact"))


def missing_extra(df: DataFrame, gold: str, got: str, top: int = 10) -> DataFrame:
    both = df.select(F.explode(F.array_except(gold, got)).alias("token"), F.lit("missing").alias("kind")).unionByName(df.select(F.explode(F.array_except(got, gold)).alias("token"), F.lit("extra").alias("kind")))
    counts = both.groupBy("kind", "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "token")
    return counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)


def abstain(df: DataFrame, gold: str, got: str) -> DataFrame:
    both = F.size(F.array_intersect(gold, got))
    return df.agg(F.avg((F.size(got) == 0).cast("double")).alias("abstain_rate"), F.avg(((F.size(got) > 0) & (both == 0)).cast("double")).alias("false_rate"), (F.sum(both) / F.sum(F.size(got))).alias("precision"), (F.sum(both) / F.sum(F.size(gold))).alias("recall"))


def false_terms(df: DataFrame, gold: str, got: str, top: int = 20) -> DataFrame:
    """The commonest terms of ``got`` in rows where nothing was to be said (``gold`` is empty); ties by term."""
    counts = df.where(F.size(gold) == 0).select(F.explode(F.array_distinct(got)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(top)


def compliance(results: DataFrame, rules: DataFrame) -> DataFrame:
    """results (query_id, item, field, value), rules (query_id, field, op, arg): the pass rate of each rule; NULL values fail."""
    j = rules.join(results, ["query_id", "field"])
    v, arg = F.col("value"), F.col("arg")
    num = lambda c: c.try_cast("double")
    ok = F.when(F.col("op") == "eq", v == arg).when(F.col("op") == "lte", num(v) <= num(arg)).when(F.col("op") == "gte", num(v) >= num(arg)).when(F.col("op") == "in", F.array_contains(F.split(arg, ","), v)).when(F.col("op") == "starts_with_any", F.exists(F.split(arg, ","), lambda p: v.startswith(p)))
    return j.groupBy("query_id", "field", "op").agg(F.count("*").alias("n"), F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("pass_rate"))


# -- calibration


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def temperature(df: DataFrame, p: str, correct: str, low: float = 0.25, high: float = 4.0, steps: int = 61) -> DataFrame:
    """The temperature of the least negative log-likelihood on an even grid: one pass, one sum per grid point; 1 if all answers agree."""
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    y, z = F.col(correct).cast("double"), _logit(F.col(p))

    def loss(t: float) -> Column:
        s = 1 / (1 + F.exp(-z / t))
        s = F.least(F.greatest(s, F.lit(1e-12)), F.lit(1 - 1e-12))
        return F.avg(-(y * F.ln(s) + (1 - y) * F.ln(1 - s)))

    fit = df.agg(F.count("*").alias("n"), F.avg(y).alias("share"), F.array(*[F.struct(F.round(loss(t), 9).alias("nll"), F.lit(t).alias("t")) for t in grid]).alias("g"))
    best = F.array_min("g")
    flat = (F.col("n") == 0) | F.col("share").isin(0.0, 1.0)
    return fit.select("n", F.when(flat, 1.0).otherwise(best["t"]).alias("temperature"), best["nll"].alias("nll"))


def ece(df: DataFrame, p: str, correct: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def entropy(scores: Column) -> Column:
    """Of the softmax of a score vector, over its greatest value: 0 for one peak (or fewer than two scores), 1 for equal scores."""
    # bound once, in a cell of its own: used inside a lambda it would be found anew for each score
    shifted = F.element_at(F.transform(F.array(F.array_max(scores)), lambda best: F.transform(scores, lambda x: x - best)), 1)
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s"))
    # with t the sum of e**z and s that of z * e**z, the entropy is ln t - s / t
    add = lambda a, z: F.struct((a["t"] + F.exp(z)).alias("t"), (a["s"] + F.when(F.exp(z) > 0, F.exp(z) * z).otherwise(0.0)).alias("s"))
    h = F.aggregate(shifted, start, add, lambda a: F.ln(a["t"]) - a["s"] / a["t"])
    return F.when(F.size(scores) >= 2, F.least(F.greatest(h / F.ln(F.size(scores)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


# The intercept of a probe that says nothing (its answer is 1), and the slope.
PROBE_IDENTITY, PROBE_SLOPE = 30.0, 4.0


def probe(h: Column, beta: Column, alpha: float = PROBE_SLOPE) -> Column:
    """The chance of a right answer from a normalised entropy: sigmoid(alpha * (1 - h) + beta)."""
    return 1 / (1 + F.exp(-(alpha * (1 - h) + beta)))


def fit_probe(df: DataFrame, h: str, correct: str, by: list[str] = (), alpha: float = PROBE_SLOPE, low: float = -8.0, high: float = 8.0, steps: int = 161, least: int = 20) -> DataFrame:
    """n, accuracy, beta, before and after: the intercept of the least negative log-likelihood on an even grid, in one pass, with the loss at 0 and
    at it; the identity's intercept and no losses under ``least`` rows."""
    y, grid = F.col(correct).cast("double"), [low + (high - low) * i / (steps - 1) for i in range(steps)]

    def loss(b: float) -> Column:
        p = F.least(F.greatest(probe(F.col(h), F.lit(b), alpha), F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))

    fit = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("accuracy"), loss(0.0).alias("zero"), F.array(*[F.struct(F.round(loss(b), 9).alias("nll"), F.lit(b).alias("b")) for b in grid]).alias("g"))
    best, enough = F.array_min("g"), F.col("n") >= least
    return fit.select(*by, "n", "accuracy", F.when(enough, best["b"]).otherwise(PROBE_IDENTITY).alias("beta"), F.when(enough, F.col("zero")).alias("before"), F.when(enough, best["nll"]).alias("after"))


def combine(a: Column, b: Column, w: float) -> Column:
    """The weighted geometric mean of two probabilities."""
    return F.exp(w * F.ln(F.greatest(a, F.lit(1e-9))) + (1 - w) * F.ln(F.greatest(b, F.lit(1e-9))))


# -- training data


def harvest(signals: DataFrame, seen: DataFrame, label: str, text: str, ts: str, as_of, days: int, cap: int, ring: int, floor: int) -> DataFrame:
    """New texts of the last days, once per label and normalised text, ``cap`` per label, none that was seen, the newest ``ring`` of all;
    labels with fewer than ``floor`` are held back."""
    norm = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    recent = signals.where((F.col(ts) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= F.lit(as_of))).withColumn("norm", norm)
    newest = [F.desc(ts), F.col(text), *[F.col(c) for c in signals.columns if c not in (ts, text, label)]]  # ties by the other columns
    once = recent.withColumn("k", F.row_number().over(Window.partitionBy(label, "norm").orderBy(*newest))).where("k = 1").drop("k")
    new = once.join(seen.select(F.lower(F.trim(F.regexp_replace(F.col("text"), r"\s+", " "))).alias("norm")), "norm", "left_anti")
    few = new.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(*newest))).where(F.col("k") <= cap).drop("k")
    held = few.orderBy(*newest, label).limit(ring)
    enough = held.groupBy(label).count().where(F.col("count") >= floor).select(label)
    return held.join(enough, label, "left_semi").drop("norm")


def hard_negatives(items: DataFrame, subcentroids: DataFrame, threshold: float) -> DataFrame:
    """(id, label, v) whose best cosine to another class's (label, centroid) is above the threshold; a class may have several. Centroids are a bounded model."""
    from .vectors import best_centroids

    best = best_centroids(items.select("id", "label", "v"), subcentroids, "label", "v", 1, threshold, own="label").where(F.size("near") > 0)
    return best.select("id", "label", F.col("near")[0]["label"].alias("other"), F.col("near")[0]["score"].alias("score"))


def centroid_candidate(vectors: DataFrame, old: DataFrame, floor: int) -> DataFrame:
    """Agreement of new and old centroids on each vector's label, for classes of ``floor`` vectors or more."""
    from .sizes import small
    from .vectors import centroids, nearest_centroid

    big = vectors.groupBy("label").count().where(F.col("count") >= floor).select("label")
    kept = vectors.join(small(big), "label", "left_semi")
    new = nearest_centroid(vectors.select("id", "v"), centroids(kept, "label", "v"), "label", "v", "id", -1.0)
    was = nearest_centroid(vectors.select("id", "v"), old, "label", "v", "id", -1.0).select("id", F.col("label").alias("was"))
    agreed = new.join(was, "id").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("was")).cast("double")).alias("agreement"))
    return agreed.withColumn("verdict", F.when(F.col("agreement") >= 0.9, "promote").otherwise("hold"))


def softmax_head(rows: DataFrame, label: str, v: str, id_col: str, l2: float = 0.01, held: Column | None = None) -> DataFrame:
    """A multinomial logistic head by MLlib: each row's own and predicted label; rows that are ``held`` aren't learnt from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    table = rows.select(id_col, F.col(label).cast("double").alias("label"), array_to_vector(F.transform(v, lambda x: x.cast("double"))).alias("features"), (F.lit(False) if held is None else held).alias("held"))
    model = LogisticRegression(family="multinomial", regParam=l2, maxIter=50).fit(table.where("NOT held"))
    return model.transform(table).select(id_col, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"), "held")


def class_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, n, precision, recall and f1 of each class that is there or was predicted; 0 where there is nothing to divide by."""
    sides = df.select(F.col(label).alias("label"), F.lit(1).alias("own"), F.lit(0).alias("said"), (F.col(label) == F.col(predicted)).cast("int").alias("hit"))
    sides = sides.unionByName(df.select(F.col(predicted).alias("label"), F.lit(0).alias("own"), F.lit(1).alias("said"), F.lit(0).alias("hit")))
    sums = sides.groupBy("label").agg(F.sum("own").alias("n"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.select("label", "n", part("hit", "said").alias("precision"), part("hit", "n").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def stratified_split(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """Per class the rows whose hash is below ``share`` held out, and the one of the smallest hash in any case. A row's side depends on its key alone,
    but for that one, so nothing is sorted."""
    hashed = df.withColumn("__h", F.struct(F.md5(F.col(key).cast("string")).alias("h"), F.col(key).alias("k")))
    least = hashed.groupBy(F.col(label).alias("__l")).agg(F.min("__h").alias("__least"))
    unit = F.conv(F.substring("__h.h", 1, 8), 16, 10).cast("double") / 0xFFFFFFFF
    joined = hashed.join(least, F.col(label).eqNullSafe(F.col("__l")))
    return joined.withColumn("held_out", (unit < share) | (F.col("__h") == F.col("__least"))).select(*df.columns, "held_out")


def forget(df: DataFrame, user: str, who: DataFrame) -> DataFrame:
    return df.join(who.select(user), user, "left_anti")


def retention(df: DataFrame, user: str, ts: str, newest: int, as_of, days: int, opted_out: DataFrame) -> DataFrame:
    """The newest rows of each user inside the window, ties by the other columns; those who opted out have none."""
    rows = forget(df, user, opted_out).where(F.col(ts) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), *[F.col(c) for c in df.columns if c not in (user, ts)]))).where(F.col("__k") <= newest).drop("__k")
