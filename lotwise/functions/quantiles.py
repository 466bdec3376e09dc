"""Three conventions of exact quantiles, never mixed.

``element``: the value at place floor(q * n) from 0, the last for q = 1. ``nearest_rank``: at ceil(q * n) from 1. ``linear``: between
the two values about place q * (n - 1), as Spark's ``percentile``.

All count values first, so a group is its distinct values. A group of up to ``RANGE`` of them is sorted by one task. In a larger one the
places are narrowed down: a sketch cuts the values into ranges, the counts of the ranges say which one holds a
place, and that range is cut again, until it is small enough to be sorted. So no task sorts, and no
buffer holds, more than ``RANGE`` values, and two rounds reach a place among a billion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.sizes import small
from lotwise.sources.sinks import stored

#: Distinct values of a group that one task sorts, and ranges that a sketch cuts a larger group into.
RANGE, CUTS = 500_000, 32


def _places(q: float, n: Column, rule: str) -> list[Column]:
    """The places, from 0, whose values the quantile is made of."""
    if rule == "element":
        return [F.least(F.floor(F.lit(q) * n), n - 1)]
    if rule == "nearest_rank":
        return [F.greatest(F.ceil(F.lit(q) * n), F.lit(1)) - 1]
    return [F.floor(F.lit(q) * (n - 1)), F.ceil(F.lit(q) * (n - 1))]


def _value(q: float, n: Column, found: list[Column], rule: str) -> Column:
    if rule != "linear":
        return found[0]
    place = F.lit(q) * (n - 1)
    low, high = (c.cast("double") for c in found)
    return low + (high - low) * (place - F.floor(place))


def _meet(rows: DataFrame, told: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys whose NULLs are equal."""
    for k in keys:
        told = told.withColumnRenamed(k, f"__r_{k}")
    on = [rows[k].eqNullSafe(told[f"__r_{k}"]) for k in keys]
    out = rows.join(small(told), on, how)
    return out if how == "left_anti" else out.drop(*[f"__r_{k}" for k in keys])


def _sorted(counts: DataFrame, keys: list[str], qs: dict[str, float], rule: str) -> DataFrame:
    """Groups that one task may sort."""
    upto = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("__to", F.sum("__c").over(upto)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    at = lambda place: F.min(F.when(F.col("__to") > place, F.col("__v")))
    n = F.max("__n")
    return placed.groupBy(*keys).agg(n.alias("n"), *[_value(q, n, [at(p) for p in _places(q, F.col("__n"), rule)], rule).alias(name) for name, q in qs.items()])


def _held(rows: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """Counts in the range that their group's state still looks at."""
    inside = F.col("__lo").isNull() | F.col("__v").between(F.col("__lo"), F.col("__hi"))
    return _meet(rows, states, by).where(inside)


def narrowed(counts: DataFrame, keys: list[str], states: DataFrame, limit: int | None = None) -> DataFrame:
    """``states`` (keys, __q, __k: a place from 0, __lo and __hi: the range that holds it, NULL for all, __d: its distinct values) after rounds of
    cutting: every range has ``limit`` values at most, and the place counts from its start."""
    limit = limit or RANGE
    by, worst = [*keys, "__q"], None
    while True:
        most = states.agg(F.max("__d")).first()[0] or 0
        if most <= limit or (worst is not None and most >= worst):
            return states
        worst = most
        wide = states.where(F.col("__d") > limit)
        cuts = _held(counts, wide, keys).groupBy(*by).agg(F.percentile_approx("__v", [i / CUTS for i in range(1, CUTS)], 10_000).alias("__cuts"), *[F.first(c, ignorenulls=True).alias(c) for c in ("__k", "__lo", "__hi")])
        part = F.size(F.filter("__cuts", lambda x: x < F.col("__v")))
        parts = _held(counts, stored(cuts, "cuts"), keys).groupBy(*by, part.alias("__p")).agg(F.sum("__c").alias("__c"), F.count("*").alias("__d"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.first("__k").alias("__k"))
        before = F.sum("__c").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")  # of CUTS rows
        chosen = parts.withColumn("__b", before).where((F.col("__k") >= F.col("__b")) & (F.col("__k") < F.col("__b") + F.col("__c")))
        states = stored(states.where(F.col("__d") <= limit).unionByName(chosen.withColumn("__k", F.col("__k") - F.col("__b")).select(*states.columns)), "states")


def _selected(counts: DataFrame, keys: list[str], sizes: DataFrame, qs: dict[str, float], rule: str) -> DataFrame:
    """Groups that are too large for one task."""
    kind = counts.schema["__v"].dataType
    wanted = F.explode(F.array(*[F.struct(F.lit(f"{name}#{i}").alias("q"), p.cast("long").alias("k")) for name, q in qs.items() for i, p in enumerate(_places(q, F.col("__n"), rule))]))
    states = sizes.select(*keys, "__d", wanted.alias("w")).select(*keys, F.col("w.q").alias("__q"), F.col("w.k").alias("__k"), F.lit(None).cast(kind).alias("__lo"), F.lit(None).cast(kind).alias("__hi"), "__d")
    last = _held(counts, narrowed(counts, keys, states), keys)
    upto = Window.partitionBy(*keys, "__q").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = last.withColumn("__to", F.sum("__c").over(upto)).where(F.col("__to") > F.col("__k")).groupBy(*keys, "__q").agg(F.min("__v").alias("__v"))
    at = lambda name, i: F.max(F.when(F.col("__q") == f"{name}#{i}", F.col("__v")))
    n = F.max("__n")
    both = range(2 if rule == "linear" else 1)
    return _meet(found, sizes.drop("__d"), keys).groupBy(*keys).agg(n.alias("n"), *[_value(q, n, [at(name, i) for i in both], rule).alias(name) for name, q in qs.items()])


def grouped(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], rule: str = "element", whole: str | None = None) -> DataFrame:
    """``keys``, n and one column for each of ``qs``; NULL values don't count, NULL keys are a group; groups without values have no row.

    ``whole``: with one key, a further group of that name is all rows. It takes the counts of the other groups, so rows are counted once and
    a value may have a row for each of these.
    """
    by = keys or ["__all"]
    rows = df if keys else df.withColumn("__all", F.lit(0))
    counts = stored(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c")), "counts")
    if whole is not None:
        (key,) = by
        counts = counts.withColumn(key, F.explode(F.array(key, F.lit(whole))))
    sizes = counts.groupBy(*by).agg(F.count("*").alias("__d"), F.sum("__c").alias("__n")).where(F.col("__d") > RANGE)
    if sizes.isEmpty():
        return _sorted(counts, by, qs, rule).drop("__all")
    sizes = stored(sizes, "sizes")
    return _sorted(_meet(counts, sizes, by, "left_anti"), by, qs, rule).unionByName(_selected(counts, by, sizes, qs, rule)).drop("__all")
