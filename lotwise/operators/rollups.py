"""Mergeable rollups: aggregate states in columns, re-aggregated to coarser grains, and chosen by what they hold.

A rollup keeps count, sum, min and max of each metric, a KLL sketch for its median, HLL sketches for distinct counts and sketches of
frequent items. Any subset of its dimensions and any coarser time grain follows from it by merging; a question over a range of time is cut
into whole months, days and hours, each answered from its own rollup.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.times import bucket

_FINER = {"hour": {"hour", "day", "week", "monday", "month"}, "day": {"day", "week", "monday", "month"}, "week": {"week"}, "monday": {"monday"}, "month": {"month"}}


#: Items that a sketch of frequent items tracks. With more different ones a count may be off by 2.7 / TRACKED of all rows; up to three quarters of it none is.
TRACKED = 4096


def build(df: DataFrame, time: str, grain: str, dims: list[str], metrics: list[str], where: Column | None = None, medians: list[str] = (), uniques: list[str] = (), frequent: list[str] = ()) -> DataFrame:
    """States per dims and period."""
    rows = df if where is None else df.where(where)
    aggs = [F.count("*").alias("n")]
    for m in metrics:
        aggs += [F.count(m).alias(f"{m}__count"), F.sum(m).cast("double").alias(f"{m}__sum"), F.min(m).alias(f"{m}__min"), F.max(m).alias(f"{m}__max")]
    aggs += [F.kll_sketch_agg_double(F.col(m).cast("double")).alias(f"{m}__kll") for m in medians]
    aggs += [F.hll_sketch_agg(u).alias(f"{u}__hll") for u in uniques]
    aggs += [F.expr(f"approx_top_k_accumulate(`{c}`, {TRACKED})").alias(f"{c}__top") for c in frequent]
    return rows.groupBy(*dims, bucket(F.col(time), grain).alias("period")).agg(*aggs)


def _combined(state: str) -> Column:
    return F.expr(f"approx_top_k_combine(`{state}`)")


def frequent(states: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """``keys``, value, n, rank: the ``k`` most frequent items that merged states hold, ties to the smaller value. A state's items are few, so the order is
    made from their estimates alone."""
    held = states.select(*keys, F.explode(F.expr(f"approx_top_k_estimate(`{item}__top`, {TRACKED})")).alias("x")).select(*keys, F.col("x.item").alias("value"), F.col("x.count").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge(states: DataFrame, dims: list[str], grain: str | None = None) -> DataFrame:
    """The same states at fewer dimensions and, with ``grain``, coarser periods; without it over all time."""
    keys = [*dims, *([bucket(F.col("period"), grain).alias("period")] if grain else [])]
    aggs = [F.sum("n").alias("n")]
    for c in states.columns:
        kind = c.rpartition("__")[2]
        f = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "kll": F.kll_merge_agg_double, "hll": F.hll_union_agg, "top": _combined}.get(kind if "__" in c else "")
        if f:
            aggs.append(f(c).alias(c))
    return states.groupBy(*keys).agg(*aggs)


def finish(states: DataFrame) -> DataFrame:
    """Averages, medians and distinct counts from states."""
    out = states
    for c in states.columns:
        stem, _, kind = c.rpartition("__")
        if kind == "sum" and stem:
            out = out.withColumn(f"{stem}_avg", F.when(F.col(f"{stem}__count") > 0, F.col(c) / F.col(f"{stem}__count")))
        elif kind == "kll" and stem:
            out = out.withColumn(f"{stem}_median", F.kll_sketch_get_quantile_double(c, F.lit(0.5))).drop(c)
        elif kind == "hll" and stem:
            out = out.withColumn(f"{stem}_unique", F.hll_sketch_estimate(c)).drop(c)
    return out


def _floor(at: datetime, grain: str) -> datetime:
    at = at.replace(minute=0, second=0, microsecond=0)
    return at if grain == "hour" else at.replace(hour=0) if grain == "day" else at.replace(hour=0, day=1)


def _next(at: datetime, grain: str) -> datetime:
    return at + timedelta(hours=1) if grain == "hour" else at + timedelta(days=1) if grain == "day" else (at + timedelta(days=31)).replace(day=1)


def cut(start: datetime, end: datetime, grains: list[str] = ("month", "day", "hour")) -> list[tuple[str | None, datetime, datetime]]:
    """[start, end) in parts (grain, from, to): whole periods of the first grain, what is before and after them in those that follow, and rest in no grain at all."""
    if start >= end:
        return []
    if not grains:
        return [(None, start, end)]
    first, last = _floor(start, grains[0]), _floor(end, grains[0])
    first = first if first == start else _next(first, grains[0])
    if first >= last:
        return cut(start, end, grains[1:])
    return [*cut(start, first, grains[1:]), (grains[0], first, last), *cut(last, end, grains[1:])]


@dataclass
class Rollup:
    name: str
    frame: DataFrame
    dims: tuple[str, ...]
    grain: str
    metrics: tuple[str, ...]
    rows: int
    fixed: dict[str, object] = field(default_factory=dict)


class Catalog:
    """Chooses the smallest rollup that holds a question's dimensions, filters, metrics and grain."""

    def __init__(self, rollups: list[Rollup], base: DataFrame | None = None, time: str | None = None):
        """``base`` and ``time``: the table and its column of time, for the ends of ranges that no rollup holds."""
        self.rollups, self.base, self.time = rollups, base, time

    def route(self, dims: list[str], metrics: list[str], where: dict | None = None, grain: str | None = None) -> Rollup | None:
        where = where or {}
        fit = []
        for r in self.rollups:
            if any(where.get(k) != v for k, v in r.fixed.items()):
                continue
            need = {*dims, *where} - {*r.fixed}
            if need <= {*r.dims} and {*metrics} <= {*r.metrics} and (grain is None or grain in _FINER[r.grain]):
                fit.append(r)
        return min(fit, key=lambda r: (r.rows, r.name), default=None)

    def parts(self, dims: list[str], metrics: list[str], start: datetime, end: datetime, where: dict | None = None) -> list[tuple[Rollup | None, datetime, datetime]]:
        """How [start, end) is answered: each part by the smallest rollup of its grain that holds the question, or by the base table."""
        grains = {}
        for grain in ("month", "day", "hour"):
            held = Catalog([r for r in self.rollups if r.grain == grain]).route(dims, metrics, where)
            if held is not None:
                grains[grain] = held
        return [(grains.get(grain), a, b) for grain, a, b in cut(start, end, list(grains))]

    def aggregate_range(self, dims: list[str], metrics: list[str], start: datetime, end: datetime, where: dict | None = None) -> DataFrame:
        """The answer over [start, end), which may start and end anywhere: states of its parts, merged. Rollups are read by their periods alone and the base table
        by its time, so both are pruned."""
        where, states = where or {}, []
        for r, a, b in self.parts(dims, metrics, start, end, where):
            if r is None:
                if self.base is None:
                    raise LookupError(f"no rollup and no base table for {a} to {b}")
                rows = self.base.where((F.col(self.time) >= F.lit(a)) & (F.col(self.time) < F.lit(b)))
            else:
                kind = r.frame.schema["period"].dataType
                rows = r.frame.where((F.col("period") >= F.lit(a).cast(kind)) & (F.col("period") < F.lit(b).cast(kind)))
            for k, v in where.items():
                if r is None or k not in r.fixed:
                    rows = rows.where(F.col(k) == F.lit(v))
            one = build(rows, self.time, "hour", dims, metrics) if r is None else rows
            one = merge(one, dims)
            states.append(one.select(*dims, "n", *[f"{m}__{s}" for m in metrics for s in ("count", "sum", "min", "max")]))
        if not states:
            raise ValueError(f"an empty range: {start} to {end}")
        return finish(merge(reduce(DataFrame.unionByName, states), dims))

    def aggregate(self, dims: list[str], metrics: list[str], where: dict | None = None, grain: str | None = None) -> DataFrame:
        """From the chosen rollup; an error if none fits, as only the caller has the base table."""
        r = self.route(dims, metrics, where, grain)
        if r is None:
            raise LookupError(f"no rollup holds {dims}, {metrics}, {where}")
        rows = r.frame
        for k, v in (where or {}).items():
            if k not in r.fixed:
                rows = rows.where(F.col(k) == F.lit(v))
        kept = merge(rows, dims, grain)
        return finish(kept.select(*dims, *(["period"] if grain else []), "n", *[c for c in kept.columns if c.rpartition("__")[0] in metrics]))


WINDOWS = {"5m": 300, "1h": 3600, "4h": 14400, "1d": 86400, "3d": 259200, "7d": 604800, "14d": 1209600, "30d": 2592000, "60d": 5184000, "90d": 7776000}


def multi_period(df: DataFrame, dims: list[str], metric: str, time: str, as_of, windows: dict[str, int] | None = None) -> DataFrame:
    """Counts and sums over many windows up to ``as_of`` in one pass, a row per dimension."""
    windows = windows or WINDOWS
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(time)
    rows = df.where((age >= 0) & (age < max(windows.values())))
    aggs = [x for n, s in windows.items() for x in (F.count_if(age < s).alias(f"n_{n}"), F.coalesce(F.sum(F.when(age < s, F.col(metric))), F.lit(0.0)).alias(f"sum_{n}"))]
    return rows.groupBy(*dims).agg(*aggs)


def freshness(df: DataFrame, ts: str, as_of, limit_s: int) -> DataFrame:
    lag = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.max(ts))
    return df.agg(lag.alias("lag_s"), (lag > limit_s).alias("breach"))


def backfill(table: DataFrame, fresh: DataFrame, period: str, start, end) -> DataFrame:
    """The rollup with the periods of [start, end] replaced by freshly built ones."""
    inside = F.col(period).between(F.lit(start), F.lit(end))
    return table.where(~inside).unionByName(fresh.where(inside))
