"""As-of joins: each row meets the nearest row of its key in time, in one pass over both sides in order.

No pairs are made: the two sides are one frame in order of time, in which the last row of the other side is carried along. Time is cut into slices
of about ``SLICE_ROWS`` rows, and a slice starts with what the slices before it carried (one row for each key and slice), so
neither a busy key nor a busy hour is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of both sides in a slice of time, over all keys, and slices at most.
SLICE_ROWS, SLICES = 1_000_000, 4096


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    table, top = F.array(*[F.lit(b) for b in bounds]), 1 << len(bounds).bit_length()
    steps = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.try_element_at(table, n + s) <= value, n + s).otherwise(n))  # past the end: NULL, so not at most


def _bounds(rows: DataFrame, at: str, slice_rows: int) -> list[int]:
    """Where time is cut: quantiles of both sides. Only they pass the driver."""
    n = rows.count()
    parts = min(SLICES, -(-n // slice_rows))
    if parts <= 1:
        return []
    cuts = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] or []
    return sorted({*cuts})


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], forward: bool = False, slice_rows: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` with its keys at its ``ts`` or before (``forward``: of the first at it or after), as the struct
    ``met``; NULL where there is none.

    Rows of ``right`` at one instant: the one with the greatest ``columns`` is the nearest. A NULL key or time meets nothing, and rows of ``left`` are
    all kept.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    whole = F.when(F.greatest(*[F.col(k).isNull() for k in keys], F.col(ts).isNull()), F.lit(None)).otherwise(micros)
    kind = F.struct(*columns)
    met = right.where(whole.isNotNull()).select(*keys, micros.alias("__t"), F.lit(None).alias("__l"), kind.alias("__r"), F.lit(0).alias("__side"))
    own = left.select(*keys, whole.alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(None).alias("__r"), F.lit(1).alias("__side"))
    cuts = _bounds(met.select("__t").unionByName(own.select("__t")), "__t", slice_rows or SLICE_ROWS)
    rows = own.unionByName(met).withColumn("__slice", range_of(F.col("__t"), cuts))
    if forward:
        rows = rows.withColumn("__t", -F.col("__t")).withColumn("__slice", -F.col("__slice"))
    upto = Window.partitionBy(*keys, "__slice").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__r", ignorenulls=True).over(upto)
    rows = rows.withColumn("__found", found)
    if cuts:
        ends = rows.where("__side = 0").groupBy(*keys, "__slice").agg(F.max(F.struct("__t", "__r")).alias("__e"))
        # a slice takes up what the last slice that had a row of the other side carried: an order over one row for each key and slice
        places = rows.select(*keys, "__slice").distinct().join(ends, [*keys, "__slice"], "left")
        earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = places.withColumn("__before", F.last("__e", ignorenulls=True).over(earlier)["__r"]).select(*keys, "__slice", "__before")
        rows = rows.where("__side = 1").join(carried, [*keys, "__slice"], "left").withColumn("__found", F.coalesce("__found", "__before"))
    return rows.where("__side = 1").select("__l.*", F.when(F.col("__t").isNotNull(), F.col("__found")).alias("met"))


def within(signals: DataFrame, sales: DataFrame, seconds: float, slice_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals (key, request_id, ts) that a sale follows within so many whole seconds, and sales (key, sale_id, amount, ts) that follow one."""
    apart = lambda a, b: F.unix_timestamp(b) - F.unix_timestamp(a) <= seconds
    asked = asof_join(signals, sales, ["key"], "ts", ["ts"], forward=True, slice_rows=slice_rows).where(apart("ts", "met.ts")).drop("met")
    sold = asof_join(sales, signals, ["key"], "ts", ["ts"], slice_rows=slice_rows).where(apart("met.ts", "ts")).drop("met")
    return asked, sold
