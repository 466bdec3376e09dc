"""Lake operators: latest rows, scopes, staged joins, merges, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, later and larger first, NULLs last; columns as before.

    A grouped maximum would move less, but ties must be told by every order column and NULLs come last.
    """
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__rn", F.row_number().over(by)).where(F.col("__rn") == 1).drop("__rn")


def latest_in_window(df: DataFrame, key: str, ts: str, since, until) -> DataFrame:
    """The last row of each key in [since, until); blank keys are left out and times that can't be read too."""
    at = F.col(ts).try_cast("timestamp")
    rows = df.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "") & (at >= F.lit(since)) & (at < F.lit(until)))
    return latest_per_key(rows, [key], [ts])


def scope(frames: list[DataFrame], col: str) -> DataFrame:
    """Distinct lower-case names over all frames."""
    return reduce(DataFrame.unionByName, [f.select(F.lower(col).alias(col)) for f in frames]).distinct()


def in_scope(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
    return df.join(names.select(F.col(col).alias("__scope")), F.lower(df[col]) == F.col("__scope"), "left_semi")


def merge_wide(base: DataFrame, key: str, stages: dict[str, DataFrame | None], columns: dict[str, dict[str, str]], flags: list[str] = ()) -> DataFrame:
    """Left joins of ``base`` with stages of one row per key; a stage that is None gives typed NULLs; ``flags`` are 0 where unknown."""
    out = base
    for name, types in columns.items():
        stage = stages.get(name)
        if stage is None:
            out = out.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})
        else:
            out = out.join(stage.select(key, *[F.col(c).cast(t).alias(c) for c, t in types.items()]), key, "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in flags})


def merge_delta(base: DataFrame, delta: DataFrame, key: str, mutable: list[str]) -> DataFrame:
    """New values of ``mutable`` for known keys; unknown keys are skipped and NULLs change nothing. ``delta`` has one row per key."""
    new = delta.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in mutable])
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in mutable}).select(*base.columns)


def apply_aliases(df: DataFrame, aliases: dict[str, list[str]], boolean: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({a: (F.col(c) != 0 if a in boolean else F.col(c)) for c, names in aliases.items() for a in names})


def page_number(df: DataFrame, key: str, size: int) -> DataFrame:
    """``page``: (place by ``key`` - 1) // size over all rows, without one sorted partition.

    Rows are counted per value range first; a row's place is its place in its range plus the ranges before. The ranges' bounds
    are quantiles, so they're as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10000).alias("q")).first()["q"] or []
    bounds = sorted({*bounds})
    table = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    ranged = df.withColumn("__r", F.size(F.filter(table, lambda b: b <= F.col(key))))
    counts = ranged.groupBy("__r").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__r", "__before")
    place = F.row_number().over(Window.partitionBy("__r").orderBy(key))
    out = ranged.withColumn("__p", place).join(F.broadcast(before), "__r")
    return out.withColumn("page", F.floor((F.col("__before") + F.col("__p") - 1) / size)).drop("__r", "__p", "__before")


def bridge(df: DataFrame, item: str, auction: str) -> DataFrame:
    return df.where(F.col(auction) > 0).select(item, auction).distinct()


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Replace-by-version: all rows of both, the last of each key."""
    return latest_per_key(table.unionByName(new, allowMissingColumns=True), keys, order)


def ttl(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    return df.where(F.col(ts) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def any_in(col: Column, values: list) -> Column:
    """1 if any row of the group has one of ``values``, else 0."""
    return F.coalesce(F.bool_or(col.isin(*values)), F.lit(False)).cast("int")
