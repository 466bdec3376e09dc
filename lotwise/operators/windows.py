"""Window operators over entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lagged(df: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    return df.withColumn("previous", F.lag(value, 1, 0).over(Window.partitionBy(entity).orderBy(order)))


def rolling(df: DataFrame, entity: str, order: str, value: str, n: int) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-n, 0)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("deviation", F.stddev_pop(value).over(w))


def limit_by(df: DataFrame, entity: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def competition_rank(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Equal values share a rank and the next one skips; NULLs come last."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())))


def consecutive_growth(df: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """Percent over the last known value before, to 4 places; NULL where that is 0 or there is none."""
    before = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(value, ignorenulls=True).over(before)
    return df.withColumn("growth_pct", F.when(prev != 0, F.round(100 * (F.col(value) - prev) / prev, 4)))


def anomaly_flag(df: DataFrame, z: str, threshold: float = 2.0) -> DataFrame:
    return df.withColumn("is_anomaly", F.abs(z) > threshold)


def index_forecast(df: DataFrame, entity: str, order: str, value: str, horizon: int = 1, least: int = 3) -> DataFrame:
    """A line over the row's place in its entity; NULL under ``least`` values."""
    placed = df.withColumn("__i", (F.row_number().over(Window.partitionBy(entity).orderBy(order)) - 1).cast("double"))
    y, x = F.col(value), F.col("__i")
    fit = placed.where(y.isNotNull()).groupBy(entity).agg(F.count("*").alias("n"), F.max("__i").alias("__last"), F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__b"))
    return fit.select(entity, "n", F.when(F.col("n") >= least, F.col("__b") + F.col("__s") * (F.col("__last") + horizon)).alias("forecast"))


def rank_desc(df: DataFrame, query: str, score: str, tie: str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie)))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def except_seen(rails: DataFrame, item: str, rail_order: str) -> DataFrame:
    """Each item in its first rail only."""
    return limit_by(rails, item, [F.col(rail_order)], 1)
