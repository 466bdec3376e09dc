"""Marketplace rails: named top-k lists over active auctions, and their composition.

A rail has item, score and rank columns. Hard filters come first; scores are capped at 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.times import recent

CAP = 50
WEEK = 7 * 86400


def active(auctions: DataFrame, as_of) -> DataFrame:
    return auctions.where(F.col("ends_at") > F.lit(as_of)).withColumn("left_s", F.unix_timestamp("ends_at") - F.unix_timestamp(F.lit(as_of)))


def capped(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def rail(rows: DataFrame, name: str, score: Column, order: list[Column], cap: int = CAP) -> DataFrame:
    top = rows.withColumn("score", score.cast("double")).orderBy(*order, "auction_id").limit(cap)
    # the limit has left ``cap`` rows, so the unpartitioned window is as small
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order, "auction_id")))
    return ranked.select(F.lit(name).alias("rail"), "auction_id", "score", "rank")


def _recent(events: DataFrame, as_of, seconds: int) -> DataFrame:
    return events.where(recent(F.col("ts"), as_of, seconds))


def _today(events: DataFrame, as_of) -> DataFrame:
    return events.where(F.to_date("ts") == F.to_date(F.lit(as_of)))


def _count(events: DataFrame, name: str) -> DataFrame:
    return events.groupBy("auction_id").agg(F.count("*").alias(name))


def trending(auctions: DataFrame, bids: DataFrame, as_of, event_as_of) -> DataFrame:
    hot = active(auctions, as_of).join(_count(_recent(bids, event_as_of, 4 * 3600), "n"), "auction_id")
    return rail(hot, "trending", F.col("n"), [F.desc("score")])


def ending_soon(auctions: DataFrame, as_of, horizon: int = WEEK, name: str = "ending_soon") -> DataFrame:
    rows = active(auctions, as_of).where((F.col("left_s") <= horizon) & (F.col("price") > 0))
    return rail(rows, name, capped(1 - F.col("left_s") / horizon), [F.col("left_s")])


def last_hour(auctions: DataFrame, as_of) -> DataFrame:
    return ending_soon(auctions, as_of, 3600, "last_hour")


def latest(auctions: DataFrame, as_of, recency: DataFrame | None = None) -> DataFrame:
    """Latest end first within a week; with bid recencies (auction_id, age_s) a mix of recency and capped bids, else the bids."""
    rows = active(auctions, as_of).where(F.col("left_s") <= WEEK)
    if recency is None:
        score = F.col("bids")
    else:
        rows = rows.join(recency, "auction_id", "left")
        score = 0.7 * capped(1 - F.coalesce(F.col("age_s"), F.lit(3600)) / 3600) + 0.3 * capped(F.col("bids") / 100)
    return rail(rows, "latest", score, [F.desc("left_s")])


def high_volume(auctions: DataFrame, watches: DataFrame, as_of, event_as_of) -> DataFrame:
    rows = active(auctions, as_of).join(_count(_today(watches, event_as_of), "w"), "auction_id", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    rows = rows.where((F.col("bids") >= 5) | (F.col("w") >= 3))
    return rail(rows, "high_volume", capped((F.col("bids") + F.col("w")) / 100), [F.desc(F.col("bids") + F.col("w"))])


def fresh(auctions: DataFrame, as_of) -> DataFrame:
    rows = active(auctions, as_of).where(F.col("bids") == 0)
    return rail(rows, "fresh", capped(F.col("left_s") / WEEK), [F.desc("left_s")])


def last_week(auctions: DataFrame, as_of) -> DataFrame:
    return rail(active(auctions, as_of).where(F.col("left_s") > WEEK), "last_week", capped(F.col("bids") / 100), [F.col("left_s")])


def watch_density(auctions: DataFrame, watches: DataFrame, as_of, event_as_of) -> DataFrame:
    rows = active(auctions, as_of).join(_count(_today(watches, event_as_of), "w"), "auction_id")
    return rail(rows, "watch_density", capped(F.col("w") / 50), [F.desc("w")])


def high_traffic(auctions: DataFrame, bids: DataFrame, watches: DataFrame, as_of, event_as_of) -> DataFrame:
    rows = active(auctions, as_of).join(_count(_recent(bids, event_as_of, 4 * 3600), "b"), "auction_id", "left").join(_count(_today(watches, event_as_of), "w"), "auction_id", "left")
    mix = 2 * F.coalesce("b", F.lit(0)) + F.coalesce("w", F.lit(0))
    return rail(rows.withColumn("mix", mix).where("mix > 0"), "high_traffic", capped(F.col("mix") / 100), [F.desc("mix")])


def competitive(auctions: DataFrame, bids: DataFrame, as_of, event_as_of, hours: int = 4) -> DataFrame:
    rivals = _recent(bids, event_as_of, hours * 3600).groupBy("auction_id").agg(F.countDistinct("user_id").alias("rivals")).where("rivals >= 2")
    return rail(active(auctions, as_of).join(rivals, "auction_id"), "competitive", F.col("rivals"), [F.desc("rivals")])


def opportunity(auctions: DataFrame, bids: DataFrame, watches: DataFrame, as_of, event_as_of) -> DataFrame:
    rows = active(auctions, as_of).join(_count(_today(watches, event_as_of), "w").where("w >= 3"), "auction_id")
    return rail(rows.join(_recent(bids, event_as_of, 4 * 3600).select("auction_id"), "auction_id", "left_anti"), "opportunity", F.col("w"), [F.desc("w")])


def fuse(rails: list[DataFrame], k: int = 60, top: int = 150) -> DataFrame:
    """Reciprocal rank fusion of rails; ties by item."""
    every = reduce(DataFrame.unionByName, rails)
    fused = every.groupBy("auction_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("rails"))
    return fused.orderBy(F.desc("score"), "auction_id").limit(top)


def landing(rails: list[DataFrame], fallback: DataFrame | None = None, per_rail: int = 10) -> DataFrame:
    """Rails in canonical order, each item in its first rail only; empty ones are filled from the fallback."""
    every = reduce(DataFrame.unionByName, [r.withColumn("place", F.lit(i)) for i, r in enumerate([*rails, *([fallback] if fallback is not None else [])])])
    first = every.withColumn("__rn", F.row_number().over(Window.partitionBy("auction_id").orderBy("place", "rank"))).where("__rn = 1").drop("__rn")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("rank"))).where(F.col("rank") <= per_rail).select("rail", "place", "auction_id", "rank")
