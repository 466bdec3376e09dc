"""Row enrichers and feature tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.times import recent

from .templates import minmax, stage
from .windows import competition_rank, consecutive_growth, index_forecast

Step = Callable[[DataFrame], DataFrame]


class Pipeline:
    """An unchanging chain of steps; a step that can't be planned fails at once."""

    def __init__(self, steps: tuple[Step, ...] = ()):
        self.steps = steps

    def then(self, step: Step) -> Pipeline:
        return Pipeline((*self.steps, step))

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df


def heat(value: Column, high: float = 5, medium: float = 1) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def lookup(df: DataFrame, dim: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """Columns of a dimension by key, with a default where the key is unknown (None: NULL). Catalyst broadcasts a small dimension."""
    out = df.join(dim.select(key, *columns), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in columns.items() if v is not None})


def momentum(now: Column, before: Column, by: float = 5.0) -> Column:
    pct = F.when(before != 0, 100 * (now - before) / before)
    return F.when(pct.isNull(), "unknown").when(pct > by, "rising").when(pct < -by, "falling").otherwise("stable")


def sell_through_tier(rate: Column) -> Column:
    return F.when(rate.isNull(), "unknown").when(rate >= 0.6, "high").when(rate >= 0.3, "medium").otherwise("low")


def urgency(ends_at: Column, as_of) -> Column:
    hours = (F.unix_timestamp(ends_at) - F.unix_timestamp(F.lit(as_of))) / 3600
    return F.when(hours.isNull(), "unknown").when(hours < 1, "critical").when(hours < 6, "high").when(hours < 24, "medium").otherwise("low")


def composite_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    scaled = minmax(df, list(weights))
    return scaled.withColumn("composite", sum(w * F.col(f"{c}_norm") for c, w in weights.items())).drop(*[f"{c}_norm" for c in weights])


# Weight and scale of each log-scaled signal in the traffic proxy; least visits of tiers 4 to 1.
TRAFFIC_SIGNALS = {"visits": (0.40, 1.0), "search_volume": (0.25, 1.0), "authority": (0.15, 10.0), "indexed_pages": (0.10, 1.0), "trust_flow": (0.05, 1.0), "revenue": (0.05, 100.0)}
TRAFFIC_TIERS = {4: 10_000, 3: 1_000, 2: 100, 1: 1}
#: Indexed pages up to so many tell nothing.
FEW_PAGES = 100


def traffic_proxy(**signals: Column) -> Column:
    """struct(proxy, has_signal, tier) of signals named as in TRAFFIC_SIGNALS; those not given count as 0, as do NULLs and negative ones.

    The tier (0 to 4) goes by the visits; without any, a search volume or trust flow still makes tier 1. Authority and revenue alone are no
    signal, nor are few indexed pages.
    """
    none = F.lit(0.0)
    known = {n: F.greatest(F.coalesce(signals[n].cast("double"), none), none) if n in signals else none for n in TRAFFIC_SIGNALS}
    if wrong := signals.keys() - known.keys():
        raise ValueError(f"no such signals: {sorted(wrong)}")
    proxy = sum(w * F.log1p(known[n] * scale) for n, (w, scale) in TRAFFIC_SIGNALS.items())
    visits, asked = known["visits"], (known["search_volume"] > 0) | (known["trust_flow"] > 0)
    tier = F.lit(0)
    for t, least in sorted(TRAFFIC_TIERS.items()):
        tier = F.when((visits >= least) | asked if t == 1 else visits >= least, t).otherwise(tier)
    return F.struct(F.round(proxy, 4).alias("proxy"), ((visits > 0) | asked | (known["indexed_pages"] > FEW_PAGES)).alias("has_signal"), tier.alias("tier"))


def best_traffic(monthly: Column, fortnight: Column, count: Column) -> Column:
    """Monthly visits, else those of 14 days scaled to a month (whole visits), else the count, else 0."""
    scaled = F.floor(fortnight * 2.14)
    return F.when(monthly > 0, monthly.cast("double")).when(scaled > 0, scaled.cast("double")).otherwise(F.coalesce(count.cast("double"), F.lit(0.0)))


def windowed_count(events: DataFrame, key: str, ts: str, as_of, hours: float, name: str) -> DataFrame:
    return events.where(recent(F.col(ts), as_of, hours * 3600)).groupBy(key).agg(F.count("*").alias(name))


def watch_density(watches: DataFrame, key: str, ts: str, is_bidder: Column, as_of) -> DataFrame:
    """Watches of the day, those of bidders, and their share to 3 places."""
    today = watches.where(F.to_date(ts) == F.to_date(F.lit(as_of)))
    out = today.groupBy(key).agg(F.count("*").alias("watches"), F.count_if(is_bidder).alias("bidder_watches"))
    return out.withColumn("density", F.round(F.col("bidder_watches") / F.greatest(F.col("watches"), F.lit(1)), 3))


def net_watch_delta(watches: DataFrame, key: str, ts: str, removed: Column, as_of) -> DataFrame:
    today = watches.where(F.to_date(ts) == F.to_date(F.lit(as_of)))
    return today.groupBy(key).agg((F.count_if(~removed) - F.count_if(removed)).alias("net_watches"))


def unique_in_window(events: DataFrame, key: str, who: str, ts: str, as_of, hours: float) -> DataFrame:
    return events.where(recent(F.col(ts), as_of, hours * 3600)).groupBy(key).agg(F.countDistinct(who).alias("bidders"))


def tld_features(listings: DataFrame, as_of, weeks: int = 13, threshold: float = 2.5) -> DataFrame:
    """Weekly figures of each TLD over the last weeks, with growth, anomaly, momentum and sell-through tier."""
    from lotwise.functions.times import bucket

    recent = listings.where((F.col("ends_at") > F.lit(as_of) - F.expr(f"INTERVAL {7 * weeks} DAYS")) & (F.col("ends_at") <= F.lit(as_of)))
    per = recent.groupBy("tld", bucket(F.col("ends_at"), "monday").alias("week")).agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"), F.avg(F.col("sold").cast("double")).alias("rate"))
    every = Window.partitionBy("tld")
    z = F.when(F.stddev_pop("mean_price").over(every) > 1e-9, (F.col("mean_price") - F.avg("mean_price").over(every)) / F.stddev_pop("mean_price").over(every))
    out = consecutive_growth(per, "tld", "week", "mean_price").withColumn("z", z).withColumn("is_anomaly", F.abs("z") > threshold)
    before = F.lag("mean_price").over(Window.partitionBy("tld").orderBy("week"))
    out = out.withColumn("momentum", momentum(F.col("mean_price"), before)).withColumn("tier", sell_through_tier(F.col("rate")))
    return out.join(index_forecast(per, "tld", "week", "mean_price").drop("n"), "tld")


def auction_features(auctions: DataFrame, as_of, top: int = 50_000, watchers: DataFrame | None = None, bidders: DataFrame | None = None, bands: DataFrame | None = None, momenta: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Active auctions, the ``top`` by bids and price, with composite score, rank within the TLD, urgency, heat and life stage.

    With dimensions also: ``watchers`` and ``bidders`` (item, n): their number, 0 if unknown; ``bands`` (tld, p25, p75): the price against
    its TLD's fair band; ``momenta`` (tld, now, before): the TLD's momentum; ``rates`` (registrar, rate): the registrar's sell-through tier.
    """
    active = auctions.where(F.col("ends_at") > F.lit(as_of)).orderBy(F.desc("bids"), F.desc("price"), "auction_id").limit(top)
    out = composite_score(active, {"bids": 0.5, "price": 0.3, "govalue": 0.2})
    out = competition_rank(out, ["tld"], "price", "tld_rank")
    days = F.datediff(F.lit(as_of), "listed_at")
    out = out.withColumn("urgency", urgency(F.col("ends_at"), as_of)).withColumn("heat", heat(F.col("bids"), 30, 10)).withColumn("stage", stage(days, days, 30, 90, 365))
    for name, dim in (("watchers", watchers), ("bidders", bidders)):
        if dim is not None:
            out = lookup(out, dim.select("item", F.col("n").alias(name)), "item", {name: 0})
    if bands is not None:
        out = lookup(out, bands.select("tld", "p25", "p75"), "tld", {"p25": None, "p75": None})
        out = out.withColumn("fair_value", F.when(F.col("p25").isNull(), "unknown").when(F.col("price") < F.col("p25"), "below").when(F.col("price") > F.col("p75"), "above").otherwise("fair"))
    if momenta is not None:
        out = lookup(out, momenta.select("tld", momentum(F.col("now"), F.col("before")).alias("tld_momentum")), "tld", {"tld_momentum": "unknown"})
    if rates is not None:
        out = lookup(out, rates.select("registrar", sell_through_tier(F.col("rate")).alias("tier")), "registrar", {"tier": "unknown"})
    return out
