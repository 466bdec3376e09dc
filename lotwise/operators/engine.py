"""The marketplace's named questions: each is a template with its columns.

``Market`` holds frames of listings (auction_id, tld, sld, type_id, price, bids, govalue, sold, ends_at, listed_at, category,
registrar, user_id, authority, traffic, sale_price) and events (ts, user_id, event_type, value, item). Look-backs are capped.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import derive, enrich
from . import templates as t

MAX_DAYS = 3650


class Market:
    def __init__(self, listings: DataFrame, events: DataFrame, as_of: datetime, events_as_of: datetime, days: int = MAX_DAYS):
        days = min(days, MAX_DAYS)
        self.as_of, self.events_as_of = as_of, events_as_of
        self.listings = listings.where(F.col("ends_at") > F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")).withColumn("hold_days", derive.hold_days("listed_at", "ends_at"))
        self.listings = self.listings.withColumn("status", derive.expiry_status(F.col("sold"), F.col("ends_at"), as_of)).withColumn("segment", t.steps(F.col("bids"), [10, 25, 40], ["s", "m", "l", "xl"]))
        self.events = events
        self.bids = events.where(F.col("event_type").isin("click", "purchase", "error"))
        self.watches = events.where(F.col("event_type").isin("view", "signup"))
        self.sold = self.listings.where("sold = 1")

    def _hourly(self, events: DataFrame, key: str) -> DataFrame:
        return events.groupBy(key, F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))

    # interest
    def conversion_funnel(self):
        return t.window_funnel(self.events, "user_id", "event_type", "ts", ["view", "click", "purchase"], 21600)

    def buyer_interest_heatmap(self):
        return t.timing_heatmap(self.events, "ts", F.col("event_type") == "purchase")

    def cache_hit_analytics(self):
        return t.user_engagement(self.events, "user_id", "event_type", "ts")

    # market
    def tld_popularity_trends(self):
        return t.growth_rate(self.listings, "tld", "bids", "ends_at")

    def price_movement(self):
        return t.moving_average(self.listings, "price", "ends_at", by=["tld"])

    def auction_competitiveness(self):
        return t.bid_distribution(self.listings, "bids", "ends_at", "sold", "price")

    def expiry_pipeline_forecast(self):
        return t.forecast(self.listings, "type_id", "price", "ends_at")

    def realtime_auction_activity(self, minutes: int = 1440):
        return t.realtime_trending(self.bids, "item", "value", "ts", self.events_as_of, minutes)

    def historical_sales_comparison(self, current: tuple, prior: tuple):
        return t.historical_comparison(self.sold, "tld", "price", "ends_at", current, prior)

    def seasonal_trends(self):
        return t.category_trend(self.listings, ["category"], "price", "sld", "ends_at")

    def domain_quality_score(self):
        return t.ranking_score(self.listings, "sld", {"bids": 0.5, "price": 0.3, "govalue": 0.2}, "ends_at")

    def domain_liquidity(self):
        return t.sell_through(self.listings, ["sld"], "ends_at", "sold", "price", None)

    def supply_demand_analytics(self):
        return t.time_window(self.listings, ["tld"], ["price", "bids"], "ends_at")

    def keyword_trends(self):
        return t.keyword_trend(self.listings, "sld", "price", "ends_at")

    def emerging_niche_detection(self):
        return t.anomalies(self.listings, "category", "bids", "ends_at", "month", 6, 1.5)

    # sales
    def sold_domain_analytics(self):
        return t.category_trend(self.sold, ["tld"], "price", "sld", "ends_at")

    def sell_through_rate(self):
        return t.sell_through(self.listings, ["tld"], "ends_at", "sold", "price")

    def seo_price_correlation(self):
        return t.seo_bucket(self.listings, "authority", "traffic", "ends_at", "sold", "price")

    def bid_analytics(self):
        return t.bid_distribution(self.listings, "bids", "ends_at", "sold", "price", "week")

    def registrar_analytics(self):
        return t.sell_through(self.listings, ["registrar"], "ends_at", "sold", "price", None)

    def expiry_lifecycle_analytics(self):
        return t.category_trend(self.listings, ["status"], "price", "sld", "ends_at")

    def category_name_analytics(self):
        return t.category_trend(self.listings, ["category"], "price", "sld", "ends_at", "week")

    def investor_analytics(self):
        return t.investor_roi(self.sold, "category", "govalue", "sale_price", "ends_at")

    def buyer_segment_analytics(self):
        return t.category_trend(self.listings, ["segment"], "price", "user_id", "ends_at")

    def market_summary(self):
        return t.market_summary(self.listings, "sold", "price", "bids", "tld")

    def multidim_tld_category(self):
        return t.rollup(self.listings, ["tld", "category"], "price", "ends_at")

    # behaviour
    def bid_velocity_per_auction(self, hours: int = 48):
        return t.velocity(self._hourly(self.bids, "item"), "item", "hour", "n", self.events_as_of, hours)

    def watch_density_analytics(self):
        return enrich.watch_density(self.watches, "item", "ts", F.col("event_type") == "signup", self.events_as_of)

    def hold_time_distribution(self):
        return t.hold_time(self.listings, "type_id", "hold_days", "price")

    def watch_bid_conversion(self):
        return t.watch_bid_conversion(self.watches, self.bids, "item", "user_id", "user_id")

    def counter_offer_analytics(self):
        return t.counter_offers(self.bids, F.col("event_type") == "error", "value", "ts")

    def price_realization_rate(self):
        return t.price_realization(self.sold, "tld", "sale_price", "price", "ends_at")

    def buyer_retention_cohorts(self):
        return t.retention_cohorts(self.sold, "user_id", "ends_at")

    def auction_timing_patterns(self):
        return t.timing_heatmap(self.listings, "ends_at", F.col("sold") == 1)

    def name_structure_analytics(self):
        return t.name_structure(self.listings, "sld", "sold", "price")

    def cross_tld_price_spread(self, reference: str):
        return t.cross_tld_spread(self.sold, "sld", "tld", "price", reference)

    def search_attribution(self, hours: float = 24):
        signals = self.events.where("event_type = 'view'").select(F.col("item").alias("key"), F.col("event_id").alias("request_id"), "ts")
        sales = self.events.where("event_type = 'purchase'").select(F.col("item").alias("key"), F.col("event_id").alias("sale_id"), F.col("value").alias("amount"), "ts")
        return t.attribution(signals, sales, hours)

    def registrar_hhi(self):
        return t.concentration(self.listings, "registrar", "price")

    def comparable_sale_price(self):
        return t.comparable_price(self.sold, "tld", "sld", "price")

    def domain_lifecycle_stages(self):
        return t.lifecycle(self.listings, "sld", "ends_at", self.as_of)

    def cohort_price_comparison(self, a: str, b: str):
        return t.comparative_cohort(self.listings, "price", "ends_at", F.col("tld") == a, F.col("tld") == b)

    def price_quantile_distribution(self):
        return t.quantile_distribution(self.listings, "tld", "price", "ends_at")

    def auction_window_funnel(self):
        return t.window_funnel(self.events, "item", "event_type", "ts", ["view", "click", "purchase"], 21600)

    def price_moving_average(self):
        return t.moving_average(self.listings, "price", "ends_at", 7, "day")

    # feature tables
    def enriched_tld_analysis(self):
        return enrich.tld_features(self.listings, self.as_of)

    def enriched_hot_auctions(self):
        return enrich.auction_features(self.listings, self.as_of).where("heat = 'high'")

    def enriched_domain_ranking(self):
        return enrich.auction_features(self.listings, self.as_of).orderBy(F.desc("composite"), "auction_id")
