"""Schemas of the marketplace tables and ``conform``, which brings a source to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUCTIONS = T.StructType.fromDDL(
    "auction_id bigint, domain_name string, tld string, auction_type_id int, user_id bigint, current_price double, bid_count int, govalue_score double, domain_authority float, monthly_traffic int, backlink_count int, domain_age_days int, registrar_name string, category_name string, buyer_segment string, sold_flag int, listed_at timestamp, ends_at timestamp, sold_at timestamp, updated_at timestamp"
)
BID_EVENTS = T.StructType.fromDDL("bid_event_id string, member_item_id bigint, auction_id bigint, bidder_id bigint, seller_id bigint, bid_usd_amount double, bid_source string, buy_it_now_flag int, bid_accepted int, counter_offer int, bid_start_at timestamp, bid_end_at timestamp, event_utc_ts timestamp, received_at timestamp")
WATCH_EVENTS = T.StructType.fromDDL("watch_event_id string, member_item_id bigint, member_id bigint, watch_type int, watch_type_label string, is_deleted int, created_at timestamp, modified_at timestamp, event_utc_ts timestamp, received_at timestamp")
SIGNALS = T.StructType.fromDDL("signal_id string, request_id string, signal_type string, payload string, signal_origin string, created_at timestamp")


def conform(df: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema``, cast where values allow it (others become NULL); missing ones are NULL; a missing required one is an error."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    cast = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
    return df.select(*[cast(f).alias(f.name) for f in schema])


def empty(spark, schema: T.StructType) -> DataFrame:
    """A stub for an optional source that isn't there."""
    return spark.createDataFrame([], schema)
