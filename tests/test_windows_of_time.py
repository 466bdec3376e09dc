"""Windows of time end at an instant: fractions of a second decide."""

from datetime import datetime, timedelta

from lotwise.operators import enrich, rails

AS_OF = datetime(2024, 1, 30)
HALF = timedelta(milliseconds=500)


def events(spark, hours, kind="timestamp"):
    """1 lies within the window by half a second at its start, 2 outside at its end, 3 on its end, 4 on its start, which is outside."""
    start = AS_OF - timedelta(hours=hours)
    rows = [(1, 7, start + HALF), (1, 8, start + HALF), (2, 7, AS_OF + HALF), (2, 8, AS_OF + HALF), (3, 7, AS_OF), (3, 8, AS_OF), (4, 7, start), (4, 8, start)]
    df = spark.createDataFrame(rows, "auction_id long, user_id long, ts timestamp")
    return df.withColumn("ts", df["ts"].cast(kind))


def test_features_of_a_window(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        got = enrich.windowed_count(events(spark, 1, kind), "auction_id", "ts", AS_OF, 1, "bids")
        assert {r["auction_id"]: r["bids"] for r in got.collect()} == {1: 2, 3: 2}
        got = enrich.unique_in_window(events(spark, 4, kind), "auction_id", "user_id", "ts", AS_OF, 4)
        assert {r["auction_id"]: r["bidders"] for r in got.collect()} == {1: 2, 3: 2}


def test_rails_of_a_window(spark):
    auctions = spark.createDataFrame([(i, datetime(2024, 2, 1), 0, 1.0) for i in range(1, 5)], "auction_id long, ends_at timestamp, bids int, price double")
    bids, watches = events(spark, 4), events(spark, 4).where("false")
    for got in (rails.trending(auctions, bids, AS_OF, AS_OF), rails.competitive(auctions, bids, AS_OF, AS_OF), rails.high_traffic(auctions, bids, watches, AS_OF, AS_OF)):
        assert sorted(r["auction_id"] for r in got.collect()) == [1, 3]


def test_rails_of_events_that_name_more_than_a_hundred_auctions(spark, tmp_path):
    import os

    import duckdb

    import __spark_entry__ as entry

    sf, db = "/root/testdata/sf0.01", duckdb.connect()
    named = "event_id, ts, user_id, event_type, value, '{\"k\": ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 * (event_id % 3)) || '}' AS props"
    db.execute(f"COPY (SELECT {named} FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet'")
    for f in os.listdir(sf):
        if f != "events.parquet":
            os.symlink(f"{sf}/{f}", f"{tmp_path}/{f}")
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{tmp_path}/{f}'")
    for name in ("rail_competitive", "rail_high_traffic", "rail_watch_density"):
        got = entry.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(entry.oracle_sql()[name]).fetchall()), name
