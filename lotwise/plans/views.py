"""The marketplace tables as views over the supplied tables, in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with the SQL that says the same.

    ``near(x)`` in the SQL stands for x rounded to 6 places, or to 3 from 1,000 on, where a double's sum holds no more: in two engines it
    differs in the last digits with the order of its terms. Halves are rounded up, also where they are off by a ten-thousandth of a step.
    """

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _expand(sql)
        return f

    return register


def _expand(sql: str) -> str:
    while (start := sql.rfind("near(")) >= 0:
        stop, depth = start + 5, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[stop], 0)
            stop += 1
        sql = f"{sql[:start]}list_transform([CAST({sql[start + 5 : stop - 1]} AS DOUBLE)], lambda near_x: CASE WHEN abs(near_x) < 1000 THEN floor(near_x * 1e6 + 0.5001) / 1e6 ELSE floor(near_x * 1e3 + 0.5001) / 1e3 END)[1]{sql[stop:]}"
    return sql


LISTINGS_SQL = """l AS (SELECT l_orderkey * 10 + l_linenumber AS auction_id, lower(replace(p_brand, '#', '')) AS tld, replace(p_name, ' ', '-') AS sld,
    CASE l_linestatus WHEN 'O' THEN CASE l_suppkey % 4 WHEN 0 THEN 20 ELSE 16 END ELSE CASE l_suppkey % 4 WHEN 0 THEN 39 ELSE 38 END END AS type_id, l_extendedprice AS price, CAST(l_quantity AS INTEGER) - 1 AS bids, p_retailprice AS govalue,
    CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS sold, l_shipdate AS ends_at, o_orderdate AS listed_at, lower(p_type) AS category, l_suppkey AS registrar,
    o_custkey AS user_id, p_size AS authority, CAST(round(l_tax * 10000) AS INTEGER) AS traffic, CAST(round(l_discount * 1000) AS INTEGER) AS backlinks,
    l_extendedprice * (1 - l_discount) AS sale_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
AUCTIONS_SQL = LISTINGS_SQL.replace("FROM lineitem JOIN", "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1) JOIN")
EVENTS_SQL = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events)"


def listings(spark: SparkSession, d: str, latest: bool = False) -> DataFrame:
    """One row per line of an order; with ``latest`` the last state of each auction_id only."""
    items = load(spark, d, "lineitem")
    if latest:
        from lotwise.operators.etl import latest_per_key

        items = latest_per_key(items, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"])
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    part = load(spark, d, "part")
    j = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(part, items["l_partkey"] == part["p_partkey"])
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("auction_id"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("tld"),
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("sld"),
        F.when(F.col("l_linestatus") == "O", F.when(F.col("l_suppkey") % 4 == 0, 20).otherwise(16)).otherwise(F.when(F.col("l_suppkey") % 4 == 0, 39).otherwise(38)).alias("type_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_quantity").cast("int") - 1).alias("bids"),
        F.col("p_retailprice").alias("govalue"),
        F.when(F.col("l_returnflag") != "N", 1).otherwise(0).alias("sold"),
        F.col("l_shipdate").alias("ends_at"),
        F.col("o_orderdate").alias("listed_at"),
        F.lower("p_type").alias("category"),
        F.col("l_suppkey").alias("registrar"),
        F.col("o_custkey").alias("user_id"),
        F.col("p_size").alias("authority"),
        F.round(F.col("l_tax") * 10000).cast("int").alias("traffic"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("backlinks"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sale_price"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("item"))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles made comparable with SQL: as ``near`` does, or rounded to so many ``digits`` where these are given."""
    step = lambda c, by: F.floor(F.col(c) * by + 0.5001) / by
    near = lambda c: F.when(F.abs(c) < 1000, step(c, 1e6)).otherwise(step(c, 1e3)).alias(c)
    return df.select(*[F.col(c) if t != "double" else F.round(c, digits[c]).alias(c) if c in digits else near(c) for c, t in df.dtypes])
