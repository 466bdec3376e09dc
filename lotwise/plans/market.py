"""Queries of joins, windows, rollups, rails, enrichers and feature tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.functions.times import bucket
from lotwise.operators import enrich, etl, rails, rollups, windows
from lotwise.operators import templates as t
from lotwise.operators.sizes import DIMENSION
from lotwise.session import load

from .views import AUCTIONS_SQL, EVENTS_SQL, LISTINGS_SQL, events, listings, query, rounded

A, L, E = f"WITH {AUCTIONS_SQL}", f"WITH {LISTINGS_SQL}", f"WITH {EVENTS_SQL}"
AS_OF = datetime(2001, 6, 1)
EVENTS_AS_OF = datetime(2024, 1, 30)
_NOW = "TIMESTAMP '2001-06-01'"

# -- joins


@query(f"""{L}, c AS (SELECT tld, sum(price) AS now FROM l WHERE ends_at >= TIMESTAMP '2001-01-01' AND bids > 45 GROUP BY ALL), p AS (SELECT tld, sum(price) AS before FROM l WHERE ends_at < TIMESTAMP '1995-03-01' AND bids > 45 GROUP BY ALL)
    SELECT coalesce(c.tld, p.tld) AS tld, round(now, 2) AS now, round(before, 2) AS before FROM c FULL JOIN p ON c.tld = p.tld""")
def join_full_outer_periods(spark, d):
    rows = listings(spark, d).where("bids > 45")
    now = rows.where(F.col("ends_at") >= F.lit(datetime(2001, 1, 1))).groupBy("tld").agg(F.sum("price").alias("now"))
    before = rows.where(F.col("ends_at") < F.lit(datetime(1995, 3, 1))).groupBy("tld").agg(F.sum("price").alias("before"))
    return rounded(now.join(before, "tld", "full_outer"), now=2, before=2)


@query(f"""{L}, a AS (SELECT CAST(date_trunc('month', ends_at) AS DATE) AS period, count(*) AS n_a FROM l WHERE tld = 'brand3' AND bids > 40 GROUP BY ALL), b AS (SELECT CAST(date_trunc('month', ends_at) AS DATE) AS period, count(*) AS n_b FROM l WHERE tld = 'brand4' AND bids > 40 GROUP BY ALL)
    SELECT coalesce(a.period, b.period) AS period, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.period = b.period""")
def join_full_outer_cohorts(spark, d):
    rows = listings(spark, d).where("bids > 40").withColumn("period", bucket(F.col("ends_at"), "month"))
    side = lambda tld, n: rows.where(F.col("tld") == tld).groupBy("period").agg(F.count("*").alias(n))
    zero = F.lit(0).cast("long")
    return side("brand3", "n_a").join(side("brand4", "n_b"), "period", "full_outer").select("period", F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"))


@query(f"""{E}, r AS (SELECT item, count(*) AS recent FROM e WHERE ts > TIMESTAMP '2024-01-28' GROUP BY ALL), p AS (SELECT item, count(*) AS prior FROM e WHERE ts <= TIMESTAMP '2024-01-28' AND ts > TIMESTAMP '2024-01-27' GROUP BY ALL) SELECT r.item, recent, prior FROM r LEFT JOIN p ON r.item = p.item""")
def join_left_velocity(spark, d):
    e = events(spark, d)
    recent = e.where(F.col("ts") > F.lit(datetime(2024, 1, 28))).groupBy("item").agg(F.count("*").alias("recent"))
    prior = e.where((F.col("ts") <= F.lit(datetime(2024, 1, 28))) & (F.col("ts") > F.lit(datetime(2024, 1, 27)))).groupBy("item").agg(F.count("*").alias("prior"))
    return recent.join(prior, "item", "left")


@query(f"""{E}, w AS (SELECT user_id, item, count(*) AS watches FROM e WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT user_id, item, count(*) AS bids FROM e WHERE event_type = 'click' GROUP BY ALL) SELECT w.user_id, w.item, watches, bids FROM w LEFT JOIN b ON w.user_id = b.user_id AND w.item = b.item""")
def join_left_watch_bid(spark, d):
    e = events(spark, d)
    side = lambda kind, n: e.where(F.col("event_type") == kind).groupBy("user_id", "item").agg(F.count("*").alias(n))
    return side("view", "watches").join(side("click", "bids"), ["user_id", "item"], "left")


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY ALL) SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) - CAST(first AS DATE) AS INTEGER) AS days FROM orders JOIN f USING (o_custkey)""")
def join_self_cohort(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return o.join(first, "o_custkey").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", "first").alias("days"))


@query("""WITH m AS (SELECT p_name AS label, p_brand AS tld, avg(p_retailprice) AS mean FROM part GROUP BY ALL) SELECT m.label, m.tld, near(m.mean - r.mean) AS gap FROM m JOIN m r ON m.label = r.label AND r.tld = 'Brand#1' WHERE m.tld <> 'Brand#1'""")
def join_self_reference(spark, d):
    m = load(spark, d, "part").groupBy(F.col("p_name").alias("label"), F.col("p_brand").alias("tld")).agg(F.avg("p_retailprice").alias("mean"))
    ref = m.where("tld = 'Brand#1'").select("label", F.col("mean").alias("ref"))
    return rounded(m.where("tld <> 'Brand#1'").join(ref, "label").select("label", "tld", (F.col("mean") - F.col("ref")).alias("gap")))


@query(f"""{E} SELECT v.event_id AS signal, p.event_id AS sale FROM e v JOIN e p ON v.item = p.item AND v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 48 HOURS WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def join_interval_attribution(spark, d):
    e = events(spark, d)
    v = e.where("event_type = 'view'").select("item", "user_id", "ts", F.col("event_id").alias("signal"))
    p = e.where("event_type = 'purchase'").select("item", "user_id", F.col("ts").alias("sold"), F.col("event_id").alias("sale"))
    return v.join(p, ["item", "user_id"]).where((F.col("sold") >= F.col("ts")) & (F.col("sold") <= F.col("ts") + F.expr("INTERVAL 48 HOURS"))).select("signal", "sale")


@query(f"""{E} SELECT event_id FROM e s WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = s.user_id AND p.ts > s.ts AND p.ts <= s.ts + INTERVAL 1 HOUR)""")
def join_interval_sessions(spark, d):
    e = events(spark, d)
    s = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    p = e.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"))
    return s.join(p, (F.col("user_id") == F.col("u")) & (F.col("at") > F.col("ts")) & (F.col("at") <= F.col("ts") + F.expr("INTERVAL 1 HOUR")), "left_semi").select("event_id")


@query("""SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)""")
def join_label_observation(spark, d):
    return load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def join_broadcast_dims(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query(f"""{E}, v AS (SELECT item, date_trunc('hour', ts) AS hour, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT DISTINCT item, user_id FROM e WHERE event_type = 'purchase')
    SELECT c_custkey, CAST(sum(n) AS BIGINT) AS bids FROM v JOIN b USING (item) JOIN customer ON c_custkey = user_id GROUP BY ALL""")
def join_bridge_rails(spark, d):
    e = events(spark, d)
    hourly = e.where("event_type = 'click'").groupBy("item", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    pairs = e.where("event_type = 'purchase'").select("item", "user_id").distinct()
    return hourly.groupBy("item").agg(F.sum("n").alias("n")).join(pairs, "item").join(load(spark, d, "customer").select("c_custkey"), F.col("user_id") == F.col("c_custkey")).groupBy("c_custkey").agg(F.sum("n").alias("bids"))


@query("""SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.role = 'assistant' AND lower(trim(p.text)) = lower(trim(c.text)))""")
def join_anti_seen(spark, d):
    c = load(spark, d, "conversations")
    seen = c.where("role = 'assistant'").select(F.lower(F.trim("text")).alias("norm"))
    return c.where("role = 'user'").withColumn("norm", F.lower(F.trim("text"))).join(seen, "norm", "left_anti").select("conv_id", "turn")


# -- windows

_TLD_MONTH = f"{L}, s AS (SELECT tld, CAST(date_trunc('month', ends_at) AS DATE) AS period, sum(price) AS total, count(*) AS n FROM l GROUP BY ALL)"


def _tld_month(spark, d):
    return listings(spark, d).groupBy("tld", bucket(F.col("ends_at"), "month").alias("period")).agg(F.sum("price").alias("total"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def win_row_number_latest(spark, d):
    return etl.latest_per_key(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@query(f"{_TLD_MONTH} SELECT tld, period, n, lag(n, 1, 0) OVER (PARTITION BY tld ORDER BY period) AS previous FROM s")
def win_lag(spark, d):
    return windows.lagged(_tld_month(spark, d).drop("total"), "tld", "period", "n")


@query(f"{_TLD_MONTH} SELECT tld, period, n, near(avg(n) OVER w) AS mean, near(stddev_pop(n) OVER w) AS deviation FROM s WINDOW w AS (PARTITION BY tld ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def win_rolling_avg_std(spark, d):
    return rounded(windows.rolling(_tld_month(spark, d).drop("total"), "tld", "period", "n", 5))


@query(f"{E}, s AS (SELECT CAST(ts AS DATE) AS period, count(*) AS n FROM e GROUP BY ALL) SELECT period, n, near(avg(n) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS moving FROM s")
def win_rolling_over_agg(spark, d):
    per = events(spark, d).groupBy(F.to_date("ts").alias("period")).agg(F.count("*").alias("n"))
    return rounded(per.withColumn("moving", F.avg("n").over(Window.orderBy("period").rowsBetween(-2, 0))))


@query("WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, near((p_retailprice - lo) / (hi - lo)) AS p_retailprice_norm FROM part, m")
def win_global_minmax(spark, d):
    return rounded(t.minmax(load(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).drop("p_retailprice"))


@query(f"{_TLD_MONTH} SELECT tld, period, n, near(avg(n) OVER (PARTITION BY tld ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS moving FROM s")
def win_moving_avg(spark, d):
    return rounded(_tld_month(spark, d).drop("total").withColumn("moving", F.avg("n").over(Window.partitionBy("tld").orderBy("period").rowsBetween(-2, 0))))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def win_limit_by(spark, d):
    return windows.limit_by(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT p_partkey, p_brand, p_size, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST) AS INTEGER) AS rank FROM part")
def win_competition_rank(spark, d):
    return windows.competition_rank(load(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")


@query(f"{_TLD_MONTH}, p AS (SELECT *, lag(n) OVER (PARTITION BY tld ORDER BY period) AS prev FROM s) SELECT tld, period, n, near(round(CASE WHEN prev <> 0 THEN 100.0 * (n - prev) / prev END, 4)) AS growth_pct FROM p")
def win_consecutive_growth(spark, d):
    return rounded(windows.consecutive_growth(_tld_month(spark, d).drop("total"), "tld", "period", "n"))


@query(f"{_TLD_MONTH}, i AS (SELECT tld, CAST(row_number() OVER (PARTITION BY tld ORDER BY period) - 1 AS DOUBLE) AS i, n AS y FROM s) SELECT tld, count(*) AS n, near(CASE WHEN count(*) >= 3 THEN regr_intercept(y, i) + regr_slope(y, i) * (max(i) + 1) END) AS forecast FROM i GROUP BY ALL")
def win_index_forecast(spark, d):
    return rounded(windows.index_forecast(_tld_month(spark, d).select("tld", "period", F.col("n").alias("y")), "tld", "period", "y"))


@query(f"""{E}, k AS (SELECT DISTINCT user_id FROM e WHERE event_type IN ('signup', 'purchase')),
    r AS (SELECT user_id, EXISTS (SELECT 1 FROM e a WHERE a.user_id = k.user_id AND a.event_type = 'signup') AS one, EXISTS (SELECT 1 FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.user_id = k.user_id) AS two FROM k)
    SELECT user_id, CAST(CASE WHEN two THEN 2 WHEN one THEN 1 ELSE 0 END AS INTEGER) AS level FROM r""")
def win_funnel(spark, d):
    return t.funnel_levels(events(spark, d), ["user_id"], "event_type", "ts", ["signup", "purchase"], 3600)


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def win_rank_desc(spark, d):
    return windows.rank_desc(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey").drop("o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def srt_topn(spark, d):
    return windows.top_n(load(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 25)


@query("SELECT item, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS item FROM events) GROUP BY ALL ORDER BY n DESC, item LIMIT 20")
def srt_topn_counts(spark, d):
    counts = load(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("item")).agg(F.count("*").alias("n"))
    return windows.top_n(counts, [F.desc("n"), F.col("item")], 20)


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_brand, p_partkey) AS INTEGER) AS place FROM part ORDER BY place LIMIT 200")
def srt_composite_key(spark, d):
    order = [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_brand"), F.col("p_partkey")]
    top = windows.top_n(load(spark, d, "part"), order, 200)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("SELECT event_id FROM events ORDER BY ts DESC LIMIT 500")
def srt_cap_newest(spark, d):
    return windows.top_n(load(spark, d, "events").select("event_id", "ts"), [F.desc("ts")], 500).select("event_id")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT 'customer' AS rail, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def set_union_all_rails(spark, d):
    return load(spark, d, "customer").select(F.lit("customer").alias("rail"), F.col("c_nationkey").alias("k")).unionByName(load(spark, d, "supplier").select(F.lit("supplier").alias("rail"), F.col("s_nationkey").alias("k")))


@query(f"""{E}, r AS (SELECT item, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS place FROM e) SELECT item, CAST(min(place) AS INTEGER) AS place FROM r GROUP BY ALL""")
def set_except_seen(spark, d):
    place = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return windows.except_seen(events(spark, d).select("item", place.alias("place")), "item", "place")


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '([a-z]+)')) AS w, ['the', 'of', 'and', 'la', 'que', 'der'] AS g FROM documents) SELECT doc_id, CAST(len(list_intersect(w, g)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(w, g))) AS INTEGER) AS either FROM t""")
def set_intersect_tokens(spark, d):
    gold = F.array(*[F.lit(x) for x in ("the", "of", "and", "la", "que", "der")])
    w = load(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w"))
    return w.select("doc_id", F.size(F.array_intersect("w", gold)).alias("both"), F.size(F.array_union("w", gold)).alias("either"))


# -- rollups

_STATE = "count(*) AS n, round(sum(price), 2) AS price_sum, min(price) AS price_min, max(price) AS price_max, CAST(sum(bids) AS DOUBLE) AS bids_sum"
_GRAIN = {"hour": "date_trunc('hour', {0})", "day": "CAST({0} AS DATE)", "week": "CAST({0} AS DATE) - CAST(dayofweek({0}) AS INTEGER)", "month": "CAST(date_trunc('month', {0}) AS DATE)"}
_ALL = {"tld": "tld", "type": "type_id", "category": "category", "registrar": "registrar", "user": "user_id", "expiry": "expiry", "type_name": "type_name", "segment": "segment"}


def _rolled(spark, d, dims: list[str], grain: str, time: str = "ends_at", where=None):
    from lotwise.operators import derive

    rows = listings(spark, d).withColumn("type_name", derive.auction_type_name(F.col("type_id"))).withColumn("expiry", derive.expiry_status(F.col("sold"), F.col("ends_at"), AS_OF)).withColumn("segment", t.steps(F.col("bids"), [10, 25, 40], ["s", "m", "l", "xl"]))
    return rollups.build(rows, time, grain, dims, ["price", "bids"], where)


def _states(df, dims: list[str]):
    out = df.select(*dims, "period", "n", F.col("price__sum").alias("price_sum"), F.col("price__min").alias("price_min"), F.col("price__max").alias("price_max"), F.col("bids__sum").alias("bids_sum"))
    return rounded(out, price_sum=2, price_min=2, price_max=2, bids_sum=0)


_DERIVED = f"""{L}, r AS (SELECT *, CASE WHEN type_id IN (16, 38) THEN 'expiry auction' WHEN type_id = 20 THEN 'buynow' WHEN type_id = 39 THEN 'closeout' ELSE 'other' END AS type_name, CASE WHEN sold = 1 THEN 'sold' WHEN ends_at < {_NOW} THEN 'expired' WHEN CAST(ends_at AS DATE) - DATE '2001-06-01' <= 7 THEN 'expiring_soon' ELSE 'active' END AS expiry,
    CASE WHEN bids < 10 THEN 's' WHEN bids < 25 THEN 'm' WHEN bids < 40 THEN 'l' ELSE 'xl' END AS segment FROM l)"""


def _register_rollup(name: str, dims: list[str], grain: str, time: str = "ends_at", sold: bool = False) -> None:
    sql = f"{_DERIVED} SELECT {', '.join(dims)}, {_GRAIN[grain].format(time)} AS period, {_STATE} FROM r {'WHERE sold = 1' if sold else ''} GROUP BY ALL"

    def build(spark, d):
        return _states(_rolled(spark, d, dims, grain, time, F.col("sold") == 1 if sold else None), dims)

    build.__name__ = name
    query(sql)(build)


for _name, _dims, _grain, *_more in [
    ("mv_auctions_by_tld_hour", ["tld"], "hour"), ("mv_auctions_by_tld_day", ["tld"], "day"), ("mv_auctions_by_tld_week", ["tld"], "week"),
    ("mv_auctions_by_type_hour", ["type_id"], "hour"), ("mv_auctions_by_type_day", ["type_id"], "day"), ("mv_auctions_by_type_week", ["type_id"], "week"),
    ("mv_auctions_by_type_tld_hour", ["type_id", "tld"], "hour"), ("mv_auctions_by_type_tld_day", ["type_id", "tld"], "day"), ("mv_auctions_growth_week", ["tld", "type_id"], "week"),
    ("mv_auctions_by_category_day", ["type_id", "tld", "category"], "day"), ("mv_auctions_by_category_name_day", ["category"], "day"), ("mv_auctions_by_category_name_week", ["category"], "week"),
    ("mv_user_engagement_day", ["user_id"], "day"), ("mv_new_listings_by_tld_day", ["tld"], "day", "listed_at"), ("mv_new_listings_by_category_name_day", ["category"], "day", "listed_at"),
    ("mv_auctions_by_tld_category_name_day", ["tld", "category"], "day"), ("mv_auctions_by_expiry_registrar_day", ["expiry", "registrar"], "day"),
    ("mv_sold_by_tld_day", ["tld"], "day", "ends_at", True), ("mv_sold_by_type_day", ["type_id"], "day", "ends_at", True), ("mv_sold_by_category_name_day", ["category"], "day", "ends_at", True), ("mv_sold_by_category_name_week", ["category"], "week", "ends_at", True), ("mv_sold_by_tld_week", ["tld"], "week", "ends_at", True),
    ("mv_auctions_by_registrar_day", ["registrar"], "day"), ("mv_expiry_lifecycle_day", ["expiry"], "day"), ("mv_auctions_by_type_name_day", ["type_name"], "day"),
    ("mv_auctions_by_buyer_segment_day", ["segment"], "day"), ("mv_auctions_by_buyer_segment_week", ["segment"], "week"),
]:
    _register_rollup(_name, _dims, _grain, *_more)


def _sell_through(dim: str):
    def run(spark, d):
        from lotwise.operators import derive

        rows = listings(spark, d).withColumn("type_name", derive.auction_type_name(F.col("type_id")))
        return rows.groupBy(dim, F.to_date("ends_at").alias("period")).agg(F.count("*").alias("n"), F.count_if(F.col("sold") == 1).alias("sold"))

    return run


for _name, _dim in (("mv_sell_through_by_tld_day", "tld"), ("mv_sell_through_by_type_day", "type_name")):
    _f = _sell_through(_dim)
    _f.__name__ = _name
    query(f"{_DERIVED} SELECT {_dim}, CAST(ends_at AS DATE) AS period, count(*) AS n, count(*) FILTER (sold = 1) AS sold FROM r GROUP BY ALL")(_f)


@query(f"{_DERIVED}, h AS (SELECT *, greatest(0, CAST(CAST(ends_at AS DATE) - CAST(listed_at AS DATE) AS INTEGER)) AS hold FROM r) SELECT type_name, tld, CAST(ends_at AS DATE) AS period, count(*) AS n, CAST(sum(hold) AS BIGINT) AS hold_sum, min(hold) AS hold_min, max(hold) AS hold_max FROM h GROUP BY ALL")
def mv_hold_time_by_type_day(spark, d):
    from lotwise.operators import derive

    rows = listings(spark, d).withColumn("type_name", derive.auction_type_name(F.col("type_id"))).withColumn("hold", derive.hold_days("listed_at", "ends_at"))
    return rows.groupBy("type_name", "tld", F.to_date("ends_at").alias("period")).agg(F.count("*").alias("n"), F.sum("hold").alias("hold_sum"), F.min("hold").alias("hold_min"), F.max("hold").alias("hold_max"))


def _event_rollup(name: str, kinds: tuple[str, ...], key: str, grain: str) -> None:
    inside = ", ".join(f"'{k}'" for k in kinds)
    period = "date_trunc('hour', ts)" if grain == "hour" else "CAST(ts AS DATE)"

    def run(spark, d):
        e = events(spark, d).where(F.col("event_type").isin(*kinds))
        return e.groupBy(key, bucket(F.col("ts"), grain).alias("period")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("high"), F.countDistinct("user_id").alias("users"))

    run.__name__ = name
    query(f"{E} SELECT {key}, {period} AS period, count(*) AS n, round(sum(value), 2) AS total, max(value) AS high, count(DISTINCT user_id) AS users FROM e WHERE event_type IN ({inside}) GROUP BY ALL")(run)


_event_rollup("mv_bid_velocity_by_auction_hour", ("click", "purchase"), "user_id", "hour")
_event_rollup("mv_bid_velocity_by_item_hour", ("click", "purchase"), "item", "hour")
_event_rollup("mv_watch_density_by_item_day", ("view", "signup"), "item", "day")
_event_rollup("mv_bidder_watch_density_by_item_day", ("signup",), "item", "day")
_event_rollup("mv_unique_bidder_count_by_item", ("purchase",), "item", "hour")


@query(f"{L} SELECT tld, CAST(date_trunc('month', ends_at) AS DATE) AS period, {_STATE} FROM l GROUP BY ALL")
def rollup_backfill(spark, d):
    rows = listings(spark, d)
    fresh = rollups.build(rows, "ends_at", "month", ["tld"], ["price", "bids"])
    stale = rollups.build(rows.where(F.col("ends_at") < F.lit(datetime(2000, 1, 1))), "ends_at", "month", ["tld"], ["price", "bids"])
    return _states(rollups.backfill(stale, fresh, "period", datetime(2000, 1, 1).date(), datetime(2010, 1, 1).date()), ["tld"])


@query(f"{L} SELECT tld, CAST(date_trunc('month', ends_at) AS DATE) AS period, count(*) AS n, near(avg(price)) AS price_avg, near(avg(bids)) AS bids_avg FROM l GROUP BY ALL")
def rollup_merge(spark, d):
    daily = rollups.build(listings(spark, d), "ends_at", "day", ["tld", "type_id"], ["price", "bids"], medians=["price"], uniques=["user_id"])
    return rounded(rollups.finish(rollups.merge(daily, ["tld"], "month")).select("tld", "period", "n", "price_avg", "bids_avg"))


@query(f"{L} SELECT category, count(*) AS n, near(avg(price)) AS price_avg FROM l WHERE tld = 'brand5' GROUP BY ALL")
def rollup_route(spark, d):
    rows = listings(spark, d)
    catalog = rollups.Catalog([rollups.Rollup(n, rollups.build(rows, "ends_at", g, dims, ["price", "bids"]), tuple(dims), g, ("price", "bids"), size) for n, dims, g, size in (("by_tld", ["tld"], "day", 100), ("by_tld_category", ["tld", "category"], "day", 600), ("by_all", ["tld", "category", "type_id"], "hour", 9000))])
    return rounded(catalog.aggregate(["category"], ["price"], {"tld": "brand5"}).select("category", "n", "price_avg"))


def _range_catalog(spark, d):
    rows = listings(spark, d)
    made = [rollups.Rollup(f"by_{g}", rollups.build(rows, "ends_at", g, dims, ["price", "bids"]), tuple(dims), g, ("price", "bids"), n) for g, dims, n in (("month", ["tld"], 100), ("day", ["tld", "category"], 9000), ("hour", ["tld", "category"], 90000))]
    return rollups.Catalog(made, rows, "ends_at")


@query(f"""{L} SELECT tld, count(*) AS n, near(avg(price)) AS price_avg, min(price) AS price_min, max(price) AS price_max, CAST(sum(bids) AS DOUBLE) AS bids_sum FROM l WHERE ends_at >= TIMESTAMP '1996-02-27 13:30:00' AND ends_at < TIMESTAMP '2000-09-03 02:15:00' GROUP BY ALL""")
def rollup_range(spark, d):
    """A range with odd ends: minutes from the base table, hours, days and months from their rollups."""
    out = _range_catalog(spark, d).aggregate_range(["tld"], ["price", "bids"], datetime(1996, 2, 27, 13, 30), datetime(2000, 9, 3, 2, 15))
    return rounded(out.select("tld", "n", "price_avg", F.col("price__min").alias("price_min"), F.col("price__max").alias("price_max"), F.col("bids__sum").alias("bids_sum")), price_min=2, price_max=2)


@query(f"""{L}, c AS (SELECT CAST(date_trunc('month', ends_at) AS DATE) AS period, sld AS value, count(*) AS n FROM l GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""")
def rollup_frequent(spark, d):
    """The most frequent names of each month, from sketches of days and types: as there are fewer names than a sketch tracks, its counts are exact."""
    daily = rollups.build(listings(spark, d), "ends_at", "day", ["type_id"], [], frequent=["sld"])
    return rollups.frequent(rollups.merge(daily, [], "month"), ["period"], "sld", 3)


@query(f"""{L}, a AS (SELECT tld, price, epoch({_NOW}) - epoch(ends_at) AS age FROM l)
    SELECT tld, {", ".join(f"count(*) FILTER (age < {s}) AS n_{n}, round(coalesce(sum(price) FILTER (age < {s}), 0), 2) AS sum_{n}" for n, s in rollups.WINDOWS.items())} FROM a WHERE age >= 0 AND age < 7776000 GROUP BY ALL""")
def rollup_multi_period(spark, d):
    return rounded(rollups.multi_period(listings(spark, d), ["tld"], "price", "ends_at", AS_OF), **{f"sum_{n}": 2 for n in rollups.WINDOWS})


@query("SELECT CAST(floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts))) AS BIGINT) AS lag_s, floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts))) > 3600 AS breach FROM events")
def rollup_freshness(spark, d):
    return rollups.freshness(load(spark, d, "events"), "ts", datetime(2024, 2, 1), 3600)


# -- rails

_RAIL_SQL = f"""{AUCTIONS_SQL}, e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events),
    act AS (SELECT *, CAST(epoch(ends_at) - epoch({_NOW}) AS BIGINT) AS left_s FROM l WHERE ends_at > {_NOW}), k AS (SELECT auction_id, CAST(row_number() OVER (ORDER BY auction_id) AS BIGINT) - 1 AS item FROM act),
    b AS (SELECT auction_id, ts, user_id FROM e JOIN k USING (item) WHERE event_type IN ('click', 'purchase')), w AS (SELECT auction_id, ts, user_id FROM e JOIN k USING (item) WHERE event_type IN ('view', 'signup')),
    b4 AS (SELECT * FROM b WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 4 HOURS AND ts <= TIMESTAMP '2024-01-30'), w1 AS (SELECT auction_id, count(*) AS w FROM w WHERE CAST(ts AS DATE) = DATE '2024-01-29' GROUP BY ALL)"""


def _frames(spark, d):
    """Auctions, bids and watches; events name active auctions by their place in order of id. Auctions past the last place named have no events."""
    auctions, e = listings(spark, d, latest=True), events(spark, d)
    named = (e.agg(F.max("item")).first()[0] or 0) + 1
    first = windows.top_n(rails.active(auctions, AS_OF).select("auction_id"), [F.col("auction_id")], named)
    keys = first.select("auction_id", (F.row_number().over(Window.orderBy("auction_id")) - 1).cast("long").alias("item"))
    e = e.join(F.broadcast(keys) if named <= DIMENSION else keys, "item").select("auction_id", "ts", "user_id", "event_type")
    return auctions, e.where(F.col("event_type").isin("click", "purchase")), e.where(F.col("event_type").isin("view", "signup"))


def _rail(name: str, rows: str, score: str, order: str):
    sql = f"WITH {_RAIL_SQL}, x AS ({rows}), y AS (SELECT auction_id, CAST({score} AS DOUBLE) AS score, row_number() OVER (ORDER BY {order}, auction_id) AS rank FROM x) SELECT '{name}' AS rail, auction_id, near(score) AS score, CAST(rank AS INTEGER) AS rank FROM y WHERE rank <= 50"

    def register(f):
        def run(spark, d):
            return rounded(f(*_frames(spark, d)))

        run.__name__ = f"rail_{name}"
        query(sql)(run)
        return f

    return register


YESTERDAY = datetime(2024, 1, 29, 23, 59, 59)
_CAP = "least(1, greatest(0, {0}))"


@_rail("trending", "SELECT auction_id, n FROM act JOIN (SELECT auction_id, count(*) AS n FROM b4 GROUP BY ALL) USING (auction_id)", "n", "n DESC")
def _trending(a, b, w):
    return rails.trending(a, b, AS_OF, EVENTS_AS_OF)


@_rail("ending_soon", "SELECT * FROM act WHERE left_s <= 604800 AND price > 0", _CAP.format("1 - left_s / 604800"), "left_s")
def _ending(a, b, w):
    return rails.ending_soon(a, AS_OF)


@_rail("last_hour", "SELECT * FROM (SELECT auction_id, price, CAST(epoch(ends_at) - epoch(TIMESTAMP '2001-05-31 23:30:00') AS BIGINT) AS left_s FROM l) WHERE left_s > 0 AND left_s <= 3600 AND price > 0", _CAP.format("1 - left_s / 3600"), "left_s")
def _hour(a, b, w):
    return rails.last_hour(a, datetime(2001, 5, 31, 23, 30))


@_rail("latest", "SELECT * FROM act WHERE left_s <= 604800", "bids", "left_s DESC")
def _latest(a, b, w):
    return rails.latest(a, AS_OF)


@_rail("high_volume", "SELECT auction_id, bids + coalesce(w, 0) AS v FROM act LEFT JOIN w1 USING (auction_id) WHERE bids >= 5 OR coalesce(w, 0) >= 3", _CAP.format("v / 100"), "v DESC")
def _volume(a, b, w):
    return rails.high_volume(a, w, AS_OF, YESTERDAY)


@_rail("fresh", "SELECT * FROM act WHERE bids = 0", _CAP.format("left_s / 604800"), "left_s DESC")
def _fresh(a, b, w):
    return rails.fresh(a, AS_OF)


@_rail("last_week", "SELECT * FROM act WHERE left_s > 604800", _CAP.format("bids / 100"), "left_s")
def _week(a, b, w):
    return rails.last_week(a, AS_OF)


@_rail("watch_density", "SELECT auction_id, w FROM act JOIN w1 USING (auction_id)", _CAP.format("w / 50"), "w DESC")
def _density(a, b, w):
    return rails.watch_density(a, w, AS_OF, YESTERDAY)


@_rail("high_traffic", "SELECT auction_id, 2 * coalesce(n, 0) + coalesce(w, 0) AS v FROM act LEFT JOIN (SELECT auction_id, count(*) AS n FROM b4 GROUP BY ALL) USING (auction_id) LEFT JOIN w1 USING (auction_id) WHERE 2 * coalesce(n, 0) + coalesce(w, 0) > 0", _CAP.format("v / 100"), "v DESC")
def _traffic(a, b, w):
    # today's watches are those of the day before the events' end, as in the SQL
    rows = rails.active(a, AS_OF).join(rails._count(rails._recent(b, EVENTS_AS_OF, 4 * 3600), "b"), "auction_id", "left").join(rails._count(rails._today(w, YESTERDAY), "w"), "auction_id", "left")
    mix = 2 * F.coalesce("b", F.lit(0)) + F.coalesce("w", F.lit(0))
    return rails.rail(rows.withColumn("mix", mix).where("mix > 0"), "high_traffic", rails.capped(F.col("mix") / 100), [F.desc("mix")])


@_rail("competitive", "SELECT auction_id, r FROM act JOIN (SELECT auction_id, count(DISTINCT user_id) AS r FROM b4 GROUP BY ALL HAVING count(DISTINCT user_id) >= 2) USING (auction_id)", "r", "r DESC")
def _competitive(a, b, w):
    return rails.competitive(a, b, AS_OF, EVENTS_AS_OF)


@_rail("opportunity", "SELECT auction_id, w FROM act JOIN w1 USING (auction_id) WHERE w >= 2 AND auction_id NOT IN (SELECT auction_id FROM b4)", "w", "w DESC")
def _opportunity(a, b, w):
    rows = rails.active(a, AS_OF).join(rails._count(rails._today(w, YESTERDAY), "w").where("w >= 2"), "auction_id")
    return rails.rail(rows.join(rails._recent(b, EVENTS_AS_OF, 4 * 3600).select("auction_id"), "auction_id", "left_anti"), "opportunity", F.col("w"), [F.desc("w")])


@query(f"""WITH {_RAIL_SQL}, r1 AS (SELECT auction_id, row_number() OVER (ORDER BY left_s, auction_id) AS rank FROM act WHERE left_s <= 604800 AND price > 0 QUALIFY rank <= 50), r2 AS (SELECT auction_id, row_number() OVER (ORDER BY left_s DESC, auction_id) AS rank FROM act WHERE left_s <= 604800 QUALIFY rank <= 50),
    u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2), f AS (SELECT auction_id, sum(1 / (60 + rank)) AS score, count(*) AS rails FROM u GROUP BY ALL) SELECT auction_id, round(score, 8) AS score, rails FROM f ORDER BY f.score DESC, auction_id LIMIT 150""")
def rail_compose(spark, d):
    a = listings(spark, d, latest=True)
    return rounded(rails.fuse([rails.ending_soon(a, AS_OF), rails.latest(a, AS_OF)]), score=8)


@query(f"""WITH {_RAIL_SQL}, r1 AS (SELECT 'ending_soon' AS rail, 0 AS place, auction_id, row_number() OVER (ORDER BY left_s, auction_id) AS rank FROM act WHERE left_s <= 604800 AND price > 0 QUALIFY rank <= 50), r2 AS (SELECT 'latest' AS rail, 1 AS place, auction_id, row_number() OVER (ORDER BY left_s DESC, auction_id) AS rank FROM act WHERE left_s <= 604800 QUALIFY rank <= 50),
    u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY auction_id ORDER BY place, rank) = 1) SELECT rail, place, auction_id, CAST(row_number() OVER (PARTITION BY place ORDER BY rank) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY place ORDER BY rank) <= 10""")
def rail_landing(spark, d):
    a = listings(spark, d, latest=True)
    return rails.landing([rails.ending_soon(a, AS_OF), rails.latest(a, AS_OF)])


# -- enrichers


@query(f"{_TLD_MONTH}, p AS (SELECT *, lag(total) OVER (PARTITION BY tld ORDER BY period) AS prev FROM s) SELECT tld, period, near(round(CASE WHEN prev <> 0 THEN 100 * (total - prev) / prev END, 4)) AS growth_pct FROM p")
def enr_growth(spark, d):
    return rounded(windows.consecutive_growth(_tld_month(spark, d), "tld", "period", "total").select("tld", "period", "growth_pct"))


@query(f"{_TLD_MONTH}, z AS (SELECT tld, period, (total - avg(total) OVER (PARTITION BY tld)) / stddev_pop(total) OVER (PARTITION BY tld) AS z FROM s) SELECT tld, period, abs(z) > 2.0 AS is_anomaly FROM z")
def enr_anomaly_flag(spark, d):
    w = Window.partitionBy("tld")
    scored = _tld_month(spark, d).withColumn("z", (F.col("total") - F.avg("total").over(w)) / F.stddev_pop("total").over(w))
    return windows.anomaly_flag(scored, "z", 2.0).select("tld", "period", "is_anomaly")


@query(f"{_TLD_MONTH} SELECT tld, period, CAST(rank() OVER (PARTITION BY period ORDER BY n DESC) AS INTEGER) AS rank FROM s")
def enr_rank(spark, d):
    return windows.competition_rank(_tld_month(spark, d), ["period"], "n").select("tld", "period", "rank")


@query(f"{_TLD_MONTH}, i AS (SELECT tld, CAST(row_number() OVER (PARTITION BY tld ORDER BY period) - 1 AS DOUBLE) AS i, total AS y FROM s) SELECT tld, near(regr_intercept(y, i) + regr_slope(y, i) * (max(i) + 3)) AS forecast FROM i GROUP BY ALL")
def enr_forecast(spark, d):
    return rounded(windows.index_forecast(_tld_month(spark, d), "tld", "period", "total", 3).select("tld", "forecast"))


@query("""WITH s AS (SELECT o_custkey, CAST(DATE '2001-06-01' - CAST(min(o_orderdate) AS DATE) AS INTEGER) AS age, CAST(DATE '2001-06-01' - CAST(max(o_orderdate) AS DATE) AS INTEGER) AS idle FROM orders GROUP BY ALL)
    SELECT o_custkey, CASE WHEN age <= 30 THEN 'new' WHEN idle <= 30 THEN 'active' WHEN idle <= 90 THEN 'dormant' WHEN idle <= 180 THEN 'at_risk' ELSE 'churned' END AS stage FROM s""")
def enr_lifecycle_stage(spark, d):
    day = F.lit(AS_OF)
    s = load(spark, d, "orders").groupBy("o_custkey").agg(F.datediff(day, F.min("o_orderdate")).alias("age"), F.datediff(day, F.max("o_orderdate")).alias("idle"))
    return s.select("o_custkey", t.stage(F.col("age"), F.col("idle"), 30, 30, 90).alias("stage"))


@query(f"{L} SELECT auction_id, bids, CASE WHEN bids >= 30 THEN 'high' WHEN bids >= 10 THEN 'medium' ELSE 'low' END AS heat FROM l")
def enr_heat(spark, d):
    return listings(spark, d).select("auction_id", "bids", enrich.heat(F.col("bids"), 30, 10).alias("heat"))


def _looked_up(name: str, kinds: tuple[str, ...], expr_sql: str, agg):
    inside = ", ".join(f"'{k}'" for k in kinds)

    def run(spark, d):
        dim = events(spark, d).where(F.col("event_type").isin(*kinds)).groupBy(F.col("item").alias("p_partkey")).agg(agg().alias("found"))
        return enrich.lookup(load(spark, d, "part").select("p_partkey"), dim, "p_partkey", {"found": 0})

    run.__name__ = name
    query(f"{E}, x AS (SELECT item, {expr_sql} AS found FROM e WHERE event_type IN ({inside}) GROUP BY ALL) SELECT p_partkey, coalesce(found, 0) AS found FROM part LEFT JOIN x ON item = p_partkey")(run)


_looked_up("enr_watcher_count", ("view", "signup"), "count(*)", lambda: F.count("*"))
_looked_up("enr_unique_bidders", ("click", "purchase"), "count(DISTINCT user_id)", lambda: F.countDistinct("user_id"))


@query(f"""{L}, q AS (SELECT tld, list_sort(list(price))[CAST(least(floor(0.25 * count(*)), count(*) - 1) + 1 AS BIGINT)] AS p25, list_sort(list(price))[CAST(least(floor(0.75 * count(*)), count(*) - 1) + 1 AS BIGINT)] AS p75 FROM l GROUP BY ALL)
    SELECT p_partkey, p25, p75 FROM part LEFT JOIN q ON lower(replace(p_brand, '#', '')) = tld""")
def enr_fair_value_band(spark, d):
    from lotwise.functions import quantiles

    band = quantiles.grouped(listings(spark, d), ["tld"], "price", {"p25": 0.25, "p75": 0.75})
    parts = load(spark, d, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("tld"))
    return enrich.lookup(parts, band, "tld", {"p25": None, "p75": None}).select("p_partkey", "p25", "p75")


@query(f"{_TLD_MONTH}, p AS (SELECT *, lag(total) OVER (PARTITION BY tld ORDER BY period) AS prev FROM s), g AS (SELECT *, CASE WHEN prev <> 0 THEN 100 * (total - prev) / prev END AS pct FROM p) SELECT tld, period, CASE WHEN pct IS NULL THEN 'unknown' WHEN pct > 5 THEN 'rising' WHEN pct < -5 THEN 'falling' ELSE 'stable' END AS momentum FROM g")
def enr_tld_momentum(spark, d):
    before = F.lag("total").over(Window.partitionBy("tld").orderBy("period"))
    return _tld_month(spark, d).select("tld", "period", enrich.momentum(F.col("total"), before).alias("momentum"))


@query(f"{L}, s AS (SELECT registrar, avg(sold) AS rate FROM l GROUP BY ALL) SELECT registrar, CASE WHEN rate >= 0.6 THEN 'high' WHEN rate >= 0.3 THEN 'medium' ELSE 'low' END AS tier FROM s")
def enr_sell_through(spark, d):
    rates = listings(spark, d).groupBy("registrar").agg((F.sum("sold") / F.count("*")).alias("rate"))
    return rates.select("registrar", enrich.sell_through_tier(F.col("rate")).alias("tier"))


@query(f"{L}, h AS (SELECT auction_id, ends_at, (epoch(ends_at) - epoch({_NOW})) / 3600 AS hours FROM l) SELECT auction_id, ends_at, CASE WHEN hours < 1 THEN 'critical' WHEN hours < 6 THEN 'high' WHEN hours < 24 THEN 'medium' ELSE 'low' END AS urgency FROM h")
def enr_time_urgency(spark, d):
    return listings(spark, d).select("auction_id", "ends_at", enrich.urgency(F.col("ends_at"), AS_OF).alias("urgency"))


@query(f"{_TLD_MONTH}, p AS (SELECT *, lag(total) OVER (PARTITION BY tld ORDER BY period) AS prev FROM s) SELECT tld, period, near(round(CASE WHEN prev <> 0 THEN 100 * (total - prev) / prev END, 4)) AS growth_pct, CAST(rank() OVER (PARTITION BY period ORDER BY n DESC) AS INTEGER) AS rank FROM p")
def enr_pipeline(spark, d):
    chain = enrich.Pipeline().then(lambda x: windows.consecutive_growth(x, "tld", "period", "total")).then(lambda x: windows.competition_rank(x, ["period"], "n"))
    return rounded(chain(_tld_month(spark, d)).select("tld", "period", "growth_pct", "rank"))


@query("""WITH m AS (SELECT min(p_size) a, max(p_size) b, min(p_retailprice) c, max(p_retailprice) e FROM part) SELECT p_partkey, near(0.5 * (p_size - a) / (b - a) + 0.5 * (p_retailprice - c) / (e - c)) AS composite FROM part, m""")
def enr_composite_score(spark, d):
    scored = enrich.composite_score(load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), {"p_size": 0.5, "p_retailprice": 0.5})
    return rounded(scored.select("p_partkey", "composite"))


@query(f"""{L}, s AS (SELECT tld, CAST(date_trunc('week', ends_at) AS DATE) AS week, count(*) AS n, avg(price) AS m, avg(sold) AS rate FROM l WHERE ends_at > {_NOW} - INTERVAL 91 DAYS AND ends_at <= {_NOW} GROUP BY ALL), p AS (SELECT *, lag(m) OVER (PARTITION BY tld ORDER BY week) AS prev FROM s),
    x AS (SELECT *, CASE WHEN stddev_pop(m) OVER (PARTITION BY tld) > 1e-9 THEN (m - avg(m) OVER (PARTITION BY tld)) / stddev_pop(m) OVER (PARTITION BY tld) END AS z, CAST(row_number() OVER (PARTITION BY tld ORDER BY week) - 1 AS DOUBLE) AS i FROM p),
    f AS (SELECT tld, CASE WHEN count(*) >= 3 THEN regr_intercept(m, i) + regr_slope(m, i) * (max(i) + 1) END AS forecast FROM x GROUP BY ALL)
    SELECT x.tld, week, n, near(m) AS mean_price, near(rate) AS rate, near(round(CASE WHEN prev <> 0 THEN 100 * (m - prev) / prev END, 4)) AS growth_pct, near(z) AS z, abs(z) > 2.5 AS is_anomaly,
        CASE WHEN coalesce(prev, 0) = 0 THEN 'unknown' WHEN 100 * (m - prev) / prev > 5 THEN 'rising' WHEN 100 * (m - prev) / prev < -5 THEN 'falling' ELSE 'stable' END AS momentum, CASE WHEN rate >= 0.6 THEN 'high' WHEN rate >= 0.3 THEN 'medium' ELSE 'low' END AS tier, near(forecast) AS forecast
    FROM x JOIN f ON x.tld = f.tld""")
def tbl_tld_features(spark, d):
    return rounded(enrich.tld_features(listings(spark, d), AS_OF))


_TWO_MONTHS = "avg(price) FILTER (ends_at > TIMESTAMP '2001-05-02' AND ends_at <= TIMESTAMP '2001-06-01') AS now, avg(price) FILTER (ends_at > TIMESTAMP '2001-04-02' AND ends_at <= TIMESTAMP '2001-05-02') AS before"


@query(f"""{A}, e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, user_id, event_type FROM events), a AS (SELECT *, auction_id % 150 AS item FROM l WHERE ends_at > {_NOW} ORDER BY bids DESC, price DESC, auction_id LIMIT 50000),
    w AS (SELECT item, count(*) AS n FROM e WHERE event_type IN ('view', 'signup') GROUP BY ALL), b AS (SELECT item, count(DISTINCT user_id) AS n FROM e WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
    q AS (SELECT tld, list_sort(list(price))[CAST(least(floor(0.25 * count(*)), count(*) - 1) + 1 AS BIGINT)] AS p25, list_sort(list(price))[CAST(least(floor(0.75 * count(*)), count(*) - 1) + 1 AS BIGINT)] AS p75 FROM l GROUP BY ALL),
    m AS (SELECT tld, {_TWO_MONTHS} FROM l GROUP BY ALL), r AS (SELECT registrar, avg(sold) AS rate FROM l WHERE registrar % 6 > 0 GROUP BY ALL)
    SELECT auction_id, CAST(rank() OVER (PARTITION BY a.tld ORDER BY price DESC) AS INTEGER) AS tld_rank, CASE WHEN bids >= 30 THEN 'high' WHEN bids >= 10 THEN 'medium' ELSE 'low' END AS heat, coalesce(w.n, 0) AS watchers, coalesce(b.n, 0) AS bidders,
        CASE WHEN price < p25 THEN 'below' WHEN price > p75 THEN 'above' ELSE 'fair' END AS fair_value, CASE WHEN now IS NULL OR coalesce(before, 0) = 0 THEN 'unknown' WHEN 100 * (now - before) / before > 5 THEN 'rising' WHEN 100 * (now - before) / before < -5 THEN 'falling' ELSE 'stable' END AS tld_momentum,
        CASE WHEN rate IS NULL THEN 'unknown' WHEN rate >= 0.6 THEN 'high' WHEN rate >= 0.3 THEN 'medium' ELSE 'low' END AS tier
    FROM a LEFT JOIN w ON a.item = w.item LEFT JOIN b ON a.item = b.item LEFT JOIN q ON a.tld = q.tld LEFT JOIN m ON a.tld = m.tld LEFT JOIN r ON a.registrar = r.registrar""")
def tbl_auction_features(spark, d):
    from lotwise.functions import quantiles

    a, e = listings(spark, d, latest=True), events(spark, d)
    dims = {
        "watchers": e.where(F.col("event_type").isin("view", "signup")).groupBy("item").agg(F.count("*").alias("n")),
        "bidders": e.where(F.col("event_type").isin("click", "purchase")).groupBy("item").agg(F.countDistinct("user_id").alias("n")),
        "bands": quantiles.grouped(a, ["tld"], "price", {"p25": 0.25, "p75": 0.75}),
        "momenta": a.groupBy("tld").agg(*[F.avg(F.when((F.col("ends_at") > F.lit(x)) & (F.col("ends_at") <= F.lit(y)), F.col("price"))).alias(n) for n, x, y in (("now", datetime(2001, 5, 2), datetime(2001, 6, 1)), ("before", datetime(2001, 4, 2), datetime(2001, 5, 2)))]),
        "rates": a.where("registrar % 6 > 0").groupBy("registrar").agg(F.avg("sold").alias("rate")),
    }
    out = enrich.auction_features(a.withColumn("item", F.col("auction_id") % 150), AS_OF, **dims)
    return out.select("auction_id", "tld_rank", "heat", "watchers", "bidders", "fair_value", "tld_momentum", "tier")


@query(f"""{L}, s AS (SELECT *, traffic * bids AS visits, CASE WHEN backlinks > 70 THEN backlinks ELSE 0 END AS volume, 3 * authority AS pages FROM l)
    SELECT auction_id, price, round(0.4 * ln(1 + visits) + 0.25 * ln(1 + volume) + 0.15 * ln(1 + 10 * authority) + 0.1 * ln(1 + pages) + 0.05 * ln(1 + price), 4) AS proxy, visits > 0 OR volume > 0 OR pages > 100 AS has_signal,
    CASE WHEN visits >= 10000 THEN 4 WHEN visits >= 1000 THEN 3 WHEN visits >= 100 THEN 2 WHEN visits >= 1 OR volume > 0 THEN 1 ELSE 0 END AS tier FROM s""")
def ftr_traffic_proxy(spark, d):
    volume = F.when(F.col("backlinks") > 70, F.col("backlinks")).otherwise(0)
    p = enrich.traffic_proxy(visits=F.col("traffic") * F.col("bids"), search_volume=volume, authority=F.col("authority"), indexed_pages=3 * F.col("authority"), revenue=F.col("price") / 100)
    return listings(spark, d).select("auction_id", F.round("price", 2).alias("price"), p.alias("p")).select("auction_id", "price", "p.proxy", "p.has_signal", "p.tier")


@query("""SELECT doc_id, CAST(CASE WHEN n_chars > 1000 THEN n_chars WHEN n_chars > 300 THEN floor(n_chars * 2.14) ELSE doc_id END AS DOUBLE) AS traffic FROM documents""")
def ftr_traffic_proxy_lake(spark, d):
    n = F.col("n_chars")
    return rounded(load(spark, d, "documents").select("doc_id", enrich.best_traffic(F.when(n > 1000, n), F.when(n > 300, n), F.col("doc_id")).alias("traffic")))


@query(f"{E} SELECT item, count(*) AS bids FROM e WHERE event_type IN ('click', 'purchase') AND ts > TIMESTAMP '2024-01-30' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-30' GROUP BY ALL")
def ftr_bid_velocity_1h(spark, d):
    return enrich.windowed_count(events(spark, d).where(F.col("event_type").isin("click", "purchase")), "item", "ts", EVENTS_AS_OF, 1, "bids")


@query(f"{E} SELECT item, count(*) AS watches, count(*) FILTER (event_type = 'signup') AS bidder_watches, near(count(*) FILTER (event_type = 'signup') / count(*)) AS density FROM e WHERE event_type IN ('view', 'signup') AND CAST(ts AS DATE) = DATE '2024-01-29' GROUP BY ALL")
def ftr_watch_density_1d(spark, d):
    w = events(spark, d).where(F.col("event_type").isin("view", "signup"))
    out = enrich.watch_density(w, "item", "ts", F.col("event_type") == "signup", datetime(2024, 1, 29))
    return rounded(out.withColumn("density", F.col("bidder_watches") / F.col("watches")))


@query(f"{E} SELECT item, count(DISTINCT user_id) AS bidders FROM e WHERE event_type IN ('click', 'purchase') AND ts > TIMESTAMP '2024-01-30' - INTERVAL 4 HOURS AND ts <= TIMESTAMP '2024-01-30' GROUP BY ALL")
def ftr_unique_bidders_4h(spark, d):
    return enrich.unique_in_window(events(spark, d).where(F.col("event_type").isin("click", "purchase")), "item", "user_id", "ts", EVENTS_AS_OF, 4)


@query(f"{E} SELECT item, count(*) FILTER (value >= 5) - count(*) FILTER (value < 5) AS net_watches FROM e WHERE event_type IN ('view', 'signup') AND CAST(ts AS DATE) = DATE '2024-01-29' GROUP BY ALL")
def ftr_net_watch_delta_1d(spark, d):
    w = events(spark, d).where(F.col("event_type").isin("view", "signup"))
    return enrich.net_watch_delta(w, "item", "ts", F.col("value") < 5, datetime(2024, 1, 29))
