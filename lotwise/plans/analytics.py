"""Queries of the analytics templates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lotwise.operators import templates as t
from lotwise.session import load

from .views import EVENTS_SQL, LISTINGS_SQL, events, listings, query, rounded

L, E = f"WITH {LISTINGS_SQL}", f"WITH {EVENTS_SQL}"
MONTH = "CAST(date_trunc('month', ends_at) AS DATE)"
DAY = "CAST(ts AS DATE)"
AS_OF = datetime(2001, 6, 1)
EVENTS_AS_OF = datetime(2024, 1, 30)


@query(f"""{L}, s AS (SELECT tld AS entity, {MONTH} AS period, sum(price) AS total FROM l GROUP BY ALL),
    g AS (SELECT *, CAST(lag(total, 1, 0) OVER (PARTITION BY entity ORDER BY period) AS DOUBLE) AS previous FROM s)
    SELECT entity, period, round(total, 2) AS total, round(previous, 2) AS previous, near(CASE WHEN previous > 0 THEN 100 * (total - previous) / previous END) AS growth_pct FROM g""")
def agg_growth_rate(spark, d):
    return rounded(t.growth_rate(listings(spark, d), "tld", "price", "ends_at"), total=2, previous=2)


@query(f"""{L}, s AS (SELECT tld AS entity, {MONTH} AS period, sum(bids) AS total FROM l GROUP BY ALL),
    w AS (SELECT *, avg(total) OVER p AS mean, stddev_pop(total) OVER p AS deviation FROM s WINDOW p AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT entity, period, CAST(total AS BIGINT) AS total, near(mean) AS mean, near(deviation) AS deviation, near((total - mean) / deviation) AS z FROM w WHERE deviation > 1e-9 AND abs((total - mean) / deviation) > 1.5""")
def agg_anomaly(spark, d):
    return rounded(t.anomalies(listings(spark, d), "tld", "bids", "ends_at", "month", 6, 1.5))


@query(f"""{L} SELECT category, tld, {MONTH} AS period, count(*) AS n, round(sum(price), 2) AS total, near(avg(price)) AS mean, max(price) AS high, min(price) AS low, count(DISTINCT sld) AS n_distinct FROM l GROUP BY ALL""")
def agg_category_trend(spark, d):
    return rounded(t.category_trend(listings(spark, d), ["category", "tld"], "price", "sld", "ends_at"), total=2, high=2, low=2)


@query(f"""{L}, c AS (SELECT tld AS key, sum(price) AS current_total FROM l WHERE ends_at BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-06-01' GROUP BY ALL),
    p AS (SELECT tld AS key, sum(price) AS prior_total FROM l WHERE ends_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-06-01' GROUP BY ALL),
    j AS (SELECT coalesce(c.key, p.key) AS key, current_total, prior_total, coalesce(current_total, 0) AS a, coalesce(prior_total, 0) AS b FROM c FULL JOIN p ON c.key = p.key)
    SELECT key, round(current_total, 2) AS current_total, round(prior_total, 2) AS prior_total, round(a - b, 2) AS delta, near(CASE WHEN b <> 0 THEN 100 * (a - b) / b END) AS delta_pct FROM j""")
def agg_historical_comparison(spark, d):
    day = datetime
    return rounded(t.historical_comparison(listings(spark, d), "tld", "price", "ends_at", (day(2001, 1, 1), day(2001, 6, 1)), (day(2000, 1, 1), day(2000, 6, 1))), current_total=2, prior_total=2, delta=2)


@query(f"""{L} SELECT tld, category, {MONTH} AS period, round(sum(price), 2) AS price_sum, near(avg(price)) AS price_avg, max(price) AS price_max, CAST(sum(bids) AS BIGINT) AS bids_sum, near(avg(bids)) AS bids_avg, max(bids) AS bids_max FROM l GROUP BY ALL""")
def agg_time_window(spark, d):
    return rounded(t.time_window(listings(spark, d), ["tld", "category"], ["price", "bids"], "ends_at"), price_sum=2)


@query(f"""{E}, s AS (SELECT {DAY} AS period, count(DISTINCT user_id) AS users, count(*) AS events, count(DISTINCT event_type) AS kinds FROM e GROUP BY ALL)
    SELECT *, near(events / users) AS per_user, near(avg(events) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS rolling_events FROM s""")
def agg_user_engagement(spark, d):
    return rounded(t.user_engagement(events(spark, d), "user_id", "event_type", "ts"))


@query(f"""{E} SELECT user_id AS entity, count(*) AS n, round(sum(value), 2) AS total, max(value) AS high, min(ts) AS first_seen, max(ts) AS last_seen, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span_s
    FROM e WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 1440 MINUTES AND ts <= TIMESTAMP '2024-01-30' GROUP BY ALL""")
def agg_realtime_trending(spark, d):
    return rounded(t.realtime_trending(events(spark, d), "user_id", "value", "ts", EVENTS_AS_OF, 1440), total=2)


@query(f"""{L}, s AS (SELECT user_id AS entity, CAST(min(ends_at) AS DATE) AS first_day, CAST(max(ends_at) AS DATE) AS last_day, count(*) AS n FROM l GROUP BY ALL),
    g AS (SELECT *, CAST(DATE '2001-06-01' - first_day AS INTEGER) AS age_days, CAST(DATE '2001-06-01' - last_day AS INTEGER) AS idle_days FROM s)
    SELECT *, CASE WHEN age_days <= 30 THEN 'new' WHEN idle_days <= 30 THEN 'active' WHEN idle_days <= 90 THEN 'dormant' WHEN idle_days <= 180 THEN 'at_risk' ELSE 'churned' END AS stage FROM g""")
def agg_lifecycle(spark, d):
    return t.lifecycle(listings(spark, d), "user_id", "ends_at", AS_OF)


@query(f"""{L} SELECT {MONTH} AS period, count(*) FILTER (tld = 'brand1') AS n_a, count(*) FILTER (tld = 'brand2') AS n_b, near(avg(price) FILTER (tld = 'brand1')) AS mean_a, near(avg(price) FILTER (tld = 'brand2')) AS mean_b,
    near(coalesce(avg(price) FILTER (tld = 'brand1'), 0) - coalesce(avg(price) FILTER (tld = 'brand2'), 0)) AS delta FROM l WHERE tld IN ('brand1', 'brand2') GROUP BY ALL""")
def agg_comparative_cohort(spark, d):
    return rounded(t.comparative_cohort(listings(spark, d), "price", "ends_at", F.col("tld") == "brand1", F.col("tld") == "brand2"))


@query(f"""{L}, s AS (SELECT tld AS entity, {MONTH} AS period, CAST(sum(bids) AS DOUBLE) AS bids, sum(price) AS price, sum(govalue) AS govalue FROM l GROUP BY ALL),
    m AS (SELECT min(bids) b0, max(bids) b1, min(price) p0, max(price) p1, min(govalue) g0, max(govalue) g1 FROM s),
    n AS (SELECT entity, period, bids, price, govalue, (bids - b0) / (b1 - b0) AS bids_norm, (price - p0) / (p1 - p0) AS price_norm, (govalue - g0) / (g1 - g0) AS govalue_norm FROM s, m)
    SELECT entity, period, bids, round(price, 2) AS price, round(govalue, 2) AS govalue, near(bids_norm) AS bids_norm, near(price_norm) AS price_norm, near(govalue_norm) AS govalue_norm, near(0.5 * bids_norm + 0.3 * price_norm + 0.2 * govalue_norm) AS score FROM n""")
def agg_ranking_score(spark, d):
    return rounded(t.ranking_score(listings(spark, d), "tld", {"bids": 0.5, "price": 0.3, "govalue": 0.2}, "ends_at"), price=2, govalue=2, bids=0)


@query(f"""{L}, s AS (SELECT tld AS entity, {MONTH} AS period, avg(price) AS value FROM l GROUP BY ALL),
    k AS (SELECT entity, value, CAST(-row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS DOUBLE) AS x FROM s QUALIFY x >= -12)
    SELECT entity, count(*) AS n, near(regr_slope(value, x)) AS slope, near(corr(value, x)) AS corr, near(regr_intercept(value, x) + regr_slope(value, x) * 2) AS forecast FROM k GROUP BY entity HAVING count(*) >= 3""")
def agg_forecast(spark, d):
    return rounded(t.forecast(listings(spark, d), "tld", "price", "ends_at"))


@query(f"""{L}, w AS (SELECT sld, price, {MONTH} AS period, unnest(string_split(lower(sld), '-')) AS keyword FROM l)
    SELECT keyword, period, count(*) AS n, count(DISTINCT sld) AS labels, near(avg(price)) AS mean_price FROM w WHERE length(keyword) >= 3 GROUP BY ALL HAVING count(*) >= 2""")
def agg_keyword_trend(spark, d):
    return rounded(t.keyword_trend(listings(spark, d), "sld", "price", "ends_at"))


@query(f"""{L} SELECT tld, {MONTH} AS period, count(*) AS total, count(*) FILTER (sold = 1) AS sold, near(avg(price) FILTER (sold = 1)) AS mean_sale, round(sum(price) FILTER (sold = 1), 2) AS revenue, near(count(*) FILTER (sold = 1) / count(*)) AS rate FROM l GROUP BY ALL""")
def agg_sell_through(spark, d):
    return rounded(t.sell_through(listings(spark, d), ["tld"], "ends_at", "sold", "price"), revenue=2)


_AUTHORITY = "CASE WHEN authority < 10 THEN '0-9' WHEN authority < 25 THEN '10-24' WHEN authority < 40 THEN '25-39' ELSE '40+' END"
_TRAFFIC = "CASE WHEN traffic < 100 THEN 'low' WHEN traffic < 400 THEN 'some' WHEN traffic < 700 THEN 'much' ELSE 'most' END"


@query(f"""{L} SELECT {_AUTHORITY} AS authority_bucket, {_TRAFFIC} AS traffic_bucket, {MONTH} AS period, count(*) AS total, count(*) FILTER (sold = 1) AS sold, near(avg(price) FILTER (sold = 1)) AS mean_sale, round(sum(price) FILTER (sold = 1), 2) AS revenue, near(count(*) FILTER (sold = 1) / count(*)) AS rate FROM l GROUP BY ALL""")
def agg_seo_bucket(spark, d):
    return rounded(t.seo_bucket(listings(spark, d), "authority", "traffic", "ends_at", "sold", "price"), revenue=2)


@query(f"""{L} SELECT CASE WHEN bids < 1 THEN '0' WHEN bids < 5 THEN '1-4' WHEN bids < 15 THEN '5-14' WHEN bids < 30 THEN '15-29' ELSE '30+' END AS bid_bucket, {MONTH} AS period,
    count(*) AS total, count(*) FILTER (sold = 1) AS sold, near(avg(bids)) AS mean_bids, near(avg(price)) AS mean_price, near(avg(sold)) AS win_rate FROM l GROUP BY ALL""")
def agg_bid_distribution(spark, d):
    return rounded(t.bid_distribution(listings(spark, d), "bids", "ends_at", "sold", "price"))


@query(f"""{L} SELECT count(*) AS total, count(*) FILTER (sold = 1) AS sold, near(avg(price) FILTER (sold = 1)) AS mean_sale, near(quantile_cont(price, 0.5) FILTER (sold = 1)) AS median_sale, round(sum(price) FILTER (sold = 1), 2) AS revenue, near(avg(bids)) AS mean_bids, count(DISTINCT tld) AS tlds FROM l""")
def agg_market_summary(spark, d):
    return rounded(t.market_summary(listings(spark, d), "sold", "price", "bids", "tld"), revenue=2)


@query(f"""{L} SELECT tld, category, {MONTH} AS period, CAST(grouping(tld, category, {MONTH}) AS BIGINT) AS level, count(*) AS n, round(sum(price), 2) AS total, near(avg(price)) AS mean, max(price) AS high FROM l GROUP BY ROLLUP (tld, category, {MONTH})""")
def agg_rollup(spark, d):
    return rounded(t.rollup(listings(spark, d), ["tld", "category"], "price", "ends_at"), total=2)


def _element(q: float, v: str = "price") -> str:
    return f"list_sort(list({v}))[CAST(least(floor({q} * count(*)), count(*) - 1) + 1 AS BIGINT)]"


@query(f"""{L} SELECT tld, {MONTH} AS period, count(*) AS n, {", ".join(f"{_element(q)} AS {n}" for n, q in t.QUANTILES.items())} FROM l GROUP BY ALL""")
def agg_quantile_distribution(spark, d):
    return t.quantile_distribution(listings(spark, d), "tld", "price", "ends_at")


@query(f"""{E}, v AS (SELECT user_id, {DAY} AS period, ts FROM e WHERE event_type = 'view'), c AS (SELECT user_id, {DAY} AS period, ts FROM e WHERE event_type = 'click'), p AS (SELECT user_id, {DAY} AS period, ts FROM e WHERE event_type = 'purchase'),
    k AS (SELECT DISTINCT user_id, {DAY} AS period FROM e WHERE event_type IN ('view', 'click', 'purchase')),
    r AS (SELECT k.*, EXISTS (SELECT 1 FROM v WHERE v.user_id = k.user_id AND v.period = k.period) AS one,
          EXISTS (SELECT 1 FROM v JOIN c USING (user_id, period) WHERE v.user_id = k.user_id AND v.period = k.period AND c.ts > v.ts AND c.ts <= v.ts + INTERVAL 6 HOURS) AS two,
          EXISTS (SELECT 1 FROM v JOIN c USING (user_id, period) JOIN p USING (user_id, period) WHERE v.user_id = k.user_id AND v.period = k.period AND c.ts > v.ts AND p.ts > c.ts AND p.ts <= v.ts + INTERVAL 6 HOURS) AS three FROM k)
    SELECT period, CAST(1 AS INTEGER) AS level, count(*) AS entities FROM r WHERE one GROUP BY ALL UNION ALL SELECT period, 2, count(*) FROM r WHERE two GROUP BY ALL UNION ALL SELECT period, 3, count(*) FROM r WHERE three GROUP BY ALL""")
def agg_window_funnel(spark, d):
    return t.window_funnel(events(spark, d), "user_id", "event_type", "ts", ["view", "click", "purchase"], 6 * 3600)


@query(f"""{L}, c AS (SELECT {MONTH} AS period, tld AS value, count(*) AS n FROM l GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""")
def agg_topk_values(spark, d):
    return t.topk_values(listings(spark, d), "tld", "ends_at")


@query(f"""{L}, s AS (SELECT {MONTH} AS period, avg(price) AS mean FROM l GROUP BY ALL)
    SELECT period, near(mean) AS mean, near(avg(mean) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS moving FROM s""")
def agg_moving_average(spark, d):
    return rounded(t.moving_average(listings(spark, d), "price", "ends_at"))


@query(f"""{E}, h AS (SELECT item, date_trunc('hour', ts) AS hour, count(*) AS n FROM e WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
    r AS (SELECT item AS key, sum(n) AS recent FROM h WHERE hour > TIMESTAMP '2024-01-30' - INTERVAL 48 HOURS AND hour <= TIMESTAMP '2024-01-30' GROUP BY ALL),
    p AS (SELECT item AS key, sum(n) AS prior FROM h WHERE hour > TIMESTAMP '2024-01-30' - INTERVAL 96 HOURS AND hour <= TIMESTAMP '2024-01-30' - INTERVAL 48 HOURS GROUP BY ALL)
    SELECT r.key, CAST(recent AS BIGINT) AS recent, CAST(coalesce(prior, 0) AS BIGINT) AS prior, CAST(recent - coalesce(prior, 0) AS BIGINT) AS delta, near(CASE WHEN coalesce(prior, 0) <> 0 THEN recent / prior END) AS ratio FROM r LEFT JOIN p ON r.key = p.key""")
def agg_bid_velocity(spark, d):
    e = events(spark, d).where(F.col("event_type").isin("click", "purchase"))
    hourly = e.groupBy("item", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return rounded(t.velocity(hourly, "item", "hour", "n", EVENTS_AS_OF, 48))


@query(f"""{E}, w AS (SELECT item, count(*) AS watches, count(DISTINCT user_id) AS watchers FROM e WHERE event_type IN ('view', 'signup') GROUP BY ALL), b AS (SELECT item, count(*) AS bids, count(DISTINCT user_id) AS bidders FROM e WHERE event_type IN ('click', 'purchase') GROUP BY ALL)
    SELECT w.item, watches, watchers, coalesce(bids, 0) AS bids, coalesce(bidders, 0) AS bidders, near(coalesce(bidders, 0) / watchers) AS conversion FROM w LEFT JOIN b ON w.item = b.item""")
def agg_watch_bid_conversion(spark, d):
    e = events(spark, d)
    return rounded(t.watch_bid_conversion(e.where(F.col("event_type").isin("view", "signup")), e.where(F.col("event_type").isin("click", "purchase")), "item", "user_id", "user_id"))


@query(f"""{L}, h AS (SELECT type_id, greatest(0, CAST(CAST(ends_at AS DATE) - CAST(listed_at AS DATE) AS INTEGER)) AS hold, price FROM l)
    SELECT type_id, count(*) AS n, near(avg(hold)) AS mean_days, min(hold) AS min_days, max(hold) AS max_days, round(sum(price), 2) AS revenue FROM h GROUP BY ALL""")
def agg_hold_time(spark, d):
    from lotwise.operators.derive import hold_days

    return rounded(t.hold_time(listings(spark, d).withColumn("hold", hold_days("listed_at", "ends_at")), "type_id", "hold", "price"), revenue=2)


@query(f"""{E}, b AS (SELECT {DAY} AS period, event_type = 'error' AS c, value FROM e WHERE event_type IN ('click', 'purchase', 'error'))
    SELECT period, count(*) AS bids, count(*) FILTER (c) AS counters, near(avg(value) FILTER (c)) AS mean_counter, near(avg(value) FILTER (NOT c)) AS mean_plain, near(count(*) FILTER (c) / count(*)) AS rate, near(avg(value) FILTER (c) - avg(value) FILTER (NOT c)) AS price_delta FROM b GROUP BY ALL""")
def agg_counter_offer(spark, d):
    bids = events(spark, d).where(F.col("event_type").isin("click", "purchase", "error"))
    return rounded(t.counter_offers(bids, F.col("event_type") == "error", "value", "ts"))


@query(f"""{L}, r AS (SELECT tld, {MONTH} AS period, sale_price / price AS ratio, round(sale_price / price, 6) AS r6 FROM l WHERE price > 0)
    SELECT tld, period, near(avg(ratio)) AS mean_ratio, count(*) AS n, {", ".join(f"near({_element(q, 'r6')}) AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))} FROM r GROUP BY ALL""")
def agg_price_realization(spark, d):
    return rounded(t.price_realization(listings(spark, d), "tld", "sale_price", "price", "ends_at"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS buyer, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), f AS (SELECT buyer, min(month) AS cohort FROM a GROUP BY ALL),
    j AS (SELECT cohort, CAST(date_diff('month', cohort, month) AS INTEGER) AS k FROM a JOIN f USING (buyer)), s AS (SELECT cohort, count(*) AS size FROM f GROUP BY ALL)
    SELECT cohort, k, count(*) AS retained, any_value(size) AS size, near(count(*) / any_value(size)) AS rate FROM j JOIN s USING (cohort) WHERE k BETWEEN 0 AND 6 GROUP BY cohort, k""")
def agg_retention_cohorts(spark, d):
    return rounded(t.retention_cohorts(load(spark, d, "orders"), "o_custkey", "o_orderdate"))


@query(f"""{E} SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) AS INTEGER) AS weekday, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS sold, near(count(*) FILTER (event_type = 'purchase') / count(*)) AS rate FROM e GROUP BY ALL""")
def agg_timing_heatmap(spark, d):
    return rounded(t.timing_heatmap(events(spark, d), "ts", F.col("event_type") == "purchase"))


_LENGTH = "CASE WHEN length(sld) < 6 THEN '1-5' WHEN length(sld) < 9 THEN '6-8' WHEN length(sld) < 12 THEN '9-11' ELSE '12+' END"


@query(f"""{L} SELECT {_LENGTH} AS length_bucket, CASE WHEN regexp_full_match(sld, '[a-zA-Z-]+') THEN 'letters' WHEN regexp_full_match(sld, '[0-9-]+') THEN 'digits' ELSE 'mixed' END AS char_class,
    CAST(length(sld) - length(replace(sld, '-', '')) AS INTEGER) AS hyphens, count(*) AS n, near(avg(sold)) AS rate, max(price) AS max_price, {_element(0.5)} AS p50 FROM l GROUP BY ALL HAVING count(*) >= 2""")
def agg_name_structure(spark, d):
    return rounded(t.name_structure(listings(spark, d), "sld", "sold", "price"))


@query(f"""{L}, m AS (SELECT sld AS label, tld, avg(price) AS mean, count(*) AS n FROM l GROUP BY ALL)
    SELECT m.label, m.tld, near(m.mean) AS mean, m.n, near(r.mean) AS reference_mean, near(m.mean / r.mean) AS ratio FROM m JOIN m r ON m.label = r.label AND r.tld = 'brand1' WHERE m.tld <> 'brand1'""")
def agg_cross_tld_spread(spark, d):
    return rounded(t.cross_tld_spread(listings(spark, d), "sld", "tld", "price", "brand1"))


@query(f"""{E}, s AS (SELECT item AS key, event_id AS request_id, ts FROM e WHERE event_type = 'view'), b AS (SELECT item AS key, event_id AS sale_id, value AS amount, ts FROM e WHERE event_type = 'purchase'),
    m AS (SELECT s.key, request_id, sale_id, amount FROM s JOIN b ON s.key = b.key AND b.ts >= s.ts AND floor(epoch(b.ts)) - floor(epoch(s.ts)) <= 86400),
    q AS (SELECT key, count(DISTINCT request_id) AS requests FROM m GROUP BY ALL), o AS (SELECT key, count(*) AS sales, sum(amount) AS revenue FROM (SELECT DISTINCT key, sale_id, amount FROM m) GROUP BY ALL), a AS (SELECT key, count(DISTINCT request_id) AS asked FROM s GROUP BY ALL)
    SELECT a.key, asked, coalesce(requests, 0) AS requests, coalesce(sales, 0) AS sales, round(coalesce(revenue, 0), 2) AS revenue, near(coalesce(requests, 0) / asked) AS rate FROM a LEFT JOIN q ON a.key = q.key LEFT JOIN o ON a.key = o.key""")
def agg_search_attribution(spark, d):
    e = events(spark, d)
    signals = e.where("event_type = 'view'").select(F.col("item").alias("key"), F.col("event_id").alias("request_id"), "ts")
    sales = e.where("event_type = 'purchase'").select(F.col("item").alias("key"), F.col("event_id").alias("sale_id"), F.col("value").alias("amount"), "ts")
    return rounded(t.attribution(signals, sales, 24), revenue=2)


@query(f"""{L}, s AS (SELECT registrar AS holder, sum(price) AS total FROM l GROUP BY ALL), w AS (SELECT sum(total) AS whole FROM s)
    SELECT holder, round(total, 2) AS total, near(100 * total / whole) AS share_pct, near((100 * total / whole) * (100 * total / whole)) AS share_squared FROM s, w""")
def agg_hhi(spark, d):
    return rounded(t.concentration(listings(spark, d), "registrar", "price"), total=2)


@query(f"""{L} SELECT tld, {_LENGTH} AS length_bucket, count(*) AS n, {_element(0.25)} AS p25, {_element(0.5)} AS p50, {_element(0.75)} AS p75 FROM l GROUP BY ALL""")
def agg_comparable_price(spark, d):
    return t.comparable_price(listings(spark, d), "tld", "sld", "price")


@query(f"""{L}, p AS (SELECT category, {MONTH} AS period, sale_price - govalue AS profit, govalue FROM l)
    SELECT category, period, count(*) AS n, near(avg(profit)) AS mean_profit, near(avg(CASE WHEN govalue > 0 THEN 100 * profit / govalue END)) AS roi_pct, near(max(profit)) AS max_profit FROM p GROUP BY ALL""")
def agg_investor_roi(spark, d):
    return rounded(t.investor_roi(listings(spark, d), "category", "govalue", "sale_price", "ends_at"))


@query(f"""{L} SELECT tld, count(*) AS total, count(*) FILTER (bids > 0) AS with_bids, max(price) AS max_price, CAST(sum(bids) AS BIGINT) AS bids FROM l GROUP BY ALL ORDER BY total DESC, tld LIMIT 20""")
def agg_market_snapshot(spark, d):
    return t.market_snapshot(listings(spark, d), "tld", "price", "bids")


@query("""SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS entities, near(avg(o_totalprice)) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, round(sum(o_totalprice), 2) AS total, near(quantile_cont(o_totalprice, 0.5)) AS median FROM orders GROUP BY ALL""")
def agg_snapshot_history(spark, d):
    return rounded(t.snapshot_history(load(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderdate"), total=2)


@query(f"""{L}, s AS (SELECT tld, CAST(ends_at AS DATE) AS day, sum(bids) AS bids FROM l GROUP BY ALL)
    SELECT tld, CAST(sum(bids) AS BIGINT) AS bids FROM s WHERE day > DATE '2001-06-01' - 14 AND day <= DATE '2001-06-01' GROUP BY ALL HAVING sum(bids) > 0""")
def agg_live_tlds(spark, d):
    daily = listings(spark, d).groupBy("tld", F.to_date("ends_at").alias("day")).agg(F.sum("bids").alias("bids"))
    return t.live_keys(daily, "tld", "day", "bids", AS_OF)


@query(f"""{L}, r AS (SELECT price, CAST(epoch(ends_at) - epoch(TIMESTAMP '2001-06-01') AS DOUBLE) AS remaining FROM l)
    SELECT 'cheap' AS name, count(*) AS n, CASE WHEN count(*) >= 30 THEN list_sort(list(price))[CAST(greatest(ceil(0.25 * count(*)), 1) AS BIGINT)] ELSE 100.0 END AS ceiling FROM r WHERE price > 0
    UNION ALL SELECT 'expiring', count(*), CASE WHEN count(*) >= 30 THEN list_sort(list(remaining))[CAST(greatest(ceil(0.2 * count(*)), 1) AS BIGINT)] ELSE 86400.0 END FROM r WHERE remaining > 0""")
def agg_percentile_ceilings(spark, d):
    l = listings(spark, d).withColumn("remaining", (F.unix_timestamp("ends_at") - F.unix_timestamp(F.lit(AS_OF))).cast("double"))
    return t.percentile_ceilings(l, "price", "remaining", (100.0, 86400.0))


@query(f"""{L}, x AS (SELECT tld, price FROM l UNION ALL SELECT '_global', price FROM l) SELECT tld, count(*) AS n, list_sort(list(price))[CAST(greatest(ceil(0.5 * count(*)), 1) AS BIGINT)] AS baseline FROM x WHERE price > 0 GROUP BY ALL""")
def agg_market_baselines(spark, d):
    return t.market_baselines(listings(spark, d), "tld", "price")


@query(f"""{L}, s AS (SELECT tld, CAST(count(*) AS DOUBLE) AS n, avg(price) AS mean FROM l GROUP BY ALL), m AS (SELECT min(n) n0, max(n) n1, min(mean) m0, max(mean) m1 FROM s)
    SELECT tld, n, near(mean) AS mean, near(((n - n0) / (n1 - n0) + (mean - m0) / (m1 - m0)) / 2) AS activity FROM s, m""")
def agg_complement_scores(spark, d):
    return rounded(t.complement_scores(listings(spark, d), "tld", "price"))


@query("""WITH c AS (SELECT user_id, event_type AS v, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS k FROM c WHERE n >= 2 QUALIFY k <= 3),
    t AS (SELECT user_id, string_agg(v, ',' ORDER BY k) AS top FROM k GROUP BY ALL), b AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY ALL)
    SELECT left(sha256(CAST(user_id AS VARCHAR)), 12) AS user_hash, n, kinds, days, last_day, coalesce(top, '') AS top FROM b LEFT JOIN t USING (user_id)""")
def agg_user_vector(spark, d):
    return t.user_vector(events(spark, d), "user_id", "event_type", "ts")


@query("SELECT event_type AS kind, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def agg_signal_counts(spark, d):
    return t.signal_counts(events(spark, d), "event_type", "ts")


@query(f"""{E}, s AS (SELECT user_id, item, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM e), r AS (SELECT user_id, count(*) OVER (PARTITION BY user_id, item ORDER BY t RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS r FROM s)
    SELECT user_id AS user, CAST(sum(r) AS BIGINT) AS repeats FROM r GROUP BY ALL""")
def agg_repeat_queries(spark, d):
    return t.repeats(events(spark, d), "user_id", "item", "ts", 7)
