"""Queries of sources, sinks, merges, derived columns and filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lotwise.functions import filters as flt
from lotwise.operators import derive, etl
from lotwise.session import load
from lotwise.sources import lake, sinks

from .views import AUCTIONS_SQL, EVENTS_SQL, LISTINGS_SQL, events, listings, query, rounded

A, L, E = f"WITH {AUCTIONS_SQL}", f"WITH {LISTINGS_SQL}", f"WITH {EVENTS_SQL}"
AS_OF = datetime(2001, 6, 1)
EVENTS_AS_OF = datetime(2024, 1, 30)
BIDS, WATCHES = ("click", "purchase", "error"), ("view", "signup")


@query(f"""{L} SELECT auction_id, sld, tld, price, ends_at FROM l WHERE type_id IN (16, 20, 38, 39) AND trim(sld) <> '' AND ends_at >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAYS ORDER BY ends_at DESC, auction_id, price LIMIT 500""")
def src_seed_scan(spark, d):
    return lake.seed_scan(listings(spark, d), "ends_at", "sld", AS_OF, 90, types=(16, 20, 38, 39), newest=500, tie=["auction_id", "price"]).select("auction_id", "sld", "tld", "price", "ends_at")


@query("""SELECT p_partkey AS id, lower(p_name) AS label, coalesce(nullif(trim(lower(split_part(p_brand, '#', 2))), ''), 'none') AS tld, TRY_CAST(p_type AS DOUBLE) AS number FROM part""")
def src_seed_project(spark, d):
    p = load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label"), F.coalesce(F.nullif(F.trim(F.lower(F.split_part("p_brand", F.lit("#"), F.lit(2)))), F.lit("")), F.lit("none")).alias("tld"), F.col("p_type").try_cast("double").alias("number"))


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey, CAST(floor((rn - 1) / 1000) AS BIGINT) AS page FROM o""")
def set_page_number(spark, d):
    return etl.page_number(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders), p AS (SELECT o_orderkey, CAST(floor((rn - 1) / 1000) AS BIGINT) AS page FROM o) SELECT page, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM p GROUP BY ALL""")
def src_seed_page(spark, d):
    paged = etl.page_number(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)
    return paged.groupBy("page").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(f"""{E} SELECT b.event_id, b.item, b.user_id, b.value, w.event_id AS winning FROM e b LEFT JOIN (SELECT event_id FROM e WHERE event_type = 'purchase') w ON b.event_id = w.event_id WHERE b.event_type IN ('click', 'purchase', 'error') AND b.ts >= TIMESTAMP '2024-01-20' AND b.ts < TIMESTAMP '2024-01-30'""")
def src_bid_events(spark, d):
    e = events(spark, d)
    bids = e.where(F.col("event_type").isin(*BIDS))
    return lake.windowed(bids, "ts", datetime(2024, 1, 20), EVENTS_AS_OF).join(e.where("event_type = 'purchase'").select("event_id", F.col("event_id").alias("winning")), "event_id", "left").select("event_id", "item", "user_id", "value", "winning")


@query(f"""{E}, t AS (SELECT 'view' AS event_type, 1 AS watch_type, 'passive' AS label UNION ALL SELECT 'signup', 9, 'bidder') SELECT event_id, item, user_id, watch_type, label FROM e LEFT JOIN t USING (event_type) WHERE event_type IN ('view', 'signup') AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-30'""")
def src_watch_events(spark, d):
    w = lake.windowed(events(spark, d).where(F.col("event_type").isin(*WATCHES)), "ts", datetime(2024, 1, 20), EVENTS_AS_OF)
    return w.join(F.broadcast(lake.watch_types(spark)), "event_type", "left").select("event_id", "item", "user_id", "watch_type", "label")


def _latest_sql(keys: str, cols: str, where: str = "TRUE") -> str:
    return f"""{E} SELECT {keys}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC) AS rn FROM e WHERE {where}) WHERE rn = 1"""


@query(_latest_sql("item", "event_id, value", "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"))
def src_delta(spark, d):
    return etl.latest_in_window(events(spark, d), "item", "ts", datetime(2024, 1, 10), datetime(2024, 1, 20)).select("item", "event_id", "value")


@query(_latest_sql("user_id", "event_id, value, item", "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-30' AND event_type = 'view'"))
def src_enrichment_delta(spark, d):
    return etl.latest_in_window(events(spark, d).where("event_type = 'view'"), "user_id", "ts", datetime(2024, 1, 5), EVENTS_AS_OF).select("user_id", "event_id", "value", "item")


@query(f"""{E} SELECT item, count(DISTINCT user_id) AS searchers FROM e WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-30' - INTERVAL 14 DAYS AND ts <= TIMESTAMP '2024-01-30' GROUP BY ALL""")
def src_search_rollup(spark, d):
    return lake.distinct_seekers(events(spark, d).where("event_type = 'view'"), "item", "user_id", "ts", EVENTS_AS_OF, 14)


@query(f"""{E} SELECT item, count(DISTINCT user_id) AS searchers FROM e WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '2024-01-30' GROUP BY ALL""")
def stg_search_rollup(spark, d):
    return lake.distinct_seekers(events(spark, d).where("event_type = 'view'"), "item", "user_id", "ts", EVENTS_AS_OF, 7)


@query("""SELECT doc_id, lang, source, n_chars, round(0.4 * ln(1 + n_chars) + 0.25 * ln(1 + (doc_id % 97)), 4) AS proxy, CASE WHEN n_chars >= 10000 THEN 4 WHEN n_chars >= 1000 THEN 3 WHEN n_chars >= 100 THEN 2 WHEN n_chars >= 1 OR doc_id % 97 > 0 THEN 1 ELSE 0 END AS tier FROM documents""")
def src_documents(spark, d):
    from lotwise.operators.enrich import traffic_proxy

    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    p = traffic_proxy(visits=F.col("n_chars"), search_volume=F.col("doc_id") % 97)
    return docs.select("*", p["proxy"].alias("proxy"), p["tier"].alias("tier"))


@query("""SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'purchase' THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS signal FROM events ORDER BY ts DESC, event_id LIMIT 1000""")
def src_signal_json(spark, d):
    return lake.signals(load(spark, d, "events"), 1000)


@query(f"""{A} SELECT auction_id, sld, tld, price, bids, ends_at FROM l WHERE sld <> ''""")
def snk_seed_upsert(spark, d):
    rows = listings(spark, d, latest=True).where("sld <> ''")
    return sinks.stored(rows.select("auction_id", "sld", "tld", "price", "bids", "ends_at"), "seed_upsert")


@query("""SELECT CAST(o_orderdate AS DATE) AS snapshot_date, o_custkey AS entity, max(o_totalprice) AS price FROM orders GROUP BY ALL""")
def snk_snapshot_backfill(spark, d):
    o = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("snapshot_date"), F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("price"))
    half = o.where(F.col("entity") % 2 == 0)
    return etl.latest_per_key(half.unionByName(o), ["snapshot_date", "entity"], ["price"])


@query(f"""{E}, n AS (SELECT item AS custkey, value FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC) AS rn FROM e) WHERE rn = 1) SELECT c_custkey, c_name, coalesce(n.value, c_acctbal) AS c_acctbal FROM customer LEFT JOIN n ON c_custkey = n.custkey""")
def snk_delta_merge(spark, d):
    delta = etl.latest_per_key(events(spark, d), ["item"], ["ts"]).select(F.col("item").alias("c_custkey"), F.col("value").alias("c_acctbal"))
    return etl.merge_delta(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), delta, "c_custkey", ["c_acctbal"])


@query(_latest_sql("user_id, item", "event_id, value", "event_type IN ('click', 'purchase')"))
def snk_events(spark, d):
    bids = events(spark, d).where(F.col("event_type").isin("click", "purchase") & F.col("user_id").isNotNull())
    return sinks.stored(etl.upsert(bids.where("ts < '2024-01-15'"), bids.where("ts >= '2024-01-15'"), ["user_id", "item"], ["ts"]).select("user_id", "item", "event_id", "value"), "events")


@query("SELECT event_id, event_type, ts FROM events")
def snk_signals(spark, d):
    return sinks.stored(load(spark, d, "events").select("event_id", "event_type", "ts"), "signals")


@query(f"""{L} SELECT tld, count(*) AS n, near(avg(price)) AS mean FROM l GROUP BY ALL""")
def snk_feature_tables(spark, d):
    return rounded(sinks.stored(listings(spark, d).groupBy("tld").agg(F.count("*").alias("n"), F.avg("price").alias("mean")), "features"))


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC LIMIT 2000")
def snk_jsonl_ring(spark, d):
    e = load(spark, d, "events")
    return sinks.json_ring(e.where("ts < '2024-01-20'"), e.where("ts >= '2024-01-20'"), "ts", 2000, "event_id bigint, event_type string, value double")


@query("SELECT r_regionkey AS region, r_name AS name, (SELECT count(*) FROM region) AS total FROM region")
def snk_jsonl_artifact(spark, d):
    rows = load(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    return sinks.json_artifact(rows, rows.schema)


@query("SELECT event_id, user_id, event_type, value FROM events")
def src_log_capture(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return sinks.json_stream_to_parquet(e)


_UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def _index_load_sql() -> str:
    from .search import _BM25, _BUCKET, _HASHED, TOK, _unit_sql

    grams = f"""tg AS (SELECT doc_id AS id, token, count(*) AS c FROM t GROUP BY ALL), gw AS (SELECT token, unnest(list_concat(list_transform(range(1, length(token) + 1), lambda i: substr('^' || token || '$', i, 3)), list_transform(range(1, length(token)), lambda i: substr('^' || token || '$', i, 4)))) AS gram FROM (SELECT DISTINCT token FROM tg)),
        gb AS (SELECT token, {_BUCKET.format("gram", 16384)} AS bucket, count(*) AS k FROM gw GROUP BY ALL), gd AS (SELECT id AS doc_id, bucket, 1 + ln(1 + sum(c * k)) AS weight FROM tg JOIN gb USING (token) GROUP BY ALL)"""
    each = lambda n, t, i, w: f"{n} AS (SELECT {i} AS doc_id, count(*) AS {n}_n, md5(string_agg(bucket || ':' || CAST(floor({w} * 1e6 + 0.5001) AS BIGINT), ',' ORDER BY bucket)) AS {n}_md5 FROM {t} GROUP BY ALL)"
    return f"""WITH {TOK}, {_BM25}, {_unit_sql('hd', _HASHED.format('doc_id', 't', 's', 256))}, {grams}, {each('dn', 'hd', 'id', 'w')}, {each('wd', 'bd', 'doc_id', 'weight')}, {each('gr', 'gd', 'doc_id', 'weight')},
        k AS (SELECT doc_id, lang, n_chars, sha1(unhex('{lake.POINT_NAMESPACE.hex}') || CAST('doc:' || doc_id AS BLOB)) AS h FROM documents)
        SELECT {_UUID5} AS point_id, k.doc_id, lang, n_chars, coalesce(dn_n, 0) AS dense_n, dn_md5 AS dense_md5, coalesce(wd_n, 0) AS words_n, wd_md5 AS words_md5, coalesce(gr_n, 0) AS grams_n, gr_md5 AS grams_md5
        FROM k LEFT JOIN dn ON k.doc_id = dn.doc_id LEFT JOIN wd ON k.doc_id = wd.doc_id LEFT JOIN gr ON k.doc_id = gr.doc_id"""


@query(_index_load_sql())
def src_index_load(spark, d):
    """Two loads, of which the second brings what the first lacks and corrects what it has wrong; every entry of every vector goes into the digests."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    late = F.col("doc_id") % 2 == 1
    index = lake.Index(spark)
    index.load(docs.where(~late | (F.col("doc_id") % 10 == 1)).withColumn("text", F.when(late, F.reverse("text")).otherwise(F.col("text"))), "doc_id", "text", 0)
    index.load(docs.where(late), "doc_id", "text", 1)
    entry = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.floor(e["value"] * 1e6 + 0.5001).cast("string"))
    # entries lie in the order of buckets
    told = lambda n: [F.size(n).cast("long").alias(f"{n}_n"), F.when(F.size(n) > 0, F.md5(F.array_join(F.transform(F.map_entries(n), entry), ","))).alias(f"{n}_md5")]
    points = index.weighed(kept=["point_id", "doc_id", "lang", "n_chars", *told("dense"), *told("grams")])
    return points.select("point_id", "doc_id", "lang", "n_chars", "dense_n", "dense_md5", *told("words"), "grams_n", "grams_md5")


@query(f"""{A} SELECT auction_id, price, bids, ends_at FROM l""")
def dedup_latest_auction(spark, d):
    return listings(spark, d, latest=True).select("auction_id", "price", "bids", "ends_at")


@query(_latest_sql("item, user_id", "event_id, value", "event_type IN ('click', 'purchase', 'error')"))
def dedup_latest_bid(spark, d):
    return etl.latest_per_key(events(spark, d).where(F.col("event_type").isin(*BIDS)), ["item", "user_id"], ["ts"]).select("item", "user_id", "event_id", "value")


@query(_latest_sql("item, user_id, event_type", "event_id", "event_type IN ('view', 'signup')"))
def dedup_latest_watch(spark, d):
    return etl.latest_per_key(events(spark, d).where(F.col("event_type").isin(*WATCHES)), ["item", "user_id", "event_type"], ["ts"]).select("item", "user_id", "event_type", "event_id")


@query(f"""{L} SELECT sld || '.' || tld AS domain, max(ends_at) AS ends_at FROM l GROUP BY ALL""")
def dedup_latest_domain(spark, d):
    named = listings(spark, d).select(F.concat_ws(".", "sld", "tld").alias("domain"), "ends_at")
    return etl.latest_per_key(named, ["domain"], ["ends_at"])


@query("""SELECT lower(p_name) AS name FROM part UNION SELECT lower(s_name) FROM supplier UNION SELECT lower(c_name) FROM customer""")
def set_union_domain_scope(spark, d):
    return etl.scope([load(spark, d, t).select(F.col(c).alias("name")) for t, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))], "name")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def join_scope_semi(spark, d):
    names = load(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("k"))
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("k"))
    return etl.in_scope(orders, "k", names).drop("k")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def join_left_semi_scope(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(f"""{E} SELECT b.item, max(b.ts) AS last_bid FROM e b JOIN (SELECT DISTINCT user_id, item FROM e WHERE event_type = 'purchase') w ON b.user_id = w.user_id AND b.item = w.item JOIN part ON p_partkey = b.item WHERE b.event_type = 'click' GROUP BY ALL""")
def stg_bid_offer(spark, d):
    e = events(spark, d)
    return lake.last_bids(e.where("event_type = 'click'"), e.where("event_type = 'purchase'").select("user_id", "item"), load(spark, d, "part").select(F.col("p_partkey").alias("item")))


def _stage_sql(kind: str, flag: str) -> str:
    return f"""{E} SELECT item, event_id, value, 1 AS {flag} FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC) AS rn FROM e WHERE event_type = '{kind}' AND value > 5) WHERE rn = 1 AND item IN (SELECT p_partkey FROM part)"""


def _stage(spark, d, kind: str, flag: str):
    rows = events(spark, d).where((F.col("event_type") == kind) & (F.col("value") > 5))
    scope = load(spark, d, "part").select(F.col("p_partkey").alias("item"))
    return lake.latest_in_scope(rows, scope, "item", "ts").select("item", "event_id", "value", F.lit(1).alias(flag))


@query(_stage_sql("view", "in_majestic"))
def stg_majestic(spark, d):
    return _stage(spark, d, "view", "in_majestic")


@query(f"""{E} SELECT item, event_id, '[{{"id":' || event_id || '}}]' AS refs FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC) AS rn FROM e WHERE event_type = 'click') WHERE rn = 1""")
def stg_semrush(spark, d):
    last = etl.latest_per_key(events(spark, d).where("event_type = 'click'"), ["item"], ["ts"])
    return last.select("item", "event_id", F.to_json(F.array(F.struct(F.col("event_id").alias("id")))).alias("refs"))


@query(_stage_sql("signup", "in_estibot"))
def stg_estibot(spark, d):
    return _stage(spark, d, "signup", "in_estibot")


@query("""SELECT o_custkey AS customer, CAST(bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS INTEGER) AS boosted FROM orders GROUP BY ALL""")
def stg_aftermarket_boost(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(etl.any_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("boosted"))


@query(f"""{E}, v AS (SELECT item, count(*) AS views FROM e WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT item, max(value) AS best FROM e WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT p_partkey AS item, p_name AS name, coalesce(views, 0) AS views, best, CAST(NULL AS DOUBLE) AS authority FROM part LEFT JOIN v ON p_partkey = v.item LEFT JOIN p ON p_partkey = p.item""")
def set_merge_wide(spark, d):
    e = events(spark, d)
    base = load(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"))
    stages = {"views": e.where("event_type = 'view'").groupBy("item").agg(F.count("*").alias("views")), "best": e.where("event_type = 'purchase'").groupBy("item").agg(F.max("value").alias("best")), "seo": None}
    return etl.merge_wide(base, "item", stages, {"views": {"views": "long"}, "best": {"best": "double"}, "seo": {"authority": "double"}}, ["views"])


@query("SELECT c_custkey AS auction_id, c_name AS domain_name, CAST(NULL AS VARCHAR) AS tld, c_acctbal AS current_price, CAST(NULL AS INTEGER) AS bid_count FROM customer")
def stub_on_missing(spark, d):
    from lotwise.schemas import AUCTIONS, conform, empty

    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("auction_id"), F.col("c_name").alias("domain_name"), F.col("c_acctbal").alias("current_price"))
    whole = conform(rows, AUCTIONS, required=("auction_id",)).unionByName(empty(spark, AUCTIONS))
    return whole.select("auction_id", "domain_name", "tld", "current_price", "bid_count")


@query(f"""{A} SELECT auction_id, price, price AS auction_price, price AS auction_price_usd, sold, sold <> 0 AS is_sold FROM l""")
def delta_apply_aliases(spark, d):
    rows = listings(spark, d, latest=True).select("auction_id", "price", "sold")
    return etl.apply_aliases(rows, {"price": ["auction_price", "auction_price_usd"], "sold": ["is_sold"]}, ("is_sold",))


@query(f"""{E} SELECT DISTINCT item, user_id FROM e WHERE user_id > 0""")
def bridge_item_auction(spark, d):
    return etl.bridge(events(spark, d), "item", "user_id")


@query(f"""{L} SELECT CASE type_id WHEN 16 THEN 'expiry auction' WHEN 20 THEN 'buynow' WHEN 38 THEN 'expiry auction' WHEN 39 THEN 'closeout' ELSE 'other' END AS type_name, count(*) AS n FROM l GROUP BY ALL""")
def prj_auction_type_name(spark, d):
    return listings(spark, d).groupBy(derive.auction_type_name(F.col("type_id")).alias("type_name")).agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN sold = 1 THEN 'sold' WHEN ends_at < TIMESTAMP '2001-06-01' THEN 'expired' WHEN CAST(ends_at AS DATE) - DATE '2001-06-01' <= 7 THEN 'expiring_soon' ELSE 'active' END"


@query(f"""{L} SELECT {_STATUS} AS status, count(*) AS n FROM l GROUP BY ALL""")
def prj_expiry_status(spark, d):
    return listings(spark, d).groupBy(derive.expiry_status(F.col("sold"), F.col("ends_at"), AS_OF).alias("status")).agg(F.count("*").alias("n"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '(^|[-_])({p})') THEN '{n}'" for n, p in derive.CATEGORIES.items()) + " ELSE '' END"
#: Labels of one or two words from everywhere: part types, segments, the first words of texts.
_LABELS_SQL = "la AS (SELECT replace(p_name, ' ', '-') || '-' || lower(p_type) AS label FROM part UNION ALL SELECT lower(c_mktsegment) || '_' || c_custkey FROM customer UNION ALL SELECT lower(array_to_string(list_slice(string_split(text, ' '), 1, 2), '-')) FROM documents WHERE text <> '')"


@query(f"WITH {_LABELS_SQL} SELECT {_CATEGORY.format('label')} AS category, count(*) AS n, min(label) AS least FROM la GROUP BY ALL")
def prj_category_name(spark, d):
    parts = load(spark, d, "part").select(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower("p_type")).alias("label"))
    buyers = load(spark, d, "customer").select(F.concat_ws("_", F.lower("c_mktsegment"), F.col("c_custkey").cast("string")).alias("label"))
    texts = load(spark, d, "documents").where("text <> ''").select(F.lower(F.array_join(F.slice(F.split("text", " "), 1, 2), "-")).alias("label"))
    labels = parts.unionByName(buyers).unionByName(texts)
    return labels.groupBy(derive.category_name(F.col("label")).alias("category")).agg(F.count("*").alias("n"), F.min("label").alias("least"))


@query(f"""{L} SELECT auction_id, greatest(0, CAST(CAST(ends_at AS DATE) - CAST(listed_at AS DATE) AS INTEGER)) AS hold FROM l""")
def prj_hold_days(spark, d):
    return listings(spark, d).select("auction_id", derive.hold_days("listed_at", "ends_at").alias("hold"))


@query("""SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS domain_length FROM part""")
def prj_domain_length(spark, d):
    return load(spark, d, "part").select("p_partkey", F.length("p_name").alias("domain_length"))


@query("""SELECT event_id, CAST(ts AS DATE) AS event_day, CAST(date_trunc('week', ts) AS DATE) AS event_monday, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS event_week, CAST(hour(ts) AS INTEGER) AS event_hour FROM events""")
def prj_event_buckets(spark, d):
    from lotwise.functions.times import bucket

    ts = F.col("ts")
    return load(spark, d, "events").select("event_id", bucket(ts, "day").alias("event_day"), bucket(ts, "monday").alias("event_monday"), bucket(ts, "week").alias("event_week"), F.hour(ts).alias("event_hour"))


@query(f"""{L} SELECT auction_id, sld || '.' || tld AS domain, contains(sld, '-') AS has_hyphen, regexp_matches(sld, '[0-9]') AS has_number, near(least(greatest(govalue / 2000, 0), 1)) AS quality, traffic > 0 AND govalue < 1000 AS gem,
    CAST(floor(epoch(ends_at) - epoch(TIMESTAMP '2001-06-01')) AS BIGINT) AS left_s FROM l WHERE price > 0 AND ends_at > TIMESTAMP '2001-06-01'""")
def prj_listing_doc(spark, d):
    return rounded(lake.listing_document(listings(spark, d), AS_OF).select("auction_id", "domain", "has_hyphen", "has_number", "quality", "gem", "left_s"))


@query("""SELECT o_orderkey, CAST(floor(CAST(DATE '2001-06-01' - CAST(o_orderdate AS DATE) AS INTEGER) / 365) AS INTEGER) AS years FROM orders WHERE o_orderdate <= TIMESTAMP '2001-06-01'""")
def prj_domain_age_years(spark, d):
    texts = load(spark, d, "orders").where(F.col("o_orderdate") <= F.lit(AS_OF)).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("said"))
    return texts.select("o_orderkey", derive.age_years(F.col("said"), AS_OF).alias("years"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def prj_end_time(spark, d):
    ts = F.col("ts")
    said = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.unix_timestamp(ts).cast("string"))
    return load(spark, d, "events").select("event_id", F.unix_timestamp(derive.any_time(said)).alias("epoch"))


def _filtered(sql: str, predicate):
    return f"{L} SELECT auction_id, price, tld FROM l WHERE {sql}", lambda spark, d: listings(spark, d).where(predicate()).select("auction_id", "price", "tld")


for _name, _sql, _predicate in [
    ("flt_date_range", "ends_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-03-01'", lambda: flt.date_range("ends_at", datetime(2000, 1, 1), datetime(2000, 3, 1))),
    ("flt_equality", "tld = 'brand7'", lambda: flt.equality("tld", "brand7")),
    ("flt_numeric_range", "price BETWEEN 1000 AND 20000", lambda: flt.numeric_range("price", 1000, 20000)),
    ("flt_in", "tld IN ('brand1', 'brand9')", lambda: flt.in_list("tld", ["brand1", "brand9"])),
    ("flt_conjunction", "tld = 'brand7' AND price >= 50000 AND bids <= 10", lambda: flt.conjunction([flt.equality("tld", "brand7"), flt.numeric_range("price", low=50000), flt.numeric_range("bids", high=10)])),
    ("flt_from_hint", "price >= 50000 AND tld IN ('brand1', 'brand2')", lambda: flt.from_hint("price_min=50000 tld=brand1,brand2 colour=red price_max=x", {"price": "price"}, {"tld": "tld"})),
    ("flt_structured", "price >= 20000 AND bids <= 30 AND tld IN ('brand1', 'brand2', 'brand3') AND NOT regexp_matches(sld, '[qz]') AND length(sld) <= 12 AND contains(sld, '-') AND (listed_at IS NULL OR listed_at >= TIMESTAMP '1997-01-01') AND ends_at >= TIMESTAMP '1996-01-01'", lambda: flt.build_predicate({"price_min": 20000, "bids_max": 30, "tlds": [".brand1", "brand2", "BRAND3"], "exclude_letters": ["q", "z"], "name_length_max": 12, "has_hyphen": True, "listed_after": datetime(1997, 1, 1), "ends_after": datetime(1996, 1, 1)}, AS_OF)),
    ("flt_keywords", "(list_contains(string_split(lower(sld), '-'), 'red') OR regexp_matches(lower(sld), '(^|[^a-z0-9])red($|[^d])')) AND starts_with(lower(sld), 'r')", lambda: flt.build_predicate({"contains_any": ["red"], "starts_any": ["r"]})),
    ("flt_lifecycle", "type_id = 16 OR ends_at <= TIMESTAMP '1996-01-01'", lambda: flt.build_predicate({"lifecycle": [16], "lifecycle_or_ends_before": datetime(1996, 1, 1)})),
    ("flt_name_length", "length(sld) BETWEEN 6 AND 9", lambda: flt.build_predicate({"name_length_min": 6, "name_length_max": 9})),
    ("flt_lifecycle_disjunction", "type_id = 38 OR ends_at <= TIMESTAMP '1997-01-01'", lambda: flt.build_predicate({"lifecycle": [38], "lifecycle_or_ends_before": datetime(1997, 1, 1)})),
    ("flt_days_listed", "listed_at IS NULL OR CAST(DATE '2001-06-01' - CAST(listed_at AS DATE) AS INTEGER) BETWEEN 100 AND 400", lambda: flt.build_predicate({"days_listed_min": 100, "days_listed_max": 400}, AS_OF)),
    ("flt_letters_digits", "length(regexp_replace(lower(sld), '[^a-z]', '', 'g')) <= 8 AND length(regexp_replace(sld, '[^0-9]', '', 'g')) <= 0", lambda: flt.build_predicate({"letters_max": 8, "digits_max": 0})),
    ("flt_exclusions", "tld NOT IN ('brand1', 'brand2') AND type_id NOT IN (16) AND NOT (list_contains(string_split(lower(sld), '-'), 'blue') OR regexp_matches(lower(sld), '(^|[^a-z0-9])blue'))", lambda: flt.build_predicate({"exclude_tlds": ["brand1", "brand2"], "exclude_types": [16], "exclude_keywords": ["blue"]})),
    ("flt_time_remaining", "epoch(ends_at) - epoch(TIMESTAMP '2001-06-01') BETWEEN 0 AND 604800", lambda: flt.build_predicate({"time_remaining_max": 604800}, AS_OF)),
    ("flt_word_count", "len(regexp_extract_all(lower(sld), '([a-z]+|[0-9]+)')) >= 2 AND greatest(coalesce(traffic, 0), coalesce(backlinks, 0), 0) > 0", lambda: flt.build_predicate({"word_count_min": 2, "has_traffic": ["traffic", "backlinks"]})),
]:
    _s, _f = _filtered(_sql, _predicate)
    _f.__name__ = _name
    query(_s)(_f)


#: Enrichment columns of a listing, with gaps: name and expression, the same in both engines.
_ENRICHED = {
    "majestic_tf": "nullif(authority, 13)", "majestic_cf": "authority + 5", "majestic_backlinks": "nullif(backlinks, 50) * 10", "majestic_ref_domains": "bids * 3", "tlf_keyword_regs": "nullif(traffic, 300)",
    "tlf_exact_match": "CASE WHEN bids % 3 = 0 THEN 1 WHEN bids % 3 = 1 THEN 0 END", "tlf_developed": "CASE WHEN bids % 2 = 0 THEN 1 ELSE 0 END", "semrush_backlinks": "backlinks * 7", "semrush_indexed_pages": "authority * 4",
    "semrush_ref_domains": "backlinks + bids", "semrush_search_volume": "nullif(bids, 20) * 100", "semrush_authority_score": "authority * 1.5", "semrush_cpc": "price / 10000", "buy_it_now_price": "nullif(price, 0) * 2",
    "buy_it_now": "CASE WHEN type_id = 20 THEN 1 ELSE 0 END", "gd_transfer": "CASE WHEN registrar % 5 = 0 THEN NULL ELSE registrar % 2 END", "gem": "govalue > 1000", "quality": "least(govalue / 2000, 1.0)", "age_years": "authority / 4.0",
}
_ENRICHED_SQL = f"{L}, x AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _ENRICHED.items()) + " FROM l)"


def _enriched(spark, d):
    return listings(spark, d).selectExpr("*", *[f"{e} AS {c}" for c, e in _ENRICHED.items()])


for _name, _sql, _slots in [
    ("flt_majestic", "majestic_tf BETWEEN 5 AND 40 AND majestic_cf <= 48 AND majestic_backlinks >= 100 AND majestic_ref_domains BETWEEN 9 AND 120", {"majestic_tf_min": 5, "majestic_tf_max": 40, "majestic_cf_max": 48, "majestic_backlinks_min": 100, "majestic_ref_domains_min": 9, "majestic_ref_domains_max": 120}),
    ("flt_semrush", "semrush_backlinks >= 70 AND semrush_indexed_pages <= 180 AND semrush_ref_domains >= 20 AND semrush_search_volume BETWEEN 300 AND 4500 AND semrush_authority_score >= 6 AND semrush_cpc <= 6.5", {"semrush_backlinks_min": 70, "semrush_indexed_pages_max": 180, "semrush_ref_domains_min": 20, "semrush_search_volume_min": 300, "semrush_search_volume_max": 4500, "semrush_authority_min": 6, "semrush_cpc_max": 6.5}),
    ("flt_tlf", "tlf_exact_match = 1 AND tlf_developed = 0 AND tlf_keyword_regs >= 100", {"tlf_exact_match": True, "tlf_developed": False, "tlf_keyword_regs_min": 100}),
    ("flt_scores", "quality >= 0.49 AND age_years BETWEEN 2 AND 11 AND traffic >= 100 AND govalue <= 1800 AND gem AND authority >= 8", {"quality_min": 0.49, "age_min": 2, "age_max": 11, "traffic_min": 100, "govalue_max": 1800, "gem": True, "authority_min": 8}),
    ("flt_terms_of_sale", "buy_it_now = 1 AND buy_it_now_price BETWEEN 4000 AND 90000 AND gd_transfer = 0 AND (listed_at IS NULL OR listed_at <= TIMESTAMP '2000-01-01')", {"buy_it_now": True, "buy_it_now_min": 4000, "buy_it_now_max": 90000, "gd_transfer": False, "listed_before": datetime(2000, 1, 1)}),
    ("flt_unknown", "majestic_tf IS NULL AND bids >= 5", {"unknown": ["majestic_tf"], "majestic_tf_min": 5, "bids_min": 5}),
    ("flt_type_names", "type_id IN (16, 38) AND type_id <> 38 AND contains(replace(sld, '-', ''), 'redbolt')", {"types": ["Expiry auction"], "exclude_types": ["38"], "phrase": "red bolt"}),
    ("flt_either_lifecycle", "(epoch(ends_at) - epoch(TIMESTAMP '2001-06-01') BETWEEN 0 AND 604800) OR type_id IN (20)", {"lifecycle_disjunction": True, "time_remaining_max": 604800, "lifecycle": ["buynow"]}),
    ("flt_minima", "length(regexp_replace(lower(sld), '[^a-z]', '', 'g')) >= 8 AND length(regexp_replace(sld, '[^0-9]', '', 'g')) >= 0 AND NOT regexp_matches(sld, '(^|-)old|old(-|$)') AND NOT contains(sld, 'widget')", {"letters_min": 8, "digits_min": 0, "exclude_keywords": ["old", "widget"]}),
]:

    def _run(slots):
        return lambda spark, d: _enriched(spark, d).where(flt.build_predicate(slots, AS_OF)).select("auction_id", "price", "tld")

    _f = _run(_slots)
    _f.__name__ = _name
    query(f"{_ENRICHED_SQL} SELECT auction_id, price, tld FROM x WHERE {_sql}")(_f)


@query(f"""{L}, x AS (SELECT tld, price FROM l UNION ALL SELECT '_global', price FROM l), b AS (SELECT tld, list_sort(list(price))[CAST(greatest(ceil(0.5 * count(*)), 1) AS BIGINT)] AS baseline FROM x WHERE price > 0 GROUP BY ALL)
    SELECT auction_id, price, l.tld FROM l LEFT JOIN b ON l.tld = b.tld WHERE price > 0 AND price < coalesce(baseline, (SELECT baseline FROM b WHERE tld = '_global'))""")
def flt_below_market(spark, d):
    from lotwise.operators.templates import market_baselines

    rows = listings(spark, d)
    return flt.below_market(rows, market_baselines(rows, "tld", "price")).select("auction_id", "price", "tld")


@query(f"""{L} SELECT auction_id, price, bids FROM l WHERE type_id IN (16) AND price >= 1000 AND bids <= 20 ORDER BY price DESC, auction_id LIMIT 100""")
def flt_hard_pushdown(spark, d):
    return lake.pushed_down(listings(spark, d), {"in": {"type_id": [16]}, "gte": {"price": 1000}, "lte": {"bids": 20}}).orderBy(F.desc("price"), "auction_id").limit(100).select("auction_id", "price", "bids")


@query(f"""{L} SELECT auction_id, price, near(bids / 50 + govalue / 2000) AS score FROM l WHERE price BETWEEN 20000 AND 40000 AND tld IN ('brand1', 'brand2') AND sold = 0 ORDER BY bids / 50 + govalue / 2000 DESC, auction_id, price LIMIT 50""")
def flt_price_band(spark, d):
    band = listings(spark, d).where(F.col("price").between(20000, 40000) & F.col("tld").isin("brand1", "brand2") & (F.col("sold") == 0))
    return rounded(band.withColumn("score", F.col("bids") / 50 + F.col("govalue") / 2000).orderBy(F.desc("score"), "auction_id", "price").limit(50).select("auction_id", "price", "score"), price=2)


@query("""SELECT p_partkey, CASE WHEN p_size > p_retailprice / 40 THEN 'size' END AS range_conflict, p_type = 'ECONOMY' AS tld_conflict FROM part""")
def flt_conflicts(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size_min"), (F.col("p_retailprice") / 40).alias("size_max"), F.array("p_type").alias("tlds"), F.array(F.lit("ECONOMY")).alias("exclude_tlds"))
    found = flt.conflicts(p, ["size"], ["tlds"])
    return found.select("p_partkey", F.when(F.array_contains("conflicts", "size"), "size").alias("range_conflict"), F.array_contains("conflicts", "tlds").alias("tld_conflict"))


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-12 17:00:00'""")
def flt_hour_partition(spark, d):
    ts = F.col("ts")
    parts = load(spark, d, "events").select("event_id", F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"))
    return parts.where(flt.hour_partition(datetime(2024, 1, 10, 5), datetime(2024, 1, 12, 17))).select("event_id")


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)')) AS w FROM documents) SELECT doc_id, list_has_any(w, ['stupid', 'trash', 'idiot']) AS flagged, array_to_string(list_sort(list_intersect(w, ['stupid', 'trash', 'idiot'])), ',') AS terms FROM t""")
def flt_blocklist(spark, d):
    hit = flt.blocklist(F.col("text"), ["stupid", "trash", "idiot"])
    return load(spark, d, "documents").select("doc_id", hit.alias("h")).select("doc_id", "h.flagged", F.array_join("h.terms", ",").alias("terms"))


@query(r"""WITH n AS (SELECT doc_id, text, coalesce(text, '') AS plain FROM documents), m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(plain, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g'), '\+?\d{0,2} ?\(\d{3}\) \d{3}-\d{4}', '[REDACTED]', 'g'), '\b\d{13,16}\b', '[REDACTED]', 'g') AS masked FROM n)
    SELECT doc_id, md5(masked) AS masked_md5, array_to_string(list_filter([CASE WHEN text IS NULL THEN 'non_string_input' WHEN text = '' THEN 'empty_input' END, CASE WHEN length(plain) > 5000 THEN 'length_exceeds_5000' END, CASE WHEN contains(lower(plain), 'stupid') THEN 'blocked_pattern_matched' END, CASE WHEN masked <> plain THEN 'pii_detected' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m""")
def flt_sanitize_mask(spark, d):
    docs = load(spark, d, "documents").select("doc_id", flt.sanitize(F.col("text"), 5000, ["stupid"]).alias("s"))
    return docs.select("doc_id", F.md5("s.text").alias("masked_md5"), F.array_join("s.reasons", ",").alias("reasons"))


@query("""SELECT doc_id, md5(CASE WHEN contains(text, 'stupid') THEN '[REMOVED]' WHEN length(text) > 800 THEN left(text, 800) || '[TRUNCATED]' ELSE text END) AS masked_md5 FROM documents""")
def flt_fragment_mask(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(flt.fragment_mask(F.col("text"), 800, F.contains("text", F.lit("stupid")))).alias("masked_md5"))
