"""Queries of measurement, evaluation, calibration and training data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lotwise.operators import measure as m
from lotwise.operators import vectors
from lotwise.session import load
from lotwise.sources.sinks import stored

from .search import _CENT, _DOT, _TOKENS, words_found
from .views import EVENTS_SQL, events, query, rounded

E = f"WITH {EVENTS_SQL}"
NOW = datetime(2024, 1, 30)
_RATE = "count(*) AS n, near(avg(CASE WHEN {0} THEN 1 ELSE 0 END)) AS value, CASE WHEN count(*) < 20 THEN 'insufficient_data' WHEN avg(CASE WHEN {0} THEN 1.0 ELSE 0 END) > {1} THEN 'breach' ELSE 'ok' END AS status"


def _rate(name: str, sql: str, hit, threshold: float) -> None:
    def run(spark, d):
        return rounded(m.rate(events(spark, d), hit(), threshold, 20))

    run.__name__ = name
    query(f"{E} SELECT {_RATE.format(sql, threshold)} FROM e")(run)


_rate("msr_zero_result_rate", "value < 2", lambda: F.col("value") < 2, 0.1)
_rate("msr_high_confidence_rate", "value >= 10", lambda: F.col("value") >= 10, 0.9)
_rate("msr_sla_breach_rate", "value > 60", lambda: F.col("value") > 60, 0.05)
_rate("msr_regex_short_circuit", "event_type = 'click'", lambda: F.col("event_type") == "click", 0.5)
_rate("msr_sanitizer_rejection_rate", "event_type = 'error'", lambda: F.col("event_type") == "error", 0.02)


def _ratio(name: str, a: str, b: str) -> None:
    def run(spark, d):
        e = events(spark, d)
        return rounded(m.capped_ratio(e.where(F.expr(a)), e.where(F.expr(b))))

    run.__name__ = name
    query(f"{E} SELECT count(*) FILTER ({a}) AS a, count(*) FILTER ({b}) AS b, near(least(1, count(*) FILTER ({a}) / count(*) FILTER ({b}))) AS value FROM e")(run)


_ratio("msr_filter_override_rate", "event_type = 'signup'", "event_type = 'view'")
_ratio("msr_query_to_click_rate", "event_type = 'click'", "event_type = 'view'")


def _hits(name: str, hit: str) -> None:
    def run(spark, d):
        e = events(spark, d).select(F.expr(f"CAST({hit} AS INT)").alias("h"), F.expr(f"CAST(NOT ({hit}) AS INT)").alias("x"))
        return rounded(m.sum_ratio(e, "h", "x"))

    run.__name__ = name
    query(f"{E} SELECT CAST(count(*) FILTER ({hit}) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS total, near(count(*) FILTER ({hit}) / count(*)) AS value FROM e")(run)


_hits("msr_cache_hit_rate", "value < 10")
_hits("msr_prompt_cache_hit_rate", "item % 3 = 0")
_hits("msr_verifier_skip_rate", "user_id % 4 = 0")


def _nearest(q: float, v: str = "value") -> str:
    return f"list_sort(list({v}))[CAST(greatest(ceil({q} * count(*)), 1) AS BIGINT)]"


@query(f"{E} SELECT event_type, count(*) AS n, {_nearest(0.5)} AS p50, {_nearest(0.99)} AS p99 FROM e GROUP BY ALL")
def msr_latency_percentile(spark, d):
    return m.latency(events(spark, d), "value", {"p50": 0.5, "p99": 0.99}, ["event_type"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def msr_query_type_distribution(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, near(count(*) * 86400 / (floor(epoch(max(ts))) - floor(epoch(min(ts))))) AS per_day FROM events")
def msr_signals_per_day(spark, d):
    return rounded(m.signals_per_day(load(spark, d, "events"), "ts"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) FILTER (event_type = 'error') AS activations FROM events GROUP BY ALL")
def msr_circuit_breaker_activations(spark, d):
    return load(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count_if(F.col("event_type") == "error").alias("activations"))


@query("WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '') SELECT near(avg(1 - len(list_distinct(l)) / len(l))) AS value FROM s")
def msr_duplicate_rate(spark, d):
    lines = load(spark, d, "documents").where("text <> ''").select(F.split("text", "\n", -1).alias("l"))
    return rounded(lines.agg(F.avg(1 - F.size(F.array_distinct("l")) / F.size("l")).alias("value")))


def _follow(name: str, first: str, then: str, seconds: int) -> None:
    def run(spark, d):
        return rounded(m.followups(events(spark, d), "user_id", "ts", F.expr(first), F.expr(then), seconds))

    run.__name__ = name
    query(f"{E}, f AS (SELECT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.{then} AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {seconds} SECONDS) AS x FROM e a WHERE a.{first}) SELECT count(*) AS n, count(*) FILTER (x) AS followed, near(count(*) FILTER (x) / count(*)) AS value FROM f")(run)


_follow("msr_explore_followup", "event_type = 'view'", "event_type = 'click'", 1800)
_follow("msr_assisted_conversion", "event_type = 'view'", "event_type = 'purchase'", 3600)


@query("""SELECT near(avg(n_chars) FILTER (quality = 1)) AS per_good, near(avg(n_chars) FILTER (n_chars > 1000)) AS per_confident, near(avg(n_chars)) AS per_any, count(*) AS n FROM labels JOIN documents USING (doc_id)""")
def msr_cost_per_labelled(spark, d):
    j = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(j.agg(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("per_good"), F.avg(F.when(F.col("n_chars") > 1000, F.col("n_chars"))).alias("per_confident"), F.avg("n_chars").alias("per_any"), F.count("*").alias("n")))


@query("SELECT near(avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1 ELSE 0 END)) AS value, count(*) AS n FROM labels")
def msr_intent_accuracy(spark, d):
    hit = (F.col("quality") == 1) == (F.col("toxic") == 0)
    return rounded(load(spark, d, "labels").agg(F.avg(hit.cast("double")).alias("value"), F.count("*").alias("n")))


@query(f"""{E} SELECT user_id % 7 AS slice, {_RATE.format('value > 20', 0.3)}, {_nearest(0.5)} AS p50, {_nearest(0.99)} AS p99, near(least(1, count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0))) AS click_rate, near(least(1, count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0))) AS conversion FROM e GROUP BY ALL""")
def msr_sliced(spark, d):
    e = events(spark, d).withColumn("slice", F.col("user_id") % 7)
    kind = F.col("event_type")
    out = m.rate(e, F.col("value") > 20, 0.3, 20, ["slice"])
    out = out.join(m.latency(e, "value", {"p50": 0.5, "p99": 0.99}, ["slice"]).drop("n"), "slice")
    share = lambda k: F.when(F.count_if(kind == "view") > 0, F.least(F.lit(1.0), F.count_if(kind == k) / F.count_if(kind == "view")))
    return rounded(out.join(e.groupBy("slice").agg(share("click").alias("click_rate"), share("purchase").alias("conversion")), "slice"), p50=2, p99=2)


@query(f"""{E}, c AS (SELECT event_id, ts, floor(epoch(ts)) AS t, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (ORDER BY ts) % 500 AS h, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (ORDER BY ts) % 2000 AS x FROM e),
    g AS (SELECT *, greatest(coalesce(h - lag(h) OVER (ORDER BY ts), 0), 0) AS dh, greatest(coalesce(x - lag(x) OVER (ORDER BY ts), 0), 0) AS dx FROM c), r AS (SELECT *, sum(dh) OVER w AS hs, sum(dx) OVER w AS xs FROM g WINDOW w AS (ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)),
    b AS (SELECT *, CASE WHEN hs + xs > 0 THEN hs / (hs + xs) END AS rate FROM r), f AS (SELECT *, coalesce(rate < 0.2, FALSE) AS breached FROM b)
    SELECT event_id, near(rate) AS hit_rate, breached, CASE WHEN breached AND NOT lag(breached, 1, FALSE) OVER (ORDER BY ts) THEN 'start' WHEN NOT breached AND lag(breached, 1, FALSE) OVER (ORDER BY ts) THEN 'end' END AS edge FROM f""")
def msr_cache_miss_storm(spark, d):
    click = (F.col("event_type") == "click").cast("long")
    counters = m.running_sums(events(spark, d).select("event_id", "ts", click.alias("h"), (1 - click).alias("x")), "ts", ["h", "x"])
    counters = counters.withColumn("h", F.col("h") % 500).withColumn("x", F.col("x") % 2000)
    return rounded(m.miss_storm(counters, "ts", "h", "x", 300, 0.2).select("event_id", "hit_rate", "breached", "edge"))


@query(f"""{E}, v AS (SELECT 'error_rate' AS metric, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS value FROM e UNION ALL SELECT 'mean_latency', avg(value) FROM e UNION ALL SELECT 'absent', NULL)
    SELECT metric, near(value) AS value, CASE WHEN value IS NULL THEN 'skip' WHEN metric = 'error_rate' AND value <= 0.25 THEN 'pass' WHEN metric = 'mean_latency' AND value <= 5 THEN 'pass' ELSE 'fail' END AS gate FROM v""")
def msr_launch_gates(spark, d):
    e = events(spark, d)
    row = e.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"), F.avg("value").alias("mean_latency"), F.lit(None).cast("double").alias("absent"))
    return rounded(m.gates(row.unpivot([], ["error_rate", "mean_latency", "absent"], "metric", "value"), {"error_rate": ("<=", 0.25), "mean_latency": ("<=", 5.0), "absent": ("<=", 1.0)}))


@query(f"{E}, s AS (SELECT date_trunc('hour', ts) AS bucket, sum(value) AS spend FROM e GROUP BY ALL) SELECT strftime(bucket, '%Y-%m-%d %H') AS bucket, near(spend) AS spend, near(sum(spend) OVER (PARTITION BY CAST(bucket AS DATE) ORDER BY bucket)) AS so_far, spend > 200 AS over FROM s")
def msr_cost_buckets(spark, d):
    out = m.cost_buckets(events(spark, d), "ts", "value", "hour", 200.0)
    return rounded(out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH")))


# -- evaluation

_GAINS = "gn AS (SELECT query_id, c.doc_id AS item, 1 + 2 * quality AS gain FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 30) c JOIN labels USING (doc_id))"
_EVAL = f"""{_DOT}, {_GAINS}, g AS (SELECT * FROM gn WHERE gain > 0), j AS (SELECT rk.query_id, rank, gain FROM rk LEFT JOIN g ON rk.query_id = g.query_id AND rk.doc_id = g.item),
    got AS (SELECT query_id, sum((pow(2.0, coalesce(gain, 0)) - 1) / log2(rank + 1)) AS dcg, count(gain) AS hits, min(rank) FILTER (gain IS NOT NULL) AS first FROM j GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item) AS r FROM g), ide AS (SELECT query_id, sum((pow(2.0, gain) - 1) / log2(r + 1)) FILTER (r <= 10) AS idcg, count(*) AS relevant FROM pl GROUP BY ALL),
    ev AS (SELECT query_id, dcg, dcg / idcg AS ndcg, hits / 10 AS precision, hits / relevant AS recall, coalesce(1 / first, 0) AS mrr FROM got LEFT JOIN ide USING (query_id))"""


def _evaluated(spark, d):
    found = stored(words_found(spark, d, 30).select("query_id", F.col("doc_id").alias("item"), "rank"), "found")
    gains = found.join(load(spark, d, "labels").select(F.col("doc_id").alias("item"), (1 + 2 * F.col("quality")).alias("gain")), "item").select("query_id", "item", "gain")
    ranked = found.where("rank <= 10")
    return m.ranking_metrics(ranked, gains, 10)


for _metric in ("dcg", "ndcg", "precision", "recall", "mrr"):

    def _make(metric: str):
        def run(spark, d):
            return rounded(_evaluated(spark, d).select("query_id", metric))

        run.__name__ = f"evl_{metric}"
        return run

    query(f"WITH {_EVAL} SELECT query_id, near({_metric}) AS {_metric} FROM ev")(_make(_metric))


@query(f"WITH {_EVAL} SELECT query_id % 3 AS slice, count(*) AS n, near(avg(ndcg)) AS ndcg, near(avg(recall)) AS recall, avg(ndcg) >= 0.01 AS released FROM ev GROUP BY ALL")
def evl_report_slices(spark, d):
    out = _evaluated(spark, d).groupBy((F.col("query_id") % 3).alias("slice")).agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))
    return rounded(out.withColumn("released", F.col("ndcg") >= 0.01))


@query("""WITH r AS (SELECT o_custkey AS query_id, o_totalprice / 500000 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) FILTER (o_totalprice > 250000) OVER (PARTITION BY o_custkey) AS rel FROM orders)
    SELECT query_id, near(count(*) FILTER (score > 0.5 AND rank <= 5) / 5) AS precision, near(CASE WHEN max(rel) > 0 THEN count(*) FILTER (score > 0.5 AND rank <= 5) / max(rel) END) AS recall FROM r GROUP BY ALL""")
def evl_pool_prf(spark, d):
    from pyspark.sql import Window

    o = load(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey", (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_totalprice") > 250000).alias("rel"))
    r = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "o_orderkey")))
    hits = F.count_if((F.col("score") > 0.5) & (F.col("rank") <= 5))
    return rounded(r.groupBy("query_id").agg((hits / 5).alias("precision"), F.when(F.count_if("rel") > 0, hits / F.count_if("rel")).alias("recall")))


@query(f"""{E}, r AS (SELECT event_type, user_id, item, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY event_type, user_id ORDER BY item DESC NULLS LAST) AS j FROM e),
    g AS (SELECT event_type, user_id, sum(coalesce(item, 0) / log2(i + 1)) FILTER (i <= 10) AS dcg, sum(coalesce(item, 0) / log2(j + 1)) FILTER (j <= 10) AS ideal FROM r GROUP BY ALL),
    d AS (SELECT event_type AS s, near(avg(dcg / ideal) FILTER (ideal > 0)) AS ndcg FROM g GROUP BY ROLLUP (event_type)),
    o AS (SELECT event_type AS suite, count(*) AS n, near(avg(value)) AS mean, near(quantile_cont(value, 0.5)) AS p50, near(quantile_cont(value, 0.95)) AS p95, near(avg(CASE WHEN value > 60 THEN 1 ELSE 0 END)) AS sla, near(avg(CASE WHEN item % 5 = user_id % 5 THEN 1 ELSE 0 END)) AS routed, near(sum(value) / 1000) AS cost FROM e GROUP BY ROLLUP (event_type))
    SELECT o.*, ndcg FROM o LEFT JOIN d ON suite IS NOT DISTINCT FROM s""")
def evl_suite_summary(spark, d):
    return rounded(m.suite_summary(events(spark, d), "event_type", "user_id", [F.col("ts"), F.col("event_id")], "value", "item", F.col("item") % 5 == F.col("user_id") % 5, 60.0))


@query(f"""{E}, s AS (SELECT event_type, avg(value) AS mean, max(value) AS high FROM e GROUP BY ALL) SELECT event_type, 'mean' AS kind, CASE WHEN mean > 30 THEN 'high' ELSE 'low' END AS severity FROM s WHERE mean > 10 UNION ALL SELECT event_type, 'max', CASE WHEN high > 300 THEN 'high' ELSE 'low' END FROM s WHERE high > 100""")
def evl_segment_gaps(spark, d):
    s = events(spark, d).groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("high"))
    gap = lambda c, floor, bad, kind: F.when(F.col(c) > floor, F.struct(F.lit(kind).alias("kind"), F.when(F.col(c) > bad, "high").otherwise("low").alias("severity")))
    return s.select("event_type", F.explode(F.array_compact(F.array(gap("mean", 10, 30, "mean"), gap("high", 100, 300, "max")))).alias("g")).select("event_type", "g.kind", "g.severity")


@query("SELECT doc_id, CAST(('0x' || left(md5('0|' || lang || '|' || doc_id), 8)) AS BIGINT) / 4294967295 < 0.2 AS held FROM documents")
def evl_holdout_split(spark, d):
    return load(spark, d, "documents").select("doc_id", m.holdout(F.col("doc_id").cast("string"), F.col("lang"), 0.2).alias("held"))


#: Three extractors of a text's words: long ones, those that aren't too long, and those under "t"; what the second drops by rule.
_SETS = f"w AS (SELECT doc_id, list_distinct({_TOKENS.format('text')}) AS w FROM documents), s AS (SELECT doc_id, list_filter(w, lambda t: length(t) >= 5) AS a, list_filter(w, lambda t: length(t) BETWEEN 5 AND 10) AS b, list_filter(w, lambda t: length(t) >= 5 AND t < 'tr') AS c, list_filter(w, lambda t: length(t) BETWEEN 11 AND 13) AS dropped FROM w)"


def _sets(spark, d):
    from lotwise.operators import text

    w = load(spark, d, "documents").select("doc_id", F.array_distinct(text.tokenize(F.col("text"))).alias("w"))
    size = lambda low, high: F.filter("w", lambda t: F.length(t).between(low, high))
    return w.select("doc_id", size(5, 1 << 30).alias("a"), size(5, 10).alias("b"), F.filter("w", lambda t: (F.length(t) >= 5) & (t < "tr")).alias("c"), size(11, 13).alias("dropped"))


_EQUAL = "list_sort({0}) = list_sort({1})"


@query(f"WITH {_SETS}, r AS (SELECT *, list_distinct(list_concat(b, list_intersect(list_filter(a, lambda t: NOT list_contains(b, t)), dropped))) AS back FROM s) SELECT count(*) AS n, near(avg(CASE WHEN {_EQUAL.format('a', 'b')} THEN 1 ELSE 0 END)) AS exact, near(avg(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 1 END)) AS jaccard, near(avg(CASE WHEN {_EQUAL.format('a', 'back')} THEN 1 ELSE 0 END)) AS restored FROM r")
def evl_set_agreement(spark, d):
    return rounded(m.set_agreement(_sets(spark, d), "a", "b", drops_b="dropped"))


@query(f"WITH {_SETS} SELECT count(*) AS n, near(avg(CASE WHEN {_EQUAL.format('a', 'b')} AND {_EQUAL.format('a', 'c')} THEN 1 ELSE 0 END)) AS exact FROM s")
def evl_all_agree(spark, d):
    return rounded(m.all_agree(_sets(spark, d), ["a", "b", "c"]))


@query(f"WITH {_SETS}, x AS (SELECT 'missing' AS kind, unnest(list_filter(b, lambda t: NOT list_contains(c, t))) AS token FROM s UNION ALL SELECT 'extra', unnest(list_filter(c, lambda t: NOT list_contains(b, t))) FROM s), k AS (SELECT kind, token, count(*) AS n FROM x GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, token) AS INTEGER) AS k FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, token) <= 10")
def evl_missing_extra(spark, d):
    return m.missing_extra(_sets(spark, d), "b", "c")


@query(f"WITH {_SETS} SELECT near(avg(CASE WHEN len(dropped) = 0 THEN 1 ELSE 0 END)) AS abstain_rate, near(avg(CASE WHEN len(dropped) > 0 AND len(list_intersect(c, dropped)) = 0 THEN 1 ELSE 0 END)) AS false_rate, near(sum(len(list_intersect(c, dropped))) / sum(len(dropped))) AS precision, near(sum(len(list_intersect(c, dropped))) / sum(len(c))) AS recall FROM s")
def evl_abstain(spark, d):
    return rounded(m.abstain(_sets(spark, d), "c", "dropped"))


@query(f"WITH {_SETS}, f AS (SELECT unnest(a) AS term FROM s WHERE len(dropped) = 0) SELECT term, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, term LIMIT 20")
def evl_false_terms(spark, d):
    return m.false_terms(_sets(spark, d), "dropped", "a")


@query("""WITH v AS (SELECT p_size AS query_id, p_partkey AS item, unnest(['brand', 'price', 'name']) AS field, unnest([p_brand, CAST(p_retailprice AS VARCHAR), p_name]) AS value FROM part), r AS (SELECT * FROM (VALUES ('brand', 'in'), ('price', 'gte'), ('price', 'lte'), ('name', 'starts_with_any')) r(field, op)),
    o AS (SELECT query_id, field, op, CASE op WHEN 'in' THEN value IN ('Brand#1', 'Brand#2') WHEN 'gte' THEN CAST(CASE WHEN field = 'price' THEN value END AS DOUBLE) >= 950 WHEN 'lte' THEN CAST(CASE WHEN field = 'price' THEN value END AS DOUBLE) <= 1500 ELSE starts_with(value, 're') OR starts_with(value, 'b') END AS ok FROM v JOIN r USING (field))
    SELECT query_id, field, op, count(*) AS n, near(avg(CASE WHEN ok THEN 1 ELSE 0 END)) AS pass_rate FROM o GROUP BY ALL""")
def evl_filter_compliance(spark, d):
    p = load(spark, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("string").alias("price"), F.col("p_name").alias("name"))
    results = p.unpivot(["query_id", "item"], ["brand", "price", "name"], "field", "value")
    rules = spark.createDataFrame([("brand", "in", "Brand#1,Brand#2"), ("price", "gte", "950"), ("price", "lte", "1500"), ("name", "starts_with_any", "re,b")], "field string, op string, arg string")
    per = p.select("query_id").distinct().join(F.broadcast(rules), F.lit(True))
    return rounded(m.compliance(results, per))


# -- calibration

_CAL = "c AS (SELECT CAST(l_quantity AS DOUBLE) / 51 AS p, l_extendedprice > 50000 AS y FROM lineitem)"


def _cal(spark, d):
    return load(spark, d, "lineitem").select((F.col("l_quantity") / 51).alias("p"), (F.col("l_extendedprice") > 50000).alias("y"))


@query(f"""WITH {_CAL}, z AS (SELECT ln(p / (1 - p)) AS z, CASE WHEN y THEN 1.0 ELSE 0.0 END AS y FROM (SELECT least(greatest(p, 1e-6), 1 - 1e-6) AS p, y FROM c)), t AS (SELECT 0.25 + 3.75 * i / 60 AS t FROM range(61) r(i)),
    n AS (SELECT t, round(avg(-(y * ln(1 / (1 + exp(-z / t))) + (1 - y) * ln(1 - 1 / (1 + exp(-z / t))))), 9) AS nll FROM z, t GROUP BY ALL) SELECT (SELECT count(*) FROM c) AS n, near(t) AS temperature, near(nll) AS nll FROM n ORDER BY n.nll, t LIMIT 1""")
def cal_temperature(spark, d):
    return rounded(m.temperature(_cal(spark, d), "p", "y"))


@query(f"WITH {_CAL}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(CASE WHEN y THEN 1 ELSE 0 END) AS acc FROM c GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n, near(sum(n * abs(conf - acc)) / sum(n)) AS ece FROM b")
def cal_ece(spark, d):
    return rounded(m.ece(_cal(spark, d), "p", "y"))


_ENTROPY = "s AS (SELECT vec_id, label, list_transform(embedding, lambda x: 5 * CAST(x AS DOUBLE)) AS v FROM embeddings), t AS (SELECT vec_id, label, list_transform(v, lambda x: exp(x) / list_sum(list_transform(v, lambda y: exp(y)))) AS p FROM s), h AS (SELECT vec_id, label, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(64) AS h FROM t)"


def _entropies(spark, d):
    v = F.transform("embedding", lambda x: 5 * x.cast("double"))
    return load(spark, d, "embeddings").select("vec_id", "label", v.alias("v")).select("vec_id", "label", m.entropy(F.col("v")).alias("h"))


@query(f"WITH {_ENTROPY} SELECT vec_id, near(h) AS entropy FROM h")
def cal_probe(spark, d):
    return rounded(_entropies(spark, d).select("vec_id", F.col("h").alias("entropy")))


@query(f"""WITH {_ENTROPY}, c AS (SELECT label % 3 AS tier, h, CASE WHEN vec_id % 5 < 2 + label % 3 THEN 1.0 ELSE 0.0 END AS y FROM h), g AS (SELECT -8 + 16.0 * i / 160 AS b FROM range(161) r(i)),
    z AS (SELECT tier, b, y, least(greatest(1 / (1 + exp(-(4 * (1 - h) + b))), 1e-9), 1 - 1e-9) AS p FROM c, g), n AS (SELECT tier, b, count(*) AS n, avg(y) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS nll FROM z GROUP BY ALL)
    SELECT tier, n, near(accuracy) AS accuracy, near(arg_min(b, nll)) AS beta, near(max(nll) FILTER (abs(b) < 1e-9)) AS before, near(min(nll)) AS after FROM n GROUP BY ALL""")
def cal_probe_fit(spark, d):
    c = _entropies(spark, d).select((F.col("label") % 3).alias("tier"), "h", (F.col("vec_id") % 5 < 2 + F.col("label") % 3).alias("y"))
    return rounded(m.fit_probe(c, "h", "y", ["tier"]))


@query("SELECT p_partkey, near(exp(0.7 * ln(greatest(p_size / 51, 1e-9)) + 0.3 * ln(greatest(p_retailprice / 3000, 1e-9)))) AS p FROM part")
def cal_combine(spark, d):
    return rounded(load(spark, d, "part").select("p_partkey", m.combine(F.col("p_size") / 51, F.col("p_retailprice") / 3000, 0.7).alias("p")))


# -- training data


@query("""WITH s AS (SELECT conv_id * 100 + turn AS id, role AS label, text, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (conv_id % 700) + INTERVAL 1 SECOND * CAST(turn + conv_id AS INTEGER) AS ts FROM conversations), n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM s WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 29 DAYS AND ts <= TIMESTAMP '2024-01-30'),
    o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY label, norm ORDER BY ts DESC, text, id) = 1), w AS (SELECT * FROM o WHERE norm NOT IN (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM benchmark)), f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY ts DESC, text, id) <= 50),
    r AS (SELECT * FROM f ORDER BY ts DESC, text, id, label LIMIT 80) SELECT id, label, text FROM r WHERE label IN (SELECT label FROM r GROUP BY ALL HAVING count(*) >= 5)""")
def trn_harvest_signals(spark, d):
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id % 700 AS INT), 0, CAST(turn + conv_id AS INT))")
    s = load(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("label"), "text", at.alias("ts"))
    return m.harvest(s, load(spark, d, "benchmark"), "label", "text", "ts", NOW, 29, 50, 80, 5).select("id", "label", "text")


@query(f"WITH {_CENT}, s AS (SELECT vec_id AS id, e.label, ce.label AS other, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS score FROM embeddings e JOIN ce ON e.label <> ce.label) SELECT id, label, other, near(score) AS score FROM s WHERE score > 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s.score DESC, other) = 1")
def trn_hard_negatives(spark, d):
    e = load(spark, d, "embeddings")
    return rounded(m.hard_negatives(e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), vectors.centroids(e, "label", "embedding"), 0.1))


def _centroids_sql(name: str, where: str) -> str:
    return f"{name}u AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE {where}), {name}m AS (SELECT label, i, avg(x) AS m FROM {name}u GROUP BY ALL), {name}n AS (SELECT label, sqrt(sum(m * m)) AS n FROM {name}m GROUP BY ALL), {name} AS (SELECT label, list(m / n ORDER BY i) AS c FROM {name}m JOIN {name}n USING (label) GROUP BY ALL)"


def _nearest_sql(name: str) -> str:
    return f"(SELECT vec_id, label FROM (SELECT vec_id, {name}.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS s FROM embeddings, {name}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1)"


@query(f"""WITH bg AS (SELECT label FROM embeddings GROUP BY ALL HAVING count(*) >= 5), {_centroids_sql('nw', 'label IN (SELECT label FROM bg)')}, {_centroids_sql('od', 'vec_id % 10 = 3')}
    SELECT count(*) AS n, near(avg(CASE WHEN a.label = b.label THEN 1 ELSE 0 END)) AS agreement, CASE WHEN avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0 END) >= 0.9 THEN 'promote' ELSE 'hold' END AS verdict FROM {_nearest_sql('nw')} a JOIN {_nearest_sql('od')} b USING (vec_id)""")
def trn_centroid_candidate(spark, d):
    """New centroids of all vectors against old ones of a tenth."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return rounded(m.centroid_candidate(v, vectors.centroids(v.where("id % 10 = 3"), "label", "v"), 5))


def _head(spark, d):
    held = m.holdout(F.col("vec_id").cast("string"), F.col("label").cast("string"), 0.2)
    return m.softmax_head(load(spark, d, "embeddings"), "label", "embedding", "vec_id", held=held)


@query()
def trn_softmax_head(spark, d):
    return _head(spark, d)


@query()
def trn_softmax_scores(spark, d):
    """Precision, recall and F1 of each class on the rows that weren't learnt from."""
    return rounded(m.class_scores(_head(spark, d).where("held"), "label", "predicted"))


@query("WITH r AS (SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) SELECT doc_id, lang, CAST(('0x' || left(h, 8)) AS BIGINT) / 4294967295 < 0.2 OR k = 1 AS held_out FROM r")
def trn_stratified_split(spark, d):
    return m.stratified_split(load(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.2)


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def hst_forget_user(spark, d):
    who = load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return m.forget(load(spark, d, "events").select("event_id", "user_id"), "user_id", who)


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 14 DAYS AND user_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5")
def hst_retention(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    return m.retention(e, "user_id", "ts", 5, NOW, 14, e.where("user_id % 10 = 0").select("user_id").distinct()).select("event_id", "user_id")
