"""Edge rules of the operators: NULLs, ties, zero division, empty input, bounds of windows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwise.functions import filters as flt
from lotwise.functions import quantiles
from lotwise.functions.times import bucket
from lotwise.operators import derive, enrich, etl, measure, rails, ranking, retrieval, rollups, sizes, text, vectors, windows
from lotwise.sources import lake, sinks
from lotwise.operators import templates as t

DAY = datetime


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_week_starts_on_sunday(spark):
    df = spark.createDataFrame([(DAY(2024, 1, 6),), (DAY(2024, 1, 7),), (DAY(2024, 1, 8),)], "ts timestamp")
    got = [str(r[0]) for r in df.select(bucket(F.col("ts"), "week")).collect()]
    assert got == ["2023-12-31", "2024-01-07", "2024-01-07"]
    with pytest.raises(ValueError):
        bucket(F.col("ts"), "year")


def test_growth_of_first_period_and_of_zero_is_null(spark):
    df = spark.createDataFrame([("a", 0.0, DAY(2024, 1, 1)), ("a", 5.0, DAY(2024, 2, 1)), ("a", 10.0, DAY(2024, 3, 1)), ("b", None, DAY(2024, 1, 1))], "e string, m double, ts timestamp")
    got = {(r["entity"], r["period"].month): r["growth_pct"] for r in t.growth_rate(df, "e", "m", "ts").collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): 100.0, ("b", 1): None}
    assert t.growth_rate(df.limit(0), "e", "m", "ts").count() == 0


def test_flat_series_has_no_anomaly(spark):
    df = spark.createDataFrame([("a", 1.0, DAY(2024, 1, i)) for i in range(1, 9)], "e string, m double, ts timestamp")
    assert t.anomalies(df, "e", "m", "ts").count() == 0


@pytest.mark.parametrize("values,q,element,nearest", [([1, 2, 3, 4], 0.5, 3, 2), ([7], 0.5, 7, 7), ([1, 2], 1.0, 2, 2), ([1, 1, 1, 9], 0.75, 9, 1)])
def test_quantile_conventions(spark, values, q, element, nearest):
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None)], "g int, v double")
    assert quantiles.grouped(df, ["g"], "v", {"x": q}).first()["x"] == element
    assert quantiles.grouped(df, ["g"], "v", {"x": q}, "nearest_rank").first()["x"] == nearest


def test_minmax_without_span_and_with_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "i int, v double")
    assert {r["i"]: r["v_norm"] for r in t.minmax(df, ["v"]).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


def test_funnel_needs_order_and_window(spark):
    ev = lambda u, s, k: (u, k, DAY(2024, 1, 1, 0, 0, s))
    df = spark.createDataFrame([ev("late", 0, "a"), ev("late", 50, "b"), ev("ok", 0, "a"), ev("ok", 5, "b"), ev("back", 0, "b"), ev("back", 5, "a"), ev("again", 0, "a"), ev("again", 45, "a"), ev("again", 50, "b")], "u string, k string, ts timestamp")
    got = t.funnel_levels(df, ["u"], "k", "ts", ["a", "b"], 30)
    assert {r["u"]: r["level"] for r in got.collect()} == {"late": 1, "ok": 2, "back": 1, "again": 2}


def test_funnels_against_all_chains(spark):
    rng = random.Random(3)
    events = {u: [(rng.randrange(60), rng.choice("abcx")) for _ in range(rng.randint(0, 12))] for u in range(80)}
    df = spark.createDataFrame([(u, k, DAY(2024, 1, 1, 0, 0, s)) for u, es in events.items() for s, k in es], "u int, k string, ts timestamp")
    got = {r["u"]: r["level"] for r in t.funnel_levels(df, ["u"], "k", "ts", ["a", "b", "c"], 20).collect()}
    for u, es in events.items():
        es, best = sorted({*es}), 0
        for i, (s, k) in enumerate(es):
            if k == "a":
                best = max(best, 1)
                for j in range(i + 1, len(es)):
                    if es[j][1] == "b" and es[j][0] - s <= 20:
                        best = max(best, 2, *(3 for x in es[j + 1 :] if x[1] == "c" and x[0] - s <= 20))
        assert got.get(u, 0) == best


def test_forecast_needs_three_periods(spark):
    df = spark.createDataFrame([("a", float(i), DAY(2024, i, 1)) for i in (1, 2, 3, 4)] + [("b", 1.0, DAY(2024, 1, 1))], "e string, m double, ts timestamp")
    got = t.forecast(df, "e", "m", "ts", horizon=2).collect()
    assert [r["entity"] for r in got] == ["a"] and got[0]["slope"] == pytest.approx(1) and got[0]["forecast"] == pytest.approx(6)


def test_latest_per_key_takes_nulls_last_and_one_of_ties(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 2, "y"), (2, None, "z"), (2, None, "z")], "k int, v int, s string")
    assert rows(etl.latest_per_key(df, ["k"], ["v", "s"])) == [(1, 2, "y"), (2, None, "z")]


def test_delta_skips_unknown_keys_and_nulls(spark):
    base = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, v int, s string")
    delta = spark.createDataFrame([(1, 11), (2, None), (9, 99)], "k int, v int")
    assert rows(etl.merge_delta(base, delta, "k", ["v"])) == [(1, 11, "a"), (2, 20, "b")]


def test_page_numbers_are_even(spark):
    df = spark.range(0, 1000, 3).withColumn("id", F.col("id") * F.col("id"))
    pages = etl.page_number(df, "id", 100).groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("lo")).orderBy("page").collect()
    assert [r["n"] for r in pages] == [100, 100, 100, 34]
    assert [r["lo"] for r in pages] == sorted(r["lo"] for r in pages)


def test_listing_predicate_null_rules(spark):
    df = spark.createDataFrame([(1, None, None, "red-bolt"), (2, -1.0, DAY(2020, 1, 1), "redd"), (3, 50.0, DAY(2024, 1, 1), "x")], "i int, price double, listed_at timestamp, sld string")
    ids = lambda f: [r["i"] for r in df.where(flt.build_predicate(f)).orderBy("i").collect()]
    assert ids({"price_max": 100}) == [3]
    assert ids({"listed_after": DAY(2023, 1, 1)}) == [1, 3]
    assert ids({"contains_any": ["red"]}) == [1]
    assert ids({"unknown": ["price"]}) == [1]
    with pytest.raises(ValueError):
        flt.build_predicate({"colour": 1})


def test_below_market_without_baseline_is_all(spark):
    l = spark.createDataFrame([("a", 5.0), ("b", 50.0)], "tld string, price double")
    assert flt.below_market(l, spark.createDataFrame([], "tld string, baseline double")).count() == 2
    assert rows(flt.below_market(l, spark.createDataFrame([("_global", 10.0)], "tld string, baseline double"))) == [("a", 5.0)]


def test_rollup_answers_as_the_base_does(spark):
    df = spark.createDataFrame([("a", 1, float(i), DAY(2024, 1 + i % 3, 1 + i % 5, i % 24)) for i in range(60)], "tld string, kind int, price double, ts timestamp")
    daily = rollups.build(df, "ts", "hour", ["tld", "kind"], ["price"], medians=["price"], uniques=["kind"])
    got = rollups.finish(rollups.merge(daily, ["tld"], "month")).orderBy("period").collect()
    want = df.groupBy(F.trunc("ts", "month").alias("m")).agg(F.count("*").alias("n"), F.avg("price").alias("a")).orderBy("m").collect()
    assert [(r["n"], r["price_avg"]) for r in got] == [(r["n"], r["a"]) for r in want]
    small = rollups.Rollup("small", daily, ("tld",), "hour", ("price",), 5)
    big = rollups.Rollup("big", daily, ("tld", "kind"), "hour", ("price",), 50)
    catalog = rollups.Catalog([big, small])
    assert catalog.route(["tld"], ["price"]).name == "small" and catalog.route(["kind"], ["price"]).name == "big"
    with pytest.raises(LookupError):
        catalog.aggregate(["other"], ["price"])


def test_competition_rank_skips(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("a", None)], "g string, v int")
    assert sorted(r["rank"] for r in windows.competition_rank(df, ["g"], "v").collect()) == [1, 1, 3, 4]


def test_consecutive_growth_carries_over_nulls(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 20.0), ("b", 1, 0.0), ("b", 2, 5.0)], "e string, p int, v double")
    got = {(r["e"], r["p"]): r["growth_pct"] for r in windows.consecutive_growth(df, "e", "p", "v").collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): 100.0, ("b", 1): None, ("b", 2): None}


def test_unknown_lookup_and_tiers(spark):
    df, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 7)], "k int, n int")
    assert rows(enrich.lookup(df, dim, "k", {"n": 0})) == [(1, 7), (2, 0)]
    none = F.lit(None).cast("double")
    assert df.limit(1).select(enrich.heat(none), enrich.momentum(none, none), enrich.sell_through_tier(none)).first()[:] == ("unknown",) * 3


def test_split_compound_and_distance():
    assert text.split_compound("redbolt", {"red": 1.0, "bolt": 1.0}) == ["red", "bolt"]
    assert text.split_compound("", {}) == []
    assert text.damerau("ab", "ba") == 1 and text.damerau("", "abc") == 3


def test_segment_of_hosts(spark):
    df = spark.createDataFrame([("www.foo12.co.uk",), ("bar.com",), ("host",), (None,)], "h string")
    assert [tuple(r["s"][:2]) if r["s"]["sld"] else None for r in df.select(text.segment(F.col("h")).alias("s")).collect()] == [("foo12", "co.uk"), ("bar", "com"), ("host", ""), None]


def test_knn_in_small_blocks_is_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    got = vectors.knn(df.where("id < 5").withColumnRenamed("id", "query_id"), df, 3, corpus_block=7, query_block=2).orderBy("query_id", "rank").collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u[:5] @ u.T, 9)
    want = [(q, int(i)) for q in range(5) for i in sorted((j for j in range(60) if j != q), key=lambda j: (-s[q, j], j))[:3]]
    assert [(r["query_id"], r["id"]) for r in got] == want


def test_mmr_puts_unlike_items_forward(spark):
    df = spark.createDataFrame([(1, 1, 1, ["a", "b"]), (1, 2, 2, ["a", "b"]), (1, 3, 3, ["c"])], "query_id int, item int, rank int, tokens array<string>")
    got = {r["item"]: r["new_rank"] for r in ranking.mmr(df, 0.5).collect()}
    assert got == {1: 1, 3: 2, 2: 3}


def test_rrf_ties_by_item(spark):
    df = spark.createDataFrame([(1, "x", 2, 1.0), (1, "y", 1, 1.0)], "query_id int, source string, item int, score double")
    assert [r["item"] for r in ranking.rrf(df).orderBy("rank").collect()] == [1, 2]


def test_veto_overrides(spark):
    df = spark.createDataFrame([(1, "m", "a", 5.0, 0.9), (1, "guard", "b", 1.0, 0.95)], "item int, voter string, label string, weight double, confidence double")
    assert ranking.ensemble(df).first()["label"] == "a" and ranking.ensemble(df, "guard").first()["label"] == "b"


def test_followup_is_open_below_and_closed_above(spark):
    at = lambda s: DAY(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([(1, "q", at(0)), (1, "c", at(0)), (2, "q", at(0)), (2, "c", at(10)), (3, "q", at(0)), (3, "c", at(11))], "s int, k string, ts timestamp")
    got = measure.followups(df, "s", "ts", F.col("k") == "q", F.col("k") == "c", 10).first()
    assert (got["n"], got["followed"]) == (3, 1)


def test_metrics_by_hand(spark):
    import math

    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "query_id int, item string, rank int")
    gains = spark.createDataFrame([(1, "b", 3), (1, "z", 1)], "query_id int, item string, gain int")
    got = {r["query_id"]: r for r in measure.ranking_metrics(ranked, gains, 3).collect()}
    dcg = 7 / math.log2(3)
    assert got[1]["dcg"] == pytest.approx(dcg) and got[1]["ndcg"] == pytest.approx(dcg / (7 + 1 / math.log2(3)))
    assert got[1]["mrr"] == 0.5 and got[1]["recall"] == 0.5 and got[2]["ndcg"] is None and got[2]["mrr"] == 0


def test_calibration_of_agreeing_answers_is_one(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True)], "p double, y boolean")
    assert measure.temperature(df, "p", "y").first()["temperature"] == 1.0


def test_counters_reset(spark):
    at = lambda s: DAY(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([(at(0), 0, 0), (at(1), 5, 0), (at(2), 1, 9)], "ts timestamp, h int, m int")
    got = [(r["hit_rate"], r["edge"]) for r in measure.miss_storm(df, "ts", "h", "m", 300, 0.5).orderBy("ts").collect()]
    assert got == [(None, None), (1.0, None), (pytest.approx(5 / 14), "start")]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_auction_types_and_categories(spark):
    df = spark.createDataFrame([(16,), (20,), (38,), (39,), (7,), (None,)], "i int")
    assert [r[0] for r in df.select(derive.auction_type_name(F.col("i"))).collect()] == ["expiry auction", "buynow", "expiry auction", "closeout", "other", "other"]
    want = {"ai-lab": "ai", "my-gpt4": "ai", "mail": "", "healthy": "healthcare", "best_dental": "healthcare", "banking": "fintech", "overpay": "", "the-lawyer": "legal", "cloud9": "tech", "homestead": "real-estate", "dream-house": "real-estate", "workshop": "", "shopping": "ecommerce", "Legal-Tech": "legal", "": ""}
    df = spark.createDataFrame([*want.items(), (None, "")], "label string, category string")
    assert df.where(~derive.category_name(F.col("label")).eqNullSafe(F.col("category"))).count() == 0


def test_urgency_at_its_bounds(spark):
    now = DAY(2024, 1, 1)
    df = spark.createDataFrame([(now + timedelta(minutes=m),) for m in (-5, 59, 60, 359, 360, 1439, 1440)] + [(None,)], "ends timestamp")
    assert [r[0] for r in df.select(enrich.urgency(F.col("ends"), now)).collect()] == ["critical", "critical", "high", "high", "medium", "medium", "low", "unknown"]


def test_fresh_rail_has_no_bids(spark):
    now = DAY(2024, 1, 1)
    df = spark.createDataFrame([(1, 0, now + timedelta(days=1)), (2, 1, now + timedelta(days=2)), (3, 0, now + timedelta(days=3)), (4, 0, now - timedelta(days=1))], "auction_id int, bids int, ends_at timestamp")
    assert [r["auction_id"] for r in rails.fresh(df, now).orderBy("rank").collect()] == [3, 1]


def test_traffic_tiers_and_signals(spark):
    import math

    def proxy(**signals):
        return one(spark, enrich.traffic_proxy(**{k: F.lit(v) for k, v in signals.items()}).alias("p"))["p"][:]

    assert [proxy(visits=v)[2] for v in (0, 1, 99, 100, 999, 1000, 9999, 10000)] == [0, 1, 1, 2, 2, 3, 3, 4]
    assert proxy() == (0.0, False, 0) and proxy(search_volume=5)[1:] == (True, 1) and proxy(trust_flow=1)[1:] == (True, 1)
    assert proxy(indexed_pages=100)[1:] == (False, 0) and proxy(indexed_pages=101)[1:] == (True, 0) and proxy(authority=50, revenue=9.5)[1:] == (False, 0)
    want = 0.4 * math.log1p(500) + 0.25 * math.log1p(20) + 0.15 * math.log1p(300) + 0.1 * math.log1p(7) + 0.05 * math.log1p(12) + 0.05 * math.log1p(150)
    assert proxy(visits=500, search_volume=20, authority=30.0, indexed_pages=7, trust_flow=12, revenue=1.5)[0] == round(want, 4)
    none = F.lit(None).cast("int")
    assert one(spark, *[enrich.best_traffic(*map(F.lit, x)) for x in ((5, 9, 3), (0, 100, 3), (0, 0, 3))], enrich.best_traffic(none, none, none))[:] == (5.0, 214.0, 3.0, 0.0)


def test_brandability_by_hand(spark):
    want = {"": 0.0, "bcdfg": (10 / 12 + 0 + (1 - 2 / 5)) / 3, "aeiou": (10 / 12 + 0 + 1) / 3, "zoomi": (10 / 12 + (1 - abs(0.6 - 0.4) / 0.4) + 1) / 3, "zo-om1": max(0, (9 / 12 + (1 - abs(0.5 - 0.4) / 0.4) + 1) / 3 - 0.6), "abcdefghijklmnopq": (0 + (1 - abs(4 / 17 - 0.4) / 0.4) + (1 - 2 / 17)) / 3, "123": 1 / 3 - 0.3}
    df = spark.createDataFrame([(k,) for k in want], "label string")
    got = {r["label"]: r["s"] for r in df.withColumn("s", ranking.brandability(F.col("label"))).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert one(spark, ranking.brandable_boost(F.lit(2.0), F.lit("bcd")))[0] == pytest.approx(2 * (1 + 0.25 * (1 + 0 + 1) / 3))


def test_sanitizer_masks_whole_texts_and_says_why(spark):
    df = spark.createDataFrame([(1, "x" * 50 + " a@b.co"), (2, ""), (3, None), (4, "You STUPID"), (5, "fine"), (6, "\uff41@b.co")], "i int, text string")
    got = {r["i"]: r["s"][:] for r in df.withColumn("s", flt.sanitize(F.col("text"), 20, ["stupid", ""])).collect()}
    assert got == {1: ("x" * 50 + " [REDACTED]", ["length_exceeds_20", "pii_detected"]), 2: ("", ["empty_input"]), 3: ("", ["non_string_input"]), 4: ("You STUPID", ["blocked_pattern_matched"]), 5: ("fine", []), 6: ("[REDACTED]", ["pii_detected"])}


def test_every_slot_of_the_predicate(spark):
    columns = sorted({*flt.RANGES.values(), *flt.FLAGS.values()})
    rows = [(i, *[None if i == 0 else float(i)] * len(columns)) for i in range(4)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in columns)).withColumn("sld", F.lit("red-bolt7")).withColumn("tld", F.lit("com")).withColumn("type_id", F.lit(16))
    ids = lambda f: [r["i"] for r in df.where(flt.build_predicate(f, DAY(2024, 1, 1))).orderBy("i").collect()]
    for stem, column in flt.RANGES.items():
        assert ids({f"{stem}_min": 2}) == [2, 3] and ids({f"{stem}_max": 2}) == [1, 2], stem
        assert ids({"unknown": [column], f"{stem}_min": 2}) == [0], stem
    for slot in flt.FLAGS:
        assert ids({slot: True}) == [1] and ids({slot: False}) == [], slot
    every = [0, 1, 2, 3]
    for f, want in [({"letters_min": 7}, every), ({"letters_min": 8}, []), ({"digits_min": 1, "digits_max": 1}, every), ({"exclude_keywords": ["red"]}, []), ({"exclude_keywords": ["olt"]}, every), ({"exclude_keywords": ["bolt7"]}, []), ({"exclude_keywords": ["d-bolt"]}, []), ({"phrase": "red bolt"}, every), ({"types": ["expiry auction"]}, every), ({"types": ["closeout", 20]}, []), ({"exclude_types": ["16"]}, [])]:
        assert ids(f) == want, f
    at = spark.createDataFrame([(1, None, None), (2, DAY(2024, 1, 2), DAY(2024, 1, 1)), (3, DAY(2024, 1, 9), DAY(2023, 1, 1))], "i int, ends_at timestamp, listed_at timestamp").withColumn("sld", F.lit("x")).withColumn("type_id", F.col("i")).withColumn("gem", F.col("i") == 2)
    ids = lambda f: [r["i"] for r in at.where(flt.build_predicate(f, DAY(2024, 1, 1))).orderBy("i").collect()]
    for f, want in [({"listed_before": DAY(2023, 6, 1)}, [1, 3]), ({"listed_after": DAY(2023, 6, 1)}, [1, 2]), ({"ends_before": DAY(2024, 1, 5)}, [2]), ({"gem": True}, [2]), ({"gem": False}, [1, 2, 3]), ({"lifecycle_disjunction": True, "time_remaining_max": 86400, "lifecycle": [3]}, [2, 3])]:
        assert ids(f) == want, f


def test_whole_documents_have_all_their_tokens(spark):
    said = " ".join(f"word{i}" for i in range(500))
    assert len(one(spark, text.tokenize(F.lit(said)))[0]) == 500 and len(one(spark, text.tokenize(F.lit(said), cap=64))[0]) == 64


def test_sparse_product_in_small_blocks(spark):
    rng = random.Random(5)
    docs = [(d, b, round(rng.random(), 3)) for d in range(60) for b in {0, *rng.sample(range(1, 30), 5)}]
    queries = [(q, b, round(rng.random(), 3)) for q in range(7) for b in rng.sample(range(30), 4)] + [(9, 999, 1.0)]
    got = text.sparse_dot(spark.createDataFrame(queries, "query_id int, bucket int, weight double"), spark.createDataFrame(docs, "doc_id int, bucket int, weight double"), 5, entries=40, query_block=2)
    want = []
    for q in range(7):
        scores = {}
        for a, b, w in queries:
            for d, c, v in docs:
                if a == q and b == c:
                    scores[d] = scores.get(d, 0) + w * v
        want += [(q, d, i + 1) for i, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:5])]
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == want


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skipped_ranges_change_nothing(spark, k):
    """Random vectors and skewed ones, of which most ranges can't reach the best scores; ties at the k-th score."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(k)
    rows = [(d, int(b), float(w)) for d in range(900) for b, w in zip(rng.choice(40, 6, replace=False), np.round(rng.pareto(1.5, 6), 2 if d % 2 else 0) + 0.1, strict=True)]
    docs = pd.DataFrame(rows, columns=["doc_id", "bucket", "weight"])
    cell, skipped = text._Postings(docs), 0
    for q in range(40):
        buckets = np.sort(rng.choice(50, 5, replace=False))
        weights = np.round(rng.random(5), 1) + (0 if q % 4 else 5 * (np.arange(5) == 0))
        scores = docs.merge(pd.DataFrame({"bucket": buckets, "w": weights}), on="bucket").assign(s=lambda x: x["w"] * x["weight"]).groupby("doc_id")["s"].sum().round(9)
        scores = scores[scores > 0]
        ids, said, gone = cell.best(buckets, weights, k)
        skipped += gone
        best = sorted(zip(-np.round(said, 9), ids, strict=True))[:k]
        want = sorted(((-s, i) for i, s in scores.items()))[:k]
        assert [i for _, i in best] == [i for _, i in want] and [s for s, _ in best] == pytest.approx([s for s, _ in want])
    assert skipped > 100


def test_narrow_products_of_given_pairs(spark):
    docs = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 0, 1.0), (3, 5, 1.0)], "doc_id int, bucket int, weight double")
    asked = spark.createDataFrame([(7, 0, 1.0), (7, 1, 3.0), (8, 0, 1.0)], "query_id int, bucket int, weight double")
    pairs = spark.createDataFrame([(7, 1), (7, 3), (8, 2)], "query_id int, item int")
    assert {(r["query_id"], r["item"]): r["score"] for r in text.narrow_dot(pairs, asked, docs).collect()} == {(7, 1): 5.0, (8, 2): 1.0}


def test_hybrid_steps(spark):
    leg = lambda *rows: spark.createDataFrame([(1, i, s) for i, s in rows], "query_id int, item int, score double")
    a, b = leg((1, 9.0), (2, 8.0), (3, 7.0)), leg((3, 5.0), (4, 4.0))
    items = lambda df: [r["item"] for r in df.orderBy("rank").collect()]
    assert items(retrieval.hybrid({"a": a, "b": b}, 3)) == [3, 1, 2]
    assert items(retrieval.hybrid({"a": a, "b": b}, 4, prefetch=1)) == [1, 3]
    vectors = lambda who, *rows: spark.createDataFrame(list(rows), f"{who} int, bucket int, weight double")
    again = (vectors("query_id", (1, 0, 1.0), (1, 1, 0.5)), vectors("doc_id", (1, 0, 0.1), (2, 0, 0.4), (2, 1, 1.0), (3, 0, 0.5), (4, 7, 9.0), (5, 0, 9.0)))
    assert items(retrieval.hybrid({"a": a, "b": b}, 4, rerank=again, least=0.2)) == [2, 3]
    assert items(retrieval.hybrid({"a": a, "b": b}, 1, keep=spark.createDataFrame([(4,)], "item int"))) == [4]


def test_fuzzy_knows_transpositions(spark):
    df = spark.createDataFrame([(1, 1, 1.0, ["red", "bolt"]), (1, 2, 1.0, ["blue"]), (1, 3, 1.0, None)], "query_id int, item int, score double, t array<string>")
    got = {r["item"]: (round(r["coverage"], 6), r["rank"]) for r in ranking.fuzzy(df, F.array(F.lit("rde"), F.lit("bolts")), F.col("t")).collect()}
    assert got == {1: (1.0, 1), 2: (0.0, 2), 3: (0.0, 3)}


def test_mmr_against_a_plain_program(spark):
    rng = random.Random(8)
    lists = [(q, i, r + 1, rng.sample("abcdef", rng.randint(1, 4))) for q in range(4) for r, i in enumerate(rng.sample(range(30), 8))]
    got = {(r["query_id"], r["item"]): r["new_rank"] for r in ranking.mmr(spark.createDataFrame(lists, "query_id int, item int, rank int, tokens array<string>"), 0.4).collect()}
    for q in range(4):
        left, chosen = [x for x in lists if x[0] == q], []
        while left:
            near = lambda x: max((len({*x[3]} & {*c[3]}) / len({*x[3]} | {*c[3]}) for c in chosen), default=0.0)
            best = max(left, key=lambda x: (0.6 / (1 + x[2]) - 0.4 * near(x), -x[2]))
            left.remove(best)
            chosen.append(best)
            assert got[q, best[1]] == len(chosen)


def test_clusters_of_directions(spark):
    rng = random.Random(9)
    rows = [(i, [(3.0 if j == i % 3 else 0.0) + rng.uniform(-0.2, 0.2) for j in range(3)]) for i in range(60)]
    rows = [(i, [x * (1 + i) for x in v]) for i, v in rows]
    got = vectors.kmeans(spark.createDataFrame(rows, "id int, v array<double>"), "v", 3, seed=3).select("id", "cluster").collect()
    assert len({(r["id"] % 3, r["cluster"]) for r in got}) == 3 == len({r["cluster"] for r in got})


def test_head_learns_without_held_rows(spark):
    rows = [(i, i % 3, [float(i % 3 == j) + (i % 7) / 50 for j in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    got = measure.softmax_head(df, "label", "v", "id", held=F.col("id") % 4 == 0)
    assert got.where("held").count() == 23 and got.where("label <> predicted").count() == 0
    scores = measure.class_scores(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "a int, b int"), "a", "b")
    assert {r["label"]: (r["n"], r["precision"], r["recall"], round(r["f1"], 4)) for r in scores.collect()} == {0: (2, 1.0, 0.5, 0.6667), 1: (1, pytest.approx(1 / 3), 1.0, 0.5), 2: (1, 0.0, 0.0, 0.0)}


def test_storms_are_the_same_in_small_slices(spark):
    rng = random.Random(10)
    rows, h, x, t0 = [], 0, 0, DAY(2024, 1, 1)
    for i in range(400):
        t0 += timedelta(seconds=rng.choice([1, 20, 90, 900]))
        h, x = (0, 0) if rng.random() < 0.02 else (h + rng.randrange(3), x + rng.randrange(4))
        rows.append((i, t0, h, x))
    df = spark.createDataFrame(rows, "i int, ts timestamp, h int, x int")
    told = lambda s: [tuple(r) for r in measure.miss_storm(df, "ts", "h", "x", 300, 0.4, slice_s=s).orderBy("i").collect()]
    assert told(300) == told(1 << 30) and {r[-1] for r in told(300)} == {None, "start", "end"}
    sums = measure.running_sums(df.select("i", "ts", "h"), "ts", ["h"], slice_s=300).orderBy("i").collect()
    total = 0
    for r, row in zip(sums, rows, strict=True):
        total += row[2]
        assert r["h"] == total


def test_split_holds_out_one_of_every_class(spark):
    df = spark.createDataFrame([(i, "a") for i in range(400)] + [(1000, "b"), (1001, None)], "k int, c string")
    got = {r["c"]: r["n"] for r in measure.stratified_split(df, "c", "k", 0.2).where("held_out").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got["b"] == got[None] == 1 and 50 < got["a"] < 110


def test_agreement_after_drops_are_restored(spark):
    df = spark.createDataFrame([(["x", "y"], ["x"], ["y"]), (["x", "y"], ["x"], ["z"]), (["x"], ["x"], [])], "a array<string>, b array<string>, gone array<string>")
    got = measure.set_agreement(df, "a", "b", drops_b="gone").first()
    assert (got["n"], round(got["exact"], 4), round(got["restored"], 4)) == (3, 0.3333, 0.6667)
    assert measure.all_agree(df, ["a", "b"]).first()["exact"] == pytest.approx(1 / 3)


def test_entropy_and_probe(spark):
    got = one(spark, measure.entropy(F.array(F.lit(1.0), F.lit(1.0))), measure.entropy(F.array(F.lit(50.0), F.lit(0.0))), measure.entropy(F.array(F.lit(3.0))))
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0, abs=1e-9) and got[2] == 0
    few = measure.fit_probe(spark.createDataFrame([(0.5, True)], "h double, y boolean"), "h", "y").first()
    assert few["beta"] == 30.0 and few["after"] is None
    df = spark.createDataFrame([(0.5, i % 4 != 0) for i in range(100)], "h double, y boolean")
    got = measure.fit_probe(df, "h", "y").first()  # sigmoid(2 + beta) = 0.75
    assert got["beta"] == pytest.approx(-0.9) and got["after"] < got["before"]


def test_points_have_uuids_of_their_keys_and_loads_repeat(spark):
    import uuid

    docs = spark.createDataFrame([(1, "red bolt", "x"), (2, "", "y"), (3, None, "z")], "k int, text string, lang string")
    index = lake.Index(spark)
    index.load(docs, "k", "text", 0)
    assert {r["k"]: r["point_id"] for r in index.points().collect()} == {k: str(uuid.uuid5(lake.POINT_NAMESPACE, f"doc:{k}")) for k in (1, 2, 3)}
    before = rows(index.points())
    index.load(docs, "k", "text", 0)  # the same load again
    assert rows(index.points()) == before
    index.load(spark.createDataFrame([(2, "blue bolt", "w")], docs.schema), "k", "text", 1)
    assert {r["k"]: (r["lang"], r["dl"], len(r["terms"])) for r in index.points().collect()} == {1: ("x", 2, 2), 2: ("w", 2, 2), 3: ("z", 0, 0)}
    index.load(docs, "k", "text", 0)  # an old load that comes late doesn't undo a newer one
    assert {r["k"]: r["lang"] for r in index.points().collect()} == {1: "x", 2: "w", 3: "z"}


def test_half_loads_equal_a_whole_load(spark):
    """Weights follow from the corpus that is there when they are asked for, whatever was loaded with what."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["red", "blue", "bolt", "ring", "gear"]) for _ in range(rng.randint(0, 30)))) for i in range(40)], "k int, text string")
    whole, halves = lake.Index(spark), lake.Index(spark)
    whole.load(docs, "k", "text", 0)
    halves.load(docs.where("k < 25").withColumn("text", F.when(F.col("k") < 20, F.col("text")).otherwise(F.lit("stale words"))), "k", "text", 0)
    halves.load(docs.where("k >= 20"), "k", "text", 1)
    told = lambda df: sorted((r["doc_id"], r["bucket"], round(r["weight"], 9)) for r in df.collect())
    direct = text.bm25_docs(text.doc_tokens(docs, "k", "text"))
    assert told(whole.words("k")) == told(halves.words("k")) == told(direct)
    assert told(halves.words("k", 7.0)) == told(text.bm25_docs(text.doc_tokens(docs, "k", "text"), mean=7.0))
    assert whole.figures().first() == halves.figures().first()


def test_models_that_are_too_large_are_refused(spark):
    with pytest.raises(ValueError, match="model"):
        sizes.model(spark.range(20), 10)
    assert "broadcast" in sizes.small(spark.range(5))._jdf.queryExecution().logical().toString().lower()


def test_ring_may_overwrite_what_it_reads(spark):
    path = sinks.folder(spark, "ring")
    new = lambda *ids: spark.createDataFrame([(i, DAY(2024, 1, 1, 0, i)) for i in ids], "i int, ts timestamp")
    held = sinks.json_ring(new(), new(1, 2, 3), "ts", 3, "i int, ts timestamp", path)
    held = sinks.json_ring(held, new(4, 5), "ts", 3, "i int, ts timestamp", path)
    assert sorted(r["i"] for r in held.collect()) == [3, 4, 5]


def test_hosts_in_other_scripts(spark):
    df = spark.createDataFrame([("xn--mnchen-3ya.de",), ("www.Foo-12bar.co.uk.",), ("xn--\u0000.com",)], "h string")
    got = [r["s"] for r in df.select(text.segment(F.col("h")).alias("s")).collect()]
    assert (got[0]["sld"], got[0]["tokens"]) == ("münchen", ["munchen"]) and (got[1]["sld"], got[1]["tld"], got[1]["tokens"]) == ("foo-12bar", "co.uk", ["foo", "12", "bar"])


def test_best_centroids_against_all_pairs(spark):
    rng = random.Random(9)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, rng.random()]) for _ in range(4)]
    cents = [(rng.randrange(5), vec()) for _ in range(12)]
    items = [(i, rng.randrange(6), vec()) for i in range(200)] + [(900, 1, None), (901, None, [0.0] * 4), (902, 2, [0.0] * 4)]
    df = spark.createDataFrame(items, "id int, label int, v array<double>")
    c = spark.createDataFrame(cents, "label int, centroid array<double>")

    def cos(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    got = {r["id"]: (r["other"], r["score"]) for r in measure.hard_negatives(df, c, 0.3).collect()}
    for i, label, v in items:
        best = min([(-cos(v or [0.0] * 4, x), l) for l, x in cents if l != label], default=None)
        assert got.get(i) == ((best[1], pytest.approx(-best[0])) if best and -best[0] > 0.3 else None), i
    one_each = spark.createDataFrame([(l, x) for l, x in {l: x for l, x in cents}.items()], c.schema)
    assert "Join" not in vectors.nearest_centroid(df, one_each, "label", "v", "id")._jdf.queryExecution().toString()
    sure = {r["id"]: (r["label"], r["score"]) for r in vectors.nearest_centroid(df, one_each, "label", "v", "id", 0.2, 0.1).collect()}
    for i, _, v in items:
        order = sorted((-cos(v or [0.0] * 4, x), l) for l, x in {l: x for l, x in cents}.items())
        fine = -order[0][0] >= 0.2 and order[1][0] - order[0][0] >= 0.1
        assert sure[i] == (order[0][1] if fine else None, pytest.approx(-order[0][0]))
    assert vectors.best_centroids(df, c.limit(0), "label", "v", 2).where(F.size("near") > 0).count() == 0
