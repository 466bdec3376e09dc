"""As-of joins against all pairs, in one slice of time and in many."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwise.operators import asof
from lotwise.operators import templates as t

START = datetime(2024, 1, 1)


def at(s):
    return None if s is None else START + timedelta(seconds=s)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(400)])) for i in range(600)]
    right = [(i, key(), rng.choice([None, *range(0, 400, 3)])) for i in range(300)] + [(900, "a", 5), (901, "a", 5)]
    frame = lambda rows, n: spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], f"{n} long, key string, ts timestamp").repartition(4)
    return left, right, frame(left, "id"), frame(right, "other")


@pytest.mark.parametrize("slice_rows", [10, 100, 1_000_000])
@pytest.mark.parametrize("forward", [False, True])
def test_nearest_rows_against_all_pairs(sides, slice_rows, forward):
    left, right, l, r = sides
    got = {x["id"]: x["met"] for x in asof.asof_join(l, r, ["key"], "ts", ["ts", "other"], forward, slice_rows).collect()}
    assert len(got) == len(left)
    for i, k, s in left:
        met = [(-x if forward else x, n) for n, o, x in right if None not in (k, s, x) and o == k and (x >= s if forward else x <= s)]
        want = max(met, default=None)
        assert got[i] == (None if want is None else (at(abs(want[0])), want[1]))


@pytest.mark.parametrize("slice_rows", [20, 1_000_000])
def test_attribution_against_all_pairs(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(asof, "SLICE_ROWS", slice_rows)
    rng = random.Random(6)
    signals = [(rng.choice("hhhhab"), rng.randrange(60), rng.randrange(5000)) for _ in range(300)]
    sales = [(rng.choice("hhhhac"), i // 2, float(i // 2), rng.randrange(5000)) for i in range(100)]
    a = spark.createDataFrame([(k, i, at(s)) for k, i, s in signals], "key string, request_id long, ts timestamp")
    b = spark.createDataFrame([(k, i, v, at(s)) for k, i, v, s in sales], "key string, sale_id long, amount double, ts timestamp")
    got = {r["key"]: r for r in t.attribution(a, b, 100 / 3600).collect()}
    assert set(got) == {k for k, _, _ in signals}
    for k, r in got.items():
        pairs = [(i, j, v) for x, i, s in signals for y, j, v, u in sales if x == y == k and 0 <= u - s <= 100]
        assert (r["asked"], r["requests"], r["sales"]) == (len({i for x, i, _ in signals if x == k}), len({i for i, _, _ in pairs}), len({j for _, j, _ in pairs}))
        assert r["revenue"] == sum(v for _, v in {(j, v) for _, j, v in pairs})


def test_a_busy_key_makes_no_pairs(spark):
    """100,000 signals and 100,000 sales of one key: 10**10 pairs if they met."""
    n = 100_000
    ts = lambda by: F.timestamp_seconds(1_700_000_000 + F.col("id") * by)
    signals = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("request_id"), ts(10).alias("ts"))
    sales = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("sale_id"), F.lit(1.0).alias("amount"), ts(20).alias("ts"))
    r = t.attribution(signals, sales, 1).first()
    # signals come every 10 s up to 1,000,000 s, sales every 20 s up to 2,000,000 s
    assert (r["asked"], r["requests"], r["sales"]) == (n, n, 50_000 + 180)


def test_steps_of_an_instant_follow_the_funnels_order(spark):
    ev = lambda u, k: (u, k, START)
    df = spark.createDataFrame([ev(1, "view"), ev(1, "click"), ev(2, "click")], "u int, k string, ts timestamp")
    for steps in (["view", "click"], ["click", "view"]):
        got = {r["u"]: r["level"] for r in t.funnel_levels(df, ["u"], "k", "ts", steps, 60).collect()}
        assert got == {1: 2, 2: 1 if steps[0] == "click" else 0}
