"""Exact quantiles of groups that no task may sort whole, against sorted lists."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwise.functions import quantiles

QS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def plain(values, q, rule):
    v = sorted(values)
    n = len(v)
    if rule == "element":
        return v[min(math.floor(q * n), n - 1)]
    if rule == "nearest_rank":
        return v[max(math.ceil(q * n), 1) - 1]
    at = q * (n - 1)
    return v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at))


@pytest.mark.parametrize("rule", ["element", "nearest_rank", "linear"])
@pytest.mark.parametrize("keyed", [True, False])
def test_narrowed_groups_equal_sorted_lists(spark, monkeypatch, rule, keyed):
    """One group of distinct doubles, one with heavy repeats, a NULL key, and one that fits a task; NULL values don't count."""
    monkeypatch.setattr(quantiles, "RANGE", 40)
    rng = random.Random(3)
    rows = [("hot", rng.uniform(-1e6, 1e6)) for _ in range(5000)] + [("even", float(rng.choice([1, 1, 1, rng.randrange(300)]))) for _ in range(3000)]
    rows += [(None, rng.gauss(0, 1)) for _ in range(700)] + [("few", float(i)) for i in range(7)] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = quantiles.grouped(df, ["k"] if keyed else [], "v", QS, rule).collect()
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k if keyed else "all", []).append(v)
    assert len(got) == len(groups)
    for r in got:
        values = groups[r["k"] if keyed else "all"]
        assert r["n"] == len(values)
        for name, q in QS.items():
            assert r[name] == pytest.approx(plain(values, q, rule), rel=1e-12, abs=1e-12)


def test_no_range_holds_more_than_the_limit(spark):
    """What is sorted in the end is small, and its place is right."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.hash("id") % 1_000_003).cast("double").alias("__v")).groupBy("k", "__v").agg(F.count("*").alias("__c"))
    d = df.count()
    states = spark.createDataFrame([("k", "a", 0, None, None, d), ("k", "b", 10_000, None, None, d), ("k", "c", 19_999, None, None, d)], "k string, __q string, __k long, __lo double, __hi double, __d long")
    values = sorted(v for r in df.collect() for v in [r["__v"]] * r["__c"])
    for r in quantiles.narrowed(df, ["k"], states, limit=100).collect():
        assert r["__d"] <= 100
        held = [v for v in values if r["__lo"] <= v <= r["__hi"]]
        assert held[r["__k"]] == values[{"a": 0, "b": 10_000, "c": 19_999}[r["__q"]]]


def test_dates_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANGE", 10)
    days = [datetime(2024, 1, 1) + timedelta(hours=i) for i in range(200)]
    got = quantiles.grouped(spark.createDataFrame([(d,) for d in days], "t timestamp"), [], "t", {"mid": 0.5}).first()
    assert got["n"] == 200 and got["mid"] == days[100]
    assert quantiles.grouped(spark.createDataFrame([], "k string, v double"), ["k"], "v", QS, "linear").count() == 0


@pytest.mark.parametrize("limit", [40, 500_000])
def test_baselines_count_each_row_once(spark, monkeypatch, limit):
    """The group of all rows comes from the counts of the others, also where it is narrowed and where a key has its name."""
    from lotwise.operators.templates import market_baselines

    monkeypatch.setattr(quantiles, "RANGE", limit)
    plans, stored = {}, quantiles.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(quantiles, "stored", watched)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None, "_global"]), float(rng.choice([7, 7, rng.randrange(-50, 900)]))) for _ in range(3000)] + [("c", None), ("d", -1.0), ("e", 7.0)]
    got = {r["tld"]: (r["n"], r["baseline"]) for r in market_baselines(spark.createDataFrame(rows, "t string, p double"), "t", "p").collect()}
    groups = {"_global": []}
    for k, v in rows:
        if v is not None and v > 0:
            groups.setdefault(k, []).append(v)
            groups["_global"].append(v)
    assert got == {k: (len(v), plain(v, 0.5, "nearest_rank")) for k, v in groups.items()}
    assert "Generate" not in plans["counts"]
