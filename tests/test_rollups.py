"""Ranges of time from rollups against the base table, and frequent items against exact counts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwise.operators import rollups

START = datetime(2023, 11, 20)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(START + timedelta(minutes=rng.randrange(60 * 24 * 130)), rng.choice("abc"), rng.choice("xy"), float(rng.randrange(100)) if rng.random() < 0.9 else None) for _ in range(3000)]
    return spark.createDataFrame(data, "ts timestamp, d string, e string, v double").cache()


@pytest.fixture(scope="module")
def catalog(rows):
    made = [rollups.Rollup(g, rollups.build(rows, "ts", g, dims, ["v"]).cache(), tuple(dims), g, ("v",), n) for g, dims, n in (("month", ["d"], 10), ("day", ["d", "e"], 500), ("hour", ["d", "e"], 3000))]
    return rollups.Catalog(made, rows, "ts")


def test_ranges_are_cut_into_whole_periods():
    parts = rollups.cut(datetime(2024, 1, 30, 22, 30), datetime(2024, 4, 2, 1, 15))
    assert [(g, str(a), str(b)) for g, a, b in parts] == [
        (None, "2024-01-30 22:30:00", "2024-01-30 23:00:00"),
        ("hour", "2024-01-30 23:00:00", "2024-01-31 00:00:00"),
        ("day", "2024-01-31 00:00:00", "2024-02-01 00:00:00"),
        ("month", "2024-02-01 00:00:00", "2024-04-01 00:00:00"),
        ("day", "2024-04-01 00:00:00", "2024-04-02 00:00:00"),
        ("hour", "2024-04-02 00:00:00", "2024-04-02 01:00:00"),
        (None, "2024-04-02 01:00:00", "2024-04-02 01:15:00"),
    ]
    rng = random.Random(1)
    for _ in range(300):
        a = START + timedelta(seconds=rng.randrange(10**7))
        b = a + timedelta(seconds=rng.choice([0, 5, 4000, 10**5, 3 * 10**6, 10**7]))
        parts = rollups.cut(a, b, rng.choice([["month", "day", "hour"], ["day"], ["month", "hour"], []]))
        ends = [x for _, *x in parts]
        assert (not parts) == (a == b) and (not parts or ends[0][0] == a and ends[-1][1] == b and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False)))


@pytest.mark.parametrize("ends", [((2023, 12, 5, 3, 17), (2024, 3, 2, 9, 41)), ((2023, 12, 1), (2024, 2, 1)), ((2024, 1, 1, 5), (2024, 1, 1, 5, 1)), ((2023, 12, 31, 23, 59), (2024, 1, 1, 0, 1))])
@pytest.mark.parametrize(("dims", "where"), [(["d"], None), (["e"], {"d": "a"}), ([], None)])
def test_ranges_equal_the_base_table(rows, catalog, ends, dims, where):
    a, b = (datetime(*x) for x in ends)
    inside = rows.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
    for k, v in (where or {}).items():
        inside = inside.where(F.col(k) == v)
    told = lambda df: sorted((tuple(r[c] for c in dims), r["n"], r["v__sum"], r["v__min"], r["v__max"]) for r in df.collect() if r["n"])
    want = inside.groupBy(*dims).agg(F.count("*").alias("n"), F.sum("v").alias("v__sum"), F.min("v").alias("v__min"), F.max("v").alias("v__max"))
    assert told(catalog.aggregate_range(dims, ["v"], a, b, where)) == told(want)


def test_parts_come_from_the_coarsest_rollup_that_holds_the_question(catalog):
    a, b = datetime(2023, 12, 1), datetime(2024, 2, 3)
    assert [r.grain for r, *_ in catalog.parts(["d"], ["v"], a, b)] == ["month", "day"]
    assert [r.grain for r, *_ in catalog.parts(["e"], ["v"], a, b)] == ["day"]  # months lack this dimension
    with pytest.raises(LookupError):
        rollups.Catalog(catalog.rollups).aggregate_range(["d"], ["v"], a, datetime(2024, 2, 3, 0, 30))


def test_frequent_items_within_the_bound(spark, monkeypatch):
    """Far more different items than a sketch tracks, merged from many states: counts within the bound, and no item over it is missed."""
    monkeypatch.setattr(rollups, "TRACKED", 128)
    n = 60_000
    item = F.when(F.col("id") % 3 == 0, F.floor(F.pow(F.col("id") % 400, 0.5))).otherwise(1000 + F.col("id") % 20_000)
    df = spark.range(n).select(F.concat(F.lit("i"), item.cast("string")).alias("v"), F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919) % 800_000).alias("ts"))
    merged = rollups.merge(rollups.build(df, "ts", "hour", [], [], frequent=["v"]), [])
    exact = {r["v"]: r["count"] for r in df.groupBy("v").count().collect()}
    got = {r["value"]: r["n"] for r in rollups.frequent(merged, [], "v", 128).collect()}
    bound = 2.7 / 128 * n
    assert all(abs(c - exact[v]) <= bound for v, c in got.items()) and {v for v, c in exact.items() if c > bound} <= set(got)


def test_frequent_items_are_exact_where_all_are_tracked(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.concat(F.lit("v"), (F.col("id") % 50 * (F.col("id") % 3)).cast("string")).alias("v"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    merged = rollups.merge(rollups.build(df, "ts", "day", ["g"], [], frequent=["v"]), ["g"])
    exact = sorted(((-r["count"], r["v"]) for r in df.groupBy("v").count().collect()))[:5]
    assert [(-r["n"], r["value"]) for r in sorted(rollups.frequent(merged, ["g"], "v", 5).collect(), key=lambda r: r["rank"])] == exact
