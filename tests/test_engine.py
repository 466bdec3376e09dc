"""Every named question can be asked, of full and of empty tables; learnt operators find what is there."""

import inspect
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lotwise.operators import measure, vectors
from lotwise.operators.engine import Market
from lotwise.plans.views import events, listings

ARGS = {"historical_sales_comparison": ((datetime(2001, 1, 1), datetime(2001, 6, 1)), (datetime(2000, 1, 1), datetime(2000, 6, 1))), "cross_tld_price_spread": ("brand1",), "cohort_price_comparison": ("brand1", "brand2")}
NAMES = [n for n, _ in inspect.getmembers(Market, inspect.isfunction) if n[0] != "_"]


@pytest.fixture(scope="module")
def markets(spark, sf):
    now = (datetime(2001, 6, 1), datetime(2024, 1, 29, 20))
    full = Market(listings(spark, sf).cache(), events(spark, sf).cache(), *now)
    return full, Market(listings(spark, sf).limit(0), events(spark, sf).limit(0), *now)


def test_there_are_as_many_as_in_the_inventory():
    assert len(NAMES) == 47


@pytest.mark.parametrize("name", NAMES)
def test_question(markets, name):
    full, none = (getattr(m, name)(*ARGS.get(name, ())) for m in markets)
    assert full.columns == none.columns and len(full.take(1)) == 1
    assert len(none.take(2)) <= 1


def test_clusters_and_heads_find_plain_classes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=4) * 0.1 + np.eye(4)[i % 3] * 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    got = vectors.kmeans(df, "v", 3).groupBy("cluster").agg(F.countDistinct("label").alias("n")).collect()
    assert [r["n"] for r in got] == [1, 1, 1]
    assert measure.softmax_head(df, "label", "v", "id").where("label <> predicted").count() == 0
