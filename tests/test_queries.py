"""Every query against its SQL on the smallest tables, where that is quick; names and columns agree."""

import duckdb
import pytest

import __spark_entry__ as entry
from lotwise import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [n for i, n in enumerate(sorted(plans.SQL)) if i % 3 == 0 and not n.startswith("stm_")]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    return round(float(v), 6) if isinstance(v, float) else v


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["entity", "period", "total", "previous", "growth_pct"]
    assert set(plans.SQL) <= set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, duck, sf, name):
    df = plans.QUERIES[name](spark, sf)
    said = duck.execute(plans.SQL[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((repr([cell(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in said.fetchall()))
    got = sorted(repr([cell(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == want
