"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join; tables between rounds lie in the shared folder, and only a count and a
checksum reach the driver. A hub is pre-aggregated by the grouped minimum, and adaptive execution splits its join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root): each node of an edge with the smallest node that it reaches.

    Edges may repeat, have either direction and be loops; rows with a null are left out. Nodes of no edge aren't returned.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    last = _mark(now)
    while last[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.where(a != b).distinct())
        if (mark := _mark(now)) == last:
            break
        last = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(b.alias("node"), b.alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further ``edges`` (a, b): only the components that these join are looked at again."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    known = written(edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")))
    over = components(known.select(F.col("x").alias("a"), F.col("y").alias("b")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("root")), F.struct(F.col("b").alias("node"), F.col("y").alias("root"))))
    both = roots.unionByName(known.select(ends.alias("e")).select("e.*")).distinct()
    over = over.select(F.col("node").alias("root"), F.col("root").alias("__root"))
    return written(both.join(over, "root", "left").select("node", F.coalesce("__root", "root").alias("root")))
