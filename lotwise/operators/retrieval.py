"""Batch retrieval helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relax_ladder(queries: DataFrame, docs: DataFrame, want: str, have: str, widest: int, steps: list[Column], least: int) -> DataFrame:
    """query_id, step_no, found: the first step of ever weaker predicates that leaves ``least`` documents or more.

    All steps are weighed in one pass over (query, document) pairs whose numbers lie within ``widest``; these meet by an equi-join
    on number ranges of that width, each query in the three ranges about its own.
    """
    q = queries.withColumn("__r", F.explode(F.array(*[F.floor(F.col(want) / widest) + i for i in (-1, 0, 1)])))
    d = docs.withColumn("__r", F.floor(F.col(have) / widest))
    pairs = q.join(d, "__r").where(F.abs(F.col(have) - F.col(want)) <= widest)
    first = F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(steps)])
    counts = pairs.groupBy("query_id").agg(*[F.count_if(first <= i).alias(f"n{i}") for i in range(len(steps))])
    reached = [F.when(F.col(f"n{i}") >= least, F.struct(F.lit(i).alias("step_no"), F.col(f"n{i}").alias("found"))) for i in range(len(steps))]
    return counts.select("query_id", reduce(lambda a, b: F.coalesce(a, b), reached).alias("s")).where("s IS NOT NULL").select("query_id", "s.step_no", "s.found")


def hybrid(legs: dict[str, DataFrame] | DataFrame, top: int, prefetch: int = 150, fusion: str = "rrf", weights: dict[str, float] | None = None, rerank: tuple[DataFrame, DataFrame] | None = None, pool: int = 100, least: float | None = None, keep: DataFrame | None = None, oversample: int = 4) -> DataFrame:
    """query_id, item, score, rank from several legs (query_id, item, score), which the caller has drawn from the filtered items; or all in one table, named by ``source``.

    The best ``prefetch`` of each leg are fused by reciprocal ranks or by scaled scores (``dbsf``). With ``rerank`` (vectors of
    queries and of documents) the first ``pool`` of the fusion are scored by their inner products alone; items that share no bucket go. Scores under ``least`` go, then items that aren't in
    ``keep``; for these the legs and the pool are drawn ``oversample`` times as deep. Ties by item. With ``rerank``, vectors of documents and ``keep`` may be functions of the pool's items (column item), so that
    those of others needn't be made.
    """
    from lotwise.sources.sinks import stored

    from .ranking import dbsf, rrf
    from .text import narrow_dot

    deeper = oversample if keep is not None else 1
    first = lambda df, n, *by: df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "item"))).where(F.col("__r") <= n).drop("__r")
    lists = legs if isinstance(legs, DataFrame) else reduce(DataFrame.unionByName, [df.select("query_id", F.lit(name).alias("source"), "item", "score") for name, df in legs.items()])
    lists = first(lists, prefetch * deeper, "query_id", "source").withColumn("score", F.round("score", 9))
    fused = rrf(lists, weights, top=1 << 30).select("query_id", "item", "score") if fusion == "rrf" else dbsf(lists)
    if rerank is not None:
        head = stored(first(fused, max(pool, top) * deeper, "query_id").select("query_id", "item"), "pool")
        items = head.select("item").distinct()
        of = lambda x: x(items) if callable(x) else x
        fused, keep = narrow_dot(head, rerank[0], of(rerank[1])), of(keep)
    if least is not None:
        fused = fused.where(F.round("score", 9) >= least)
    if keep is not None:
        fused = fused.join(keep.select("item").distinct(), "item", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "item", "score", "rank")


def structured(items: DataFrame, filters: dict, score: str, item: str, top: int, **how) -> DataFrame:
    """The ``top`` items that pass the listing predicate, by score; ties by item."""
    from lotwise.functions.filters import build_predicate

    return items.where(build_predicate(filters, **how)).orderBy(F.desc(score), item).limit(top)
