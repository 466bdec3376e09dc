"""Sources of the lake: scans with their typed filters, and staged lookups."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators import etl
from lotwise.operators.sizes import small


def seed_scan(log: DataFrame, ts: str, name: str, as_of, days: int, types: tuple[int, ...] = (), newest: int | None = None, tie: list[str] = (), active_only: bool = False) -> DataFrame:
    """The log's rows of the last days, of some types, with a name; with ``newest`` only so many, the latest first."""
    rows = log.where((F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.trim(name) != ""))
    if types:
        rows = rows.where(F.col("type_id").isin(*types))
    if active_only:
        rows = rows.where(F.col(ts) > F.lit(as_of))
    return rows.orderBy(F.desc(ts), *tie).limit(newest) if newest else rows


def windowed(df: DataFrame, ts: str, since, until) -> DataFrame:
    """[since, until): reaches the scan as a pushed filter."""
    return df.where((F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(until)))


def watch_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("view", 1, "passive"), ("signup", 9, "bidder")], "event_type string, watch_type int, label string")


def distinct_seekers(log: DataFrame, name: str, who: str, ts: str, as_of, days: int) -> DataFrame:
    recent = log.where((F.col(ts) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= F.lit(as_of)))
    return recent.groupBy(name).agg(F.countDistinct(who).alias("searchers"))


def signals(events: DataFrame, newest: int) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    return events.orderBy(F.desc("ts"), "event_id").limit(newest).select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), kind.alias("signal"))


def last_bids(bids: DataFrame, winning: DataFrame, base: DataFrame) -> DataFrame:
    return bids.join(winning.distinct(), ["user_id", "item"]).join(base, "item").groupBy("item").agg(F.max("ts").alias("last_bid"))


def latest_in_scope(rows: DataFrame, scope: DataFrame, key: str, ts: str) -> DataFrame:
    return etl.latest_per_key(rows.join(scope, key, "left_semi"), [key], [ts])


def listing_document(listings: DataFrame, as_of) -> DataFrame:
    """The wide listing row; unpriced and ended ones aren't shown."""
    left = F.unix_timestamp("ends_at") - F.unix_timestamp(F.lit(as_of))
    doc = listings.withColumn("domain", F.concat_ws(".", "sld", "tld")).withColumn("has_hyphen", F.contains("sld", F.lit("-"))).withColumn("has_number", F.col("sld").rlike("[0-9]"))
    doc = doc.withColumn("quality", F.least(F.greatest(F.col("govalue") / 2000, F.lit(0.0)), F.lit(1.0))).withColumn("gem", (F.col("traffic") > 0) & (F.col("govalue") < 1000))
    doc = doc.withColumn("left_s", left).withColumn("left_h", F.floor(left / 3600)).withColumn("left_d", F.floor(left / 86400))
    return doc.where((F.col("price") > 0) & (F.col("left_s") > 0))


def pushed_down(df: DataFrame, slots: dict) -> DataFrame:
    """Hard filters of the kinds in, gte and lte, before any limit; values that aren't plain are an error."""
    out = []
    for kind, pairs in slots.items():
        for col, value in pairs.items():
            c = F.col(col)
            out.append(c.isin(*value) if kind == "in" else c >= value if kind == "gte" else c <= value)
    return df.where(reduce(lambda a, b: a & b, out, F.lit(True)))


#: Names points of the index: a UUID of version 5 from this namespace and the document's key.
POINT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lotwise:index")


def point_id(key: Column) -> Column:
    """UUID of version 5: SHA-1 of the namespace's bytes and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE.hex)), F.concat(F.lit("doc:"), key.cast("string")).cast("binary")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def encoded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One point for each key: its id, the columns but the text, and three encodings of the text that follow from it alone. ``dense``: hashed words of length one,
    ``grams``: of characters (maps of bucket to weight); ``terms``: bucket and frequency of each different word, with ``dl``, the words in
    all, from which weights are made when the index is asked. Texts without tokens have empty ones. Texts are moved only where keys repeat or parts are uneven."""
    from lotwise.operators import text as t

    if t.repeated(docs, key):
        docs = etl.latest_per_key(t.dealt(docs, key, text), [key], [c for c in docs.columns if c not in (key, text)] or [text])
    else:
        docs = t.spread(docs, key)
    tokens = docs.withColumn("__text", F.concat(F.concat_ws(" ", t.tokenize(F.col(text))), F.lit(" "))).drop(text)
    added = T.StructType.fromDDL("terms array<struct<bucket:int,tf:bigint>>, dl bigint, dense map<int,double>, grams map<int,double>")
    schema = T.StructType([f for f in tokens.schema if f.name != "__text"] + list(added))
    out = tokens.mapInArrow(t.encodings(t._arrow_schema(schema), (WORD_BUCKETS, 256, 1 << 14)), schema)
    return out.select(point_id(F.col(key)).alias("point_id"), "*")


#: Buckets of words in an index; ids in several loads that are broadcast.
WORD_BUCKETS, AGAIN = 1 << 16, 500_000


class Index:
    """An encoded table that loads are appended to. Each load has a number and a folder of its own, so a load that comes again replaces itself and none rewrites
    another; a reader takes the point of the greatest number for each id. What a load holds doesn't depend on the others: corpus
    figures are summed from the points' lengths when weights are asked for, or given."""

    def __init__(self, spark: SparkSession, base: str | None = None):
        from lotwise.sources.sinks import folder

        self.spark, self.base = spark, base or folder(spark, "index")

    def load(self, docs: DataFrame, key: str, text: str, number: int) -> None:
        encoded(docs, key, text).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/load={int(number)}")

    def points(self) -> DataFrame:
        """The latest point of each id. Only ids and loads are grouped; points move only where too many ids to be broadcast are in several loads."""
        rows = self.spark.read.parquet(self.base).where("point_id IS NOT NULL")
        again = rows.groupBy("point_id").agg(F.max("load").alias("__newest"), F.min("load").alias("__oldest")).where("__newest > __oldest").select("point_id", "__newest")
        return rows.join(small(again, AGAIN), "point_id", "left").where("__newest IS NULL OR load = __newest").drop("load", "__newest")

    def figures(self) -> DataFrame:
        """One row: n, the points that have words, and their mean number. Only ids and lengths are read."""
        rows = self.spark.read.parquet(self.base).groupBy("point_id").agg(F.max_by("dl", "load").alias("dl")).where("dl > 0")
        return rows.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))

    def weighed(self, mean: float | None = None, kept: list[str | Column] = ("*",)) -> DataFrame:
        """The ``kept`` columns of the points and ``words``, bucket to weight in the order of buckets; by the corpus as it is now or by a ``mean`` that is given. They are made where the point is."""
        from lotwise.operators import text as t

        usual = mean if mean is not None else self.figures().first()["mean"] or 1.0
        points = self.points().select(*kept, F.col("terms").alias("__terms"), F.col("dl").alias("__dl"))
        schema = T.StructType([f for f in points.schema if f.name not in ("__terms", "__dl")] + [T.StructField("words", T.MapType(T.IntegerType(), T.DoubleType()))])
        return points.mapInArrow(t.weighed_terms(t._arrow_schema(schema), usual), schema)

    def words(self, key: str, mean: float | None = None) -> DataFrame:
        """doc_id, bucket, weight of all points, by the corpus as it is now or by a ``mean`` that is given."""
        return self.weighed(mean, [F.col(key).alias("doc_id")]).select("doc_id", F.explode("words").alias("bucket", "weight"))
