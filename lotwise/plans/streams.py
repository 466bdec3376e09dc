"""Queries of the streaming operators: each runs a stream over the events table to its end and gives the batch answer.

Windows that the watermark hasn't closed at the end of the stream aren't told yet, so the SQL leaves them out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.session import load
from lotwise.sources.sinks import folder
from lotwise.streaming import ingest

from .views import query, rounded


def _stream(spark, d):
    """The events table as a file stream."""
    path = f"{d}/[e]vents.parquet"  # a pattern: the file source takes a single file no other way
    return ingest.source(spark, path, load(spark, d, "events").schema)


def _plain(df, *stamps: str):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in stamps else F.col(c) for c in df.columns])


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"WITH w AS (SELECT date_trunc('hour', ts) AS p, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS high FROM events GROUP BY ALL) SELECT strftime(p, '%Y-%m-%d %H:%M:%S') AS period, event_type, n, total, high FROM w WHERE p + INTERVAL 1 HOUR <= {_CLOSED}")
def stm_tumbling_rollups(spark, d):
    out = ingest.run(ingest.tumbling(_stream(spark, d), "event_type", "ts", "value"), folder(spark, "out"))
    return rounded(_plain(out, "period"), total=2, high=2)


@query(f"WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS p, event_type, count(*) AS n FROM events, range(4) r(i) GROUP BY ALL) SELECT strftime(p, '%Y-%m-%d %H:%M:%S') AS period, event_type, n FROM w WHERE p + INTERVAL 4 HOURS <= {_CLOSED}")
def stm_sliding_velocity(spark, d):
    return _plain(ingest.run(ingest.sliding(_stream(spark, d), "event_type", "ts"), folder(spark, "out")), "period")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')")
def stm_bid_ingest(spark, d):
    bids = _stream(spark, d).where(F.col("event_type").isin("click", "purchase"))
    return ingest.run(ingest.dedup(bids, ["event_id"], "ts"), folder(spark, "out")).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'signup')")
def stm_watch_ingest(spark, d):
    watches = _stream(spark, d).where(F.col("event_type").isin("view", "signup"))
    return ingest.run(ingest.dedup(watches, ["event_id"], "ts"), folder(spark, "out")).select("event_id", "user_id", "event_type")


@query("SELECT v.user_id AS session, v.event_id AS id, p.event_id AS signal FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 1800 SECONDS WHERE v.event_type = 'view' AND p.event_type = 'purchase'")
def stm_session_followup(spark, d):
    s = _stream(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts", "event_type")
    return ingest.run(ingest.followups(s.where("event_type = 'view'").drop("event_type"), s.where("event_type = 'purchase'").drop("event_type"), 1800), folder(spark, "out"))


def _in_batches(spark, d, times: int, after: int):
    """The events table as a stream of so many batches in order of time; every tenth row comes again so many batches ``after`` its own, if there
    are as many: late and double rows."""
    e = load(spark, d, "events")
    ends = e.agg(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b")).first()
    width = (ends["b"] - ends["a"]) / times + 1  # with its fraction, as in the SQL
    own = e.withColumn("part", F.floor((F.unix_timestamp("ts") - ends["a"]) / width).cast("int"))
    every = own.unionByName(own.where(F.col("event_id") % 10 == 0).withColumn("part", F.col("part") + after))
    base = folder(spark, "batches")
    for i in range(times):
        every.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(base)
    return ingest.source(spark, base, e.schema, files_per_trigger=1)


def _batches_sql(times: int, after: int) -> str:
    part = f"CAST(floor((floor(epoch(ts)) - (SELECT floor(epoch(min(ts))) FROM events)) / ((SELECT floor(epoch(max(ts))) - floor(epoch(min(ts))) FROM events) // {times} + 1)) AS INTEGER)"
    return f"p AS (SELECT *, {part} AS own FROM events), b AS (SELECT *, own AS part, FALSE AS again FROM p UNION ALL SELECT *, own + {after}, TRUE FROM p WHERE event_id % 10 = 0 AND own + {after} < {times})"


@query(f"""WITH {_batches_sql(3, 1)}, v AS (SELECT user_id, max(part) + 1 AS version, count(*) AS events FROM b GROUP BY ALL), u AS (SELECT b.user_id, bool_or(event_type = 'purchase' AND value > 50) AS urgent FROM b JOIN v ON b.user_id = v.user_id AND b.part + 1 = v.version GROUP BY ALL),
    r AS (SELECT b.* FROM b JOIN v ON b.user_id = v.user_id AND b.part + 1 = v.version QUALIFY row_number() OVER (PARTITION BY b.user_id ORDER BY ts DESC) = 1) SELECT r.user_id, r.event_id, r.value, CAST(version AS BIGINT) AS version, events, urgent FROM r JOIN v ON r.user_id = v.user_id JOIN u ON r.user_id = u.user_id""")
def stm_snapshot_version(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "updated")
    urgent = ingest.is_extension(kind, F.col("value") > 50, F.col("ts"))
    table = ingest.versions(_in_batches(spark, d, 3, 1), "user_id", "ts", urgent)
    return table.read().select("user_id", "event_id", "value", "version", "events", "urgent")


@query("WITH n AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) SELECT c_custkey, coalesce(value, c_acctbal) AS c_acctbal FROM customer LEFT JOIN n ON c_custkey = user_id")
def stm_delta_refresh(spark, d):
    base = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    table = ingest.Table(spark, base.schema, ["c_custkey"])
    table.load(base)
    stream = _stream(spark, d).select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), "ts")
    ingest.run_batches(stream, table.delta(["c_acctbal"], ["ts"]))
    return table.read()


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY event_type, item ORDER BY ts DESC) = 1")
def stm_enrichment_refresh(spark, d):
    s = _stream(spark, d).where("event_type <> 'error'").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("item"), "event_id", "ts")
    table = ingest.Table(spark, s.schema, ["event_type", "item"])
    ingest.run_batches(s, table.upsert(["ts"]))
    return table.read().select("event_type", "item", "event_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stm_available_now(spark, d):
    rows = ingest.run(_stream(spark, d).select("event_type", "value"), folder(spark, "out"))
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), total=2)


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOURS THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS life FROM g),
    l AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n, sum(value) AS total FROM i GROUP BY user_id, life)
    SELECT user_id, epoch_us(a) // 1000 AS started, epoch_us(b) // 1000 AS ended, n, near(total) AS total FROM l WHERE b + INTERVAL 8 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stm_ttl(spark, d):
    """Users live for eight hours after each event; state of one that is gone expires by a timer."""
    with ingest.rocks_state(spark):
        return rounded(ingest.run(ingest.lives(_stream(spark, d).select("user_id", "ts", "value"), "user_id", "ts", "value", 8 * 3600), folder(spark, "out")))


@query(f"""WITH h AS (SELECT '1 hour' AS grain, date_trunc('hour', ts) AS p, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS high, count(DISTINCT user_id) AS who, p + INTERVAL 1 HOUR AS stop FROM events GROUP BY ALL),
    c AS (SELECT '1 day' AS grain, date_trunc('day', ts) AS p, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS high, count(DISTINCT user_id) AS who, p + INTERVAL 1 DAY AS stop FROM events GROUP BY ALL)
    SELECT grain, strftime(p, '%Y-%m-%d %H:%M:%S') AS period, event_type, n, total, high, who FROM (SELECT * FROM h UNION ALL SELECT * FROM c) WHERE stop <= {_CLOSED}""")
def stm_chained_rollups(spark, d):
    with ingest.rocks_state(spark):
        out = ingest.run(ingest.chained_rollups(_stream(spark, d), "event_type", "ts", "value", "user_id"), folder(spark, "out"))
    return rounded(_plain(out, "period"), total=2, high=2)


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 10 DAYS")
def stm_ttl_rows(spark, d):
    from datetime import datetime

    from lotwise.operators.etl import ttl

    return ttl(ingest.run(_stream(spark, d).select("event_id", "ts"), folder(spark, "out")), "ts", datetime(2024, 1, 30), 10).select("event_id")


@query(f"""WITH {_batches_sql(4, 2)}, m AS (SELECT own, max(ts) AS top FROM p GROUP BY ALL), ok AS (SELECT date_trunc('day', b.ts) AS p, count(*) AS n FROM b JOIN m USING (own) WHERE NOT again OR date_trunc('day', b.ts) + INTERVAL 1 DAY > m.top - INTERVAL 1 HOUR GROUP BY ALL)
    SELECT strftime(p, '%Y-%m-%d %H:%M:%S') AS period, n FROM ok WHERE p + INTERVAL 1 DAY <= {_CLOSED}""")
def stm_late_data(spark, d):
    """Every tenth row comes again two batches after its own: too late for all days but the last one that its batch had."""
    one = _in_batches(spark, d, 4, 2).withColumn("all", F.lit(1))
    return _plain(ingest.run(ingest.tumbling(one, "all", "ts", "value", "1 day"), folder(spark, "out")).select("period", "n"), "period")


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS h, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS i FROM events),
    r AS (SELECT a.user_id, a.t, a.i, avg(b.h) AS share FROM e a JOIN e b ON a.user_id = b.user_id AND b.t >= a.t - 36000 AND b.i <= a.i GROUP BY ALL), f AS (SELECT *, share < 0.5 AS x, lag(share < 0.5, 1, FALSE) OVER (PARTITION BY user_id ORDER BY i) AS was FROM r)
    SELECT user_id, t AS ts_s, CASE WHEN x THEN 'start' ELSE 'end' END AS edge, near(share) AS hit_rate FROM f WHERE x <> was""")
def stm_cache_storm(spark, d):
    s = _stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("hit"))
    return rounded(ingest.run(ingest.storm_states(s, "user_id", "ts", "hit", 36000), folder(spark, "out")))
