"""Analytics templates: time-bucketed aggregates over any table, by column names.

Each takes a DataFrame and columns, groups before it windows (so a window sees one row per entity and period), and takes
``as_of`` where the clock would matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import quantiles
from lotwise.functions.times import bucket, months

from .asof import within


def _period(time: str, grain: str) -> Column:
    return bucket(F.col(time), grain).alias("period")


def _share(part: Column, whole: Column) -> Column:
    """NULL where the whole is 0 or NULL."""
    return F.when(whole != 0, part / whole)


def growth_rate(df: DataFrame, entity: str, metric: str, time: str, grain: str = "month") -> DataFrame:
    """Sum per entity and period, its change from the entity's period before, in percent where that was above 0."""
    sums = df.groupBy(F.col(entity).alias("entity"), _period(time, grain)).agg(F.sum(metric).alias("total"))
    before = F.lag("total", 1, 0).over(Window.partitionBy("entity").orderBy("period"))
    return sums.withColumn("previous", before.cast("double")).withColumn("growth_pct", F.when(F.col("previous") > 0, 100 * (F.col("total") - F.col("previous")) / F.col("previous")))


def anomalies(df: DataFrame, entity: str, metric: str, time: str, grain: str = "day", periods: int = 7, threshold: float = 2.0) -> DataFrame:
    """Periods whose sum lies more than ``threshold`` deviations from the mean of the last periods and itself."""
    sums = df.groupBy(F.col(entity).alias("entity"), _period(time, grain)).agg(F.sum(metric).alias("total"))
    near = Window.partitionBy("entity").orderBy("period").rowsBetween(-periods, 0)
    scored = sums.withColumn("mean", F.avg("total").over(near)).withColumn("deviation", F.stddev_pop("total").over(near))
    scored = scored.withColumn("z", F.when(F.col("deviation") > 1e-9, (F.col("total") - F.col("mean")) / F.col("deviation")))
    return scored.where(F.abs("z") > threshold)


def category_trend(df: DataFrame, dims: list[str], metric: str, distinct: str, time: str, grain: str = "month") -> DataFrame:
    m = F.col(metric)
    return df.groupBy(*dims, _period(time, grain)).agg(F.count("*").alias("n"), F.sum(m).alias("total"), F.avg(m).alias("mean"), F.max(m).alias("high"), F.min(m).alias("low"), F.countDistinct(distinct).alias("n_distinct"))


def historical_comparison(df: DataFrame, group: str, metric: str, time: str, current: tuple, prior: tuple) -> DataFrame:
    """Sums of two windows (closed on both sides) side by side; a missing side counts as 0 in the deltas."""
    side = lambda w, name: df.where(F.col(time).between(F.lit(w[0]), F.lit(w[1]))).groupBy(F.col(group).alias("key")).agg(F.sum(metric).alias(name))
    joined = side(current, "current_total").join(side(prior, "prior_total"), "key", "full_outer")
    now, then = F.coalesce("current_total", F.lit(0.0)), F.coalesce("prior_total", F.lit(0.0))
    return joined.withColumn("delta", now - then).withColumn("delta_pct", F.when(then != 0, 100 * (now - then) / then))


def time_window(df: DataFrame, dims: list[str], metrics: list[str], time: str, grain: str = "month") -> DataFrame:
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max))]
    return df.groupBy(*dims, _period(time, grain)).agg(*aggs)


def user_engagement(df: DataFrame, user: str, kind: str, time: str, grain: str = "day", rolling: int = 7) -> DataFrame:
    """Users, events, events per user and kinds per period; the mean of the counts of the last periods.

    The rolling window has one row per period, whatever the input's size.
    """
    per = df.groupBy(_period(time, grain)).agg(F.countDistinct(user).alias("users"), F.count("*").alias("events"), F.countDistinct(kind).alias("kinds"))
    near = Window.orderBy("period").rowsBetween(-(rolling - 1), 0)
    return per.withColumn("per_user", _share(F.col("events"), F.col("users"))).withColumn("rolling_events", F.avg("events").over(near))


def realtime_trending(df: DataFrame, entity: str, metric: str, time: str, as_of, minutes: int) -> DataFrame:
    recent = df.where((F.col(time) >= F.lit(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col(time) <= F.lit(as_of)))
    out = recent.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("n"), F.sum(metric).alias("total"), F.max(metric).alias("high"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    return out.withColumn("span_s", F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen"))


def stage(age: Column, idle: Column, new: int, active: int, dormant: int) -> Column:
    """new / active / dormant / at_risk (up to twice the dormant limit) / churned."""
    return F.when(age.isNull() | idle.isNull(), "unknown").when(age <= new, "new").when(idle <= active, "active").when(idle <= dormant, "dormant").when(idle <= 2 * dormant, "at_risk").otherwise("churned")


def lifecycle(df: DataFrame, entity: str, time: str, as_of, new: int = 30, active: int = 30, dormant: int = 90) -> DataFrame:
    seen = df.groupBy(F.col(entity).alias("entity")).agg(F.to_date(F.min(time)).alias("first_day"), F.to_date(F.max(time)).alias("last_day"), F.count("*").alias("n"))
    day = F.to_date(F.lit(as_of))
    seen = seen.withColumn("age_days", F.datediff(day, "first_day")).withColumn("idle_days", F.datediff(day, "last_day"))
    return seen.withColumn("stage", stage(F.col("age_days"), F.col("idle_days"), new, active, dormant))


def comparative_cohort(df: DataFrame, metric: str, time: str, a: Column, b: Column, grain: str = "month") -> DataFrame:
    """Two cohorts per period in one pass; a period with neither is left out."""
    per = df.where(a | b).groupBy(_period(time, grain)).agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.avg(F.when(a, F.col(metric))).alias("mean_a"), F.avg(F.when(b, F.col(metric))).alias("mean_b"))
    return per.withColumn("delta", F.coalesce("mean_a", F.lit(0.0)) - F.coalesce("mean_b", F.lit(0.0)))


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 over all rows; no span gives 1, NULL gives 0. The extremes are one row, joined by broadcast."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(ends), F.lit(True))
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        out = out.withColumn(f"{c}_norm", F.when(F.col(c).isNull(), 0.0).when(span == 0, 1.0).otherwise((F.col(c) - F.col(f"__lo_{c}")) / span))
    return out.drop(*ends.columns)


def ranking_score(df: DataFrame, entity: str, weights: dict[str, float], time: str, grain: str = "month") -> DataFrame:
    sums = df.groupBy(F.col(entity).alias("entity"), _period(time, grain)).agg(*[F.sum(c).cast("double").alias(c) for c in weights])
    scaled = minmax(sums, list(weights))
    return scaled.withColumn("score", sum(w * F.col(f"{c}_norm") for c, w in weights.items()))


def forecast(df: DataFrame, entity: str, metric: str, time: str, grain: str = "month", last: int = 12, horizon: int = 3) -> DataFrame:
    """A line through the last periods of each entity with three or more; time is counted in periods from the first."""
    means = df.groupBy(F.col(entity).alias("entity"), _period(time, grain)).agg(F.avg(metric).alias("value"))
    back = Window.partitionBy("entity").orderBy(F.desc("period"))
    kept = means.withColumn("k", F.row_number().over(back)).where(F.col("k") <= last)
    kept = kept.withColumn("x", (-F.col("k")).cast("double"))
    y, x = F.col("value"), F.col("x")
    fit = kept.groupBy("entity").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("corr")).where("n >= 3")
    return fit.withColumn("forecast", F.col("intercept") + F.col("slope") * (horizon - 1)).drop("intercept")


def keyword_trend(df: DataFrame, label: str, price: str, time: str, grain: str = "month", least: int = 2, min_chars: int = 3) -> DataFrame:
    words = df.select(label, price, time, F.explode(F.split(F.lower(F.col(label)), "-")).alias("keyword")).where(F.length("keyword") >= min_chars)
    return words.groupBy("keyword", _period(time, grain)).agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels"), F.avg(price).alias("mean_price")).where(F.col("n") >= least)


def sell_through(df: DataFrame, dims: list, time: str, sold: str, price: str, grain: str | None = "month") -> DataFrame:
    keys = [*dims, *([_period(time, grain)] if grain else [])]
    hit = F.col(sold) == 1
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(hit).alias("sold"), F.avg(F.when(hit, F.col(price))).alias("mean_sale"), F.sum(F.when(hit, F.col(price))).alias("revenue"))
    return out.withColumn("rate", _share(F.col("sold"), F.col("total")))


def steps(value: Column, limits: list[float], names: list[str]) -> Column:
    """The name of the first limit that the value is below; the last name beyond; 'unknown' for NULL."""
    out = F.when(value.isNull(), "unknown")
    for limit, name in zip(limits, names, strict=False):
        out = out.when(value < limit, name)
    return out.otherwise(names[-1])


def seo_bucket(df: DataFrame, authority: str, traffic: str, time: str, sold: str, price: str, grain: str = "month") -> DataFrame:
    a = steps(F.col(authority), [10, 25, 40], ["0-9", "10-24", "25-39", "40+"]).alias("authority_bucket")
    t = steps(F.col(traffic), [100, 400, 700], ["low", "some", "much", "most"]).alias("traffic_bucket")
    return sell_through(df, [a, t], time, sold, price, grain)


def bid_distribution(df: DataFrame, bids: str, time: str, sold: str, price: str, grain: str = "month") -> DataFrame:
    b = steps(F.col(bids), [1, 5, 15, 30], ["0", "1-4", "5-14", "15-29", "30+"]).alias("bid_bucket")
    return df.groupBy(b, _period(time, grain)).agg(F.count("*").alias("total"), F.count_if(F.col(sold) == 1).alias("sold"), F.avg(bids).alias("mean_bids"), F.avg(price).alias("mean_price"), F.avg((F.col(sold) == 1).cast("double")).alias("win_rate"))


def market_summary(df: DataFrame, sold: str, price: str, bids: str, tld: str) -> DataFrame:
    """One row; on no rows counts are 0 and the rest NULL."""
    hit = F.col(sold) == 1
    out = df.agg(F.count("*").alias("total"), F.count_if(hit).alias("sold"), F.avg(F.when(hit, F.col(price))).alias("mean_sale"), F.sum(F.when(hit, F.col(price))).alias("revenue"), F.avg(bids).alias("mean_bids"), F.countDistinct(tld).alias("tlds"))
    median = quantiles.grouped(df.where(hit), [], price, {"median_sale": 0.5}, "linear").select("median_sale")
    return out.join(F.broadcast(median), F.lit(True), "left")


def rollup(df: DataFrame, dims: list[str], metric: str, time: str, grain: str = "month") -> DataFrame:
    """Subtotals have NULL keys and a grouping id above 0."""
    return df.withColumn("period", bucket(F.col(time), grain)).rollup(*dims, "period").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(metric).alias("total"), F.avg(metric).alias("mean"), F.max(metric).alias("high"))


QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def quantile_distribution(df: DataFrame, group: str, metric: str, time: str, grain: str = "month") -> DataFrame:
    return quantiles.grouped(df.withColumn("period", bucket(F.col(time), grain)), [group, "period"], metric, QUANTILES)


def funnel_levels(df: DataFrame, keys: list[str], kind: str, time: str, steps_in_order: list[str], window_s: float) -> DataFrame:
    """``keys`` and ``level``: the deepest step that a group's events reach in order within ``window_s`` of a first step; 0 if they never start.

    Step by step, each event gets the latest start from which it is reached: a running maximum over the group's earlier events, all steps in one
    order. So a group of any size streams through its task. Events of an instant are ordered as the steps are and count once.
    """
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    place = F.array_position(F.array(*[F.lit(s) for s in steps_in_order]), F.col(kind))
    rows = df.where(F.col(kind).isin(*steps_in_order)).select(*keys, at.alias("__t"), place.alias("__i"), F.col(kind).alias("__k")).distinct()
    earlier = Window.partitionBy(*keys).orderBy("__t", "__i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("__k") == steps_in_order[0], F.col("__t"))
    rows = rows.withColumn("__s1", start)
    for i, step in enumerate(steps_in_order[1:], 2):
        # NULLs are left out by the maximum; a start that is too long ago stays the latest one there is, so it fails for all
        before = F.max(f"__s{i - 1}").over(earlier)
        rows = rows.withColumn(f"__s{i}", F.when((F.col("__k") == step) & (F.col("__t") - before <= window_s), before))
    reached = [F.max(F.when(F.col(f"__s{i}").isNotNull(), i).otherwise(0)) for i in range(1, len(steps_in_order) + 1)]
    return rows.groupBy(*keys).agg(F.greatest(*reached, F.lit(0)).alias("level"))


def window_funnel(df: DataFrame, entity: str, kind: str, time: str, steps_in_order: list[str], window_s: float, grain: str = "day") -> DataFrame:
    """How many (entity, period) reach each level or a deeper one."""
    levels = funnel_levels(df.withColumn("period", bucket(F.col(time), grain)), [entity, "period"], kind, time, steps_in_order, window_s)
    reached = levels.select("period", F.explode(F.sequence(F.lit(1), F.greatest("level", F.lit(1)))).alias("level"), F.col("level").alias("own")).where(F.col("level") <= F.col("own"))
    return reached.groupBy("period", "level").agg(F.count("*").alias("entities"))


def topk_values(df: DataFrame, value: str, time: str, k: int = 3, grain: str = "month") -> DataFrame:
    """The most frequent values of each period; ties to the smaller value."""
    counts = df.groupBy(_period(time, grain), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("period").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def moving_average(df: DataFrame, metric: str, time: str, size: int = 3, grain: str = "month", by: list[str] | None = None) -> DataFrame:
    keys = by or []
    per = df.groupBy(*keys, _period(time, grain)).agg(F.avg(metric).alias("mean"))
    near = (Window.partitionBy(*keys) if keys else Window).orderBy("period").rowsBetween(-(size - 1), 0)
    return per.withColumn("moving", F.avg("mean").over(near))


def hold_time(df: DataFrame, group: str, days: str, price: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(days).alias("mean_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"), F.sum(price).alias("revenue"))


def counter_offers(df: DataFrame, is_counter: Column, amount: str, time: str, grain: str = "day") -> DataFrame:
    a = F.col(amount)
    out = df.groupBy(_period(time, grain)).agg(F.count("*").alias("bids"), F.count_if(is_counter).alias("counters"), F.avg(F.when(is_counter, a)).alias("mean_counter"), F.avg(F.when(~is_counter, a)).alias("mean_plain"))
    return out.withColumn("rate", _share(F.col("counters"), F.col("bids"))).withColumn("price_delta", F.col("mean_counter") - F.col("mean_plain"))


def price_realization(df: DataFrame, group: str, sale: str, listed: str, time: str, grain: str = "month") -> DataFrame:
    priced = df.where(F.col(listed) > 0).withColumn("ratio", F.col(sale) / F.col(listed)).withColumn("period", bucket(F.col(time), grain))
    mean = priced.groupBy(group, "period").agg(F.avg("ratio").alias("mean_ratio"))
    qs = quantiles.grouped(priced.withColumn("ratio", F.round("ratio", 6)), [group, "period"], "ratio", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return mean.join(qs, [group, "period"])


def retention_cohorts(df: DataFrame, buyer: str, time: str, horizon: int = 6) -> DataFrame:
    """Buyers by month of first purchase, and how many of them buy again k months later."""
    active = df.select(F.col(buyer).alias("buyer"), F.trunc(F.col(time), "month").alias("month")).distinct()
    first = active.groupBy("buyer").agg(F.min("month").alias("cohort"))
    joined = active.join(first, "buyer").withColumn("k", months(F.col("month")) - months(F.col("cohort"))).where(F.col("k").between(0, horizon))
    kept = joined.groupBy("cohort", "k").agg(F.count("*").alias("retained"))
    sizes = first.groupBy("cohort").agg(F.count("*").alias("size"))
    return kept.join(sizes, "cohort").withColumn("rate", F.col("retained") / F.col("size"))


def timing_heatmap(df: DataFrame, time: str, sold: Column) -> DataFrame:
    """Monday is 1."""
    out = df.groupBy(F.hour(time).alias("hour"), (F.weekday(F.col(time)) + 1).alias("weekday")).agg(F.count("*").alias("n"), F.count_if(sold).alias("sold"))
    return out.withColumn("rate", F.col("sold") / F.col("n"))


def name_structure(df: DataFrame, label: str, sold: str, price: str, least: int = 2) -> DataFrame:
    name = F.col(label)
    size = steps(F.length(name), [6, 9, 12], ["1-5", "6-8", "9-11", "12+"]).alias("length_bucket")
    kind = F.when(name.rlike("^[a-zA-Z-]+$"), "letters").when(name.rlike("^[0-9-]+$"), "digits").otherwise("mixed").alias("char_class")
    hyphens = F.regexp_count(name, F.lit("-")).cast("int").alias("hyphens")
    keyed = df.select(size, kind, hyphens, sold, price)
    out = keyed.groupBy("length_bucket", "char_class", "hyphens").agg(F.count("*").alias("n"), F.avg(F.col(sold).cast("double")).alias("rate"), F.max(price).alias("max_price"))
    mid = quantiles.grouped(keyed, ["length_bucket", "char_class", "hyphens"], price, {"p50": 0.5}).drop("n")
    return out.where(F.col("n") >= least).join(mid, ["length_bucket", "char_class", "hyphens"])


def cross_tld_spread(df: DataFrame, label: str, tld: str, price: str, reference: str) -> DataFrame:
    means = df.groupBy(F.col(label).alias("label"), F.col(tld).alias("tld")).agg(F.avg(price).alias("mean"), F.count("*").alias("n"))
    ref = means.where(F.col("tld") == reference).select("label", F.col("mean").alias("reference_mean"))
    return means.where(F.col("tld") != reference).join(ref, "label").withColumn("ratio", _share(F.col("mean"), F.col("reference_mean")))


def attribution(signals: DataFrame, sales: DataFrame, hours: float) -> DataFrame:
    """Sales of a key within ``hours`` after a signal of it (from its own time on). Each signal looks at the next sale and each sale at the
    latest signal, so a busy key makes no pairs.

    signals: key, request_id, ts; sales: key, sale_id, amount, ts. Each sale counts once per key.
    """
    asked, sold = within(signals.select("key", "request_id", "ts"), sales.select("key", "sale_id", "amount", "ts"), hours * 3600)
    requests = asked.groupBy("key").agg(F.countDistinct("request_id").alias("requests"))
    once = sold.select("key", "sale_id", "amount").distinct().groupBy("key").agg(F.count("*").alias("sales"), F.sum("amount").alias("revenue"))
    all_asked = signals.groupBy("key").agg(F.countDistinct("request_id").alias("asked"))
    zero = F.lit(0).cast("long")
    out = all_asked.join(requests, "key", "left").join(once, "key", "left").withColumns({c: F.coalesce(c, zero) for c in ("requests", "sales")})
    return out.select("key", "asked", "requests", "sales", F.coalesce("revenue", F.lit(0.0)).alias("revenue"), (F.col("requests") / F.col("asked")).alias("rate"))


def concentration(df: DataFrame, holder: str, metric: str) -> DataFrame:
    """Market shares in percent and their squares, whose sum is the index; the total is one broadcast row."""
    sums = df.groupBy(F.col(holder).alias("holder")).agg(F.sum(metric).alias("total"))
    whole = sums.agg(F.sum("total").alias("whole"))
    share = 100 * F.col("total") / F.col("whole")
    return sums.join(F.broadcast(whole), F.lit(True)).where("whole <> 0").select("holder", "total", share.alias("share_pct"), (share * share).alias("share_squared"))


def comparable_price(df: DataFrame, tld: str, label: str, price: str) -> DataFrame:
    size = steps(F.length(label), [6, 9, 12], ["1-5", "6-8", "9-11", "12+"])
    return quantiles.grouped(df.withColumn("length_bucket", size), [tld, "length_bucket"], price, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def investor_roi(df: DataFrame, category: str, paid: str, got: str, time: str, grain: str = "month") -> DataFrame:
    profit = F.col(got) - F.col(paid)
    return df.groupBy(F.col(category).alias("category"), _period(time, grain)).agg(F.count("*").alias("n"), F.avg(profit).alias("mean_profit"), F.avg(F.when(F.col(paid) > 0, 100 * profit / F.col(paid))).alias("roi_pct"), F.max(profit).alias("max_profit"))


def market_snapshot(df: DataFrame, tld: str, price: str, bids: str, top: int = 20) -> DataFrame:
    out = df.groupBy(F.col(tld).alias("tld")).agg(F.count("*").alias("total"), F.count_if(F.col(bids) > 0).alias("with_bids"), F.max(price).alias("max_price"), F.sum(bids).alias("bids"))
    return out.orderBy(F.desc("total"), "tld").limit(top)


def snapshot_history(df: DataFrame, entity: str, price: str, day: str) -> DataFrame:
    p, rows = F.col(price), df.withColumn("day", F.to_date(day))
    out = rows.groupBy("day").agg(F.countDistinct(entity).alias("entities"), F.avg(p).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"), F.sum(p).alias("total"))
    median = quantiles.grouped(rows, ["day"], price, {"median": 0.5}, "linear").select(F.col("day").alias("__day"), "median")
    return out.join(median, out["day"].eqNullSafe(median["__day"]), "left").drop("__day")


def live_keys(daily: DataFrame, key: str, day: str, bids: str, as_of, days: int = 14) -> DataFrame:
    recent = daily.where((F.col(day) > F.date_sub(F.to_date(F.lit(as_of)), days)) & (F.col(day) <= F.to_date(F.lit(as_of))))
    return recent.groupBy(key).agg(F.sum(bids).alias("bids")).where("bids > 0")


def percentile_ceilings(df: DataFrame, price: str, remaining: str, prior: tuple[float, float], least: int = 30) -> DataFrame:
    """'cheap': the 25th percentile of price, 'expiring': the 20th of the remaining seconds, by nearest rank; the prior under ``least`` values."""
    out = None
    for name, col, q, default in (("cheap", price, 0.25, prior[0]), ("expiring", remaining, 0.2, prior[1])):
        one = quantiles.grouped(df.where(F.col(col) > 0).select(F.col(col).cast("double").alias("v")), [], "v", {"ceiling": q}, "nearest_rank")
        row = one.agg(F.max("n").alias("n"), F.max("ceiling").alias("ceiling"))
        row = row.select(F.lit(name).alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.coalesce("n", F.lit(0)) >= least, F.col("ceiling")).otherwise(F.lit(float(default))).alias("ceiling"))
        out = row if out is None else out.unionByName(row)
    return out


def market_baselines(df: DataFrame, tld: str, price: str) -> DataFrame:
    """Median price of each TLD and of all ('_global'), by nearest rank."""
    priced = df.where(F.col(price) > 0).select(F.col(tld).alias("tld"), F.col(price).alias("v"))
    return quantiles.grouped(priced, ["tld"], "v", {"baseline": 0.5}, "nearest_rank", whole="_global")


def complement_scores(df: DataFrame, tld: str, price: str) -> DataFrame:
    per = df.groupBy(F.col(tld).alias("tld")).agg(F.count("*").cast("double").alias("n"), F.avg(price).alias("mean"))
    return minmax(per, ["n", "mean"]).select("tld", "n", "mean", ((F.col("n_norm") + F.col("mean_norm")) / 2).alias("activity"))


def user_vector(df: DataFrame, user: str, values: str, time: str, top: int = 3, least: int = 2) -> DataFrame:
    """Per user: hashed id, the top values seen ``least`` times or more, distinct values, days active and last day."""
    counts = df.groupBy(F.col(user).alias("user"), F.col(values).alias("v")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("user").orderBy(F.desc("n"), "v")
    best = counts.where(F.col("n") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    tops = best.groupBy("user").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"].cast("string")), ",").alias("top"))
    base = df.groupBy(F.col(user).alias("user")).agg(F.count("*").alias("n"), F.countDistinct(values).alias("kinds"), F.countDistinct(F.to_date(time)).alias("days"), F.to_date(F.max(time)).alias("last_day"))
    return base.join(tops, "user", "left").select(F.substring(F.sha2(F.col("user").cast("string"), 256), 1, 12).alias("user_hash"), "n", "kinds", "days", "last_day", F.coalesce("top", F.lit("")).alias("top"))


def signal_counts(df: DataFrame, kind: str, time: str) -> DataFrame:
    return df.groupBy(F.col(kind).alias("kind"), F.to_date(time).alias("day")).agg(F.count("*").alias("n"))


def repeats(df: DataFrame, user: str, key: str, time: str, days: int) -> DataFrame:
    """How many earlier rows of the same user and key lie within ``days`` before each, summed per user."""
    trailing = Window.partitionBy(user, key).orderBy(F.unix_timestamp(time)).rangeBetween(-days * 86400, -1)
    return df.withColumn("r", F.count("*").over(trailing)).groupBy(F.col(user).alias("user")).agg(F.sum("r").alias("repeats"))


def velocity(hourly: DataFrame, key: str, time: str, amount: str, as_of, hours: int) -> DataFrame:
    """Events of the last ``hours`` against the ``hours`` before, from hourly sums."""
    span = F.expr(f"INTERVAL {int(hours)} HOURS")
    at = F.lit(as_of)
    recent = (F.col(time) > at - span) & (F.col(time) <= at)
    prior = (F.col(time) > at - span - span) & (F.col(time) <= at - span)
    side = lambda w, n: hourly.where(w).groupBy(F.col(key).alias("key")).agg(F.sum(amount).alias(n))
    joined = side(recent, "recent").join(side(prior, "prior"), "key", "left").withColumn("prior", F.coalesce("prior", F.lit(0).cast("long")))
    return joined.withColumn("delta", F.col("recent") - F.col("prior")).withColumn("ratio", _share(F.col("recent"), F.col("prior")))


def watch_bid_conversion(watches: DataFrame, bids: DataFrame, item: str, watcher: str, bidder: str) -> DataFrame:
    w = watches.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("watches"), F.countDistinct(watcher).alias("watchers"))
    b = bids.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("bids"), F.countDistinct(bidder).alias("bidders"))
    zero = F.lit(0).cast("long")
    return w.join(b, "item", "left").select("item", "watches", "watchers", F.coalesce("bids", zero).alias("bids"), F.coalesce("bidders", zero).alias("bidders"), (F.coalesce("bidders", zero) / F.col("watchers")).alias("conversion"))
