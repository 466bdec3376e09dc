"""Time buckets and windows of time. Weeks start on Sunday; ``monday`` is the other week."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "week", "monday", "month")


def bucket(ts: Column, grain: str) -> Column:
    """The start of the bucket: a timestamp for hours, else a date."""
    day = F.to_date(ts)
    if grain == "hour":
        return F.date_trunc("hour", ts)
    if grain == "day":
        return day
    if grain == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if grain == "monday":
        return F.to_date(F.date_trunc("week", day))
    if grain == "month":
        return F.trunc(day, "month")
    raise ValueError(f"grain {grain}: one of {GRAINS}")


def recent(ts: Column, as_of, seconds: float) -> Column:
    """Whether ``ts`` lies in (as_of - seconds, as_of]: by the instant, not by its whole second."""
    end = F.lit(as_of)
    return (ts > end - F.make_dt_interval(secs=F.lit(float(seconds)))) & (ts <= end)


def months(day: Column) -> Column:
    """A month index: differences count month boundaries."""
    return F.year(day) * 12 + F.month(day)


def as_of(df, ts: str):
    """The latest time in a column as a one-row relation's literal; NULL when there is none."""
    return df.agg(F.max(ts).alias("t")).first()["t"]
