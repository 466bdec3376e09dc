"""What may be broadcast: tables whose size has been looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that is broadcast, and of a model that every row meets.
DIMENSION, MODEL = 200_000, 10_000


def small(df: DataFrame, rows: int = DIMENSION) -> DataFrame:
    """``df`` to be broadcast if it has so few rows; else as it is, and an equi-join with it shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def model(df: DataFrame, rows: int = MODEL) -> DataFrame:
    """``df`` to be broadcast to rows that each meet all of it; refused if it is larger, since such a join has no other way."""
    if (n := df.limit(rows + 1).count()) > rows:
        raise ValueError(f"a model of over {n - 1} rows")
    return F.broadcast(df)
