"""Sinks: tables, JSON rings and artifacts, and a JSON stream captured to Parquet.

Without a path they write below the folder that the session names in spark.checkpoint.dir. Only a session on one machine may do without
it: it gets a temporary one.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark, name: str) -> str:
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None, partition_by: list[str] = (), mode: str = "overwrite") -> DataFrame:
    """Written as Parquet and read back."""
    path = path or folder(df.sparkSession, name)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_ring(held: DataFrame, new: DataFrame, ts: str, newest: int, schema: str, path: str | None = None) -> DataFrame:
    """The newest rows of both, as JSON lines. ``held`` may be what ``path`` holds now: the rows are settled before it is overwritten."""
    path = path or folder(held.sparkSession, "ring")
    rows = held.unionByName(new)
    kept = rows.orderBy(F.desc(ts), *[F.col(c) for c in rows.columns if c != ts]).limit(newest)
    stored(kept, "ring").write.mode("overwrite").json(path)
    return held.sparkSession.read.schema(schema).json(path)


def json_artifact(rows: DataFrame, schema: T.StructType, path: str | None = None) -> DataFrame:
    """Rows as JSON lines with a table of their count beside them, read back together."""
    spark, path = rows.sparkSession, path or folder(rows.sparkSession, "artifact")
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.agg(F.count("*").alias("total")).write.mode("overwrite").json(f"{path}/header")
    header = spark.read.schema("total bigint").json(f"{path}/header")
    return spark.read.schema(schema).json(f"{path}/rows").join(F.broadcast(header), F.lit(True))


def json_stream_to_parquet(df: DataFrame) -> DataFrame:
    """JSON objects captured by a file stream into Parquet, once through."""
    spark, base = df.sparkSession, folder(df.sparkSession, "capture")
    df.write.json(f"{base}/in")
    stream = spark.readStream.schema(df.schema).json(f"{base}/in")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
