"""Helpers shared by the training-data operators: scratch tables, row keys, batched Arrow maps."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session on one machine may do without: it gets a folder of its own."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lotwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def row_key(*cols: Column) -> Column:
    """128 bits that tell a row from others; rows that repeat one another share it. Nulls count as values."""
    cells = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("second"), *cells).alias("b"))


#: Groups that ``join_by_weight`` broadcasts at most.
HEAVY = 100_000


def join_by_weight(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` (unique in ``keys``) where groups may be of any size; ``weight`` says how many of the ``total`` rows each has.

    Groups with over one ``HEAVY``-th of all rows (64 at least) are broadcast: there can be no more than ``HEAVY`` of them. The
    rest is joined by a shuffle, in which no key has more rows than that.
    """
    bound = max(64, total // HEAVY)
    heavy = F.broadcast(groups.where(F.col(weight) > bound))
    light = groups.where(F.col(weight) <= bound)
    return rows.join(heavy, keys).unionByName(rows.join(heavy, keys, "left_anti").join(light, keys, "left"))


def map_arrow(df: DataFrame, fn, schema: str | T.StructType, size: int = 4_000_000) -> DataFrame:
    """``mapInArrow`` over record batches of about ``size`` bytes; ``fn(batch)`` gives a dict of columns."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.mapInArrow(_Batches(fn, schema, size), schema)


class _Batches:
    def __init__(self, fn, schema: T.StructType, size: int):
        self.fn, self.schema, self.size = fn, schema, size

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for batch in batches:
            # long texts: a few megabytes at a time, so that a task's memory doesn't follow the rows of a batch
            step = max(1, min(batch.num_rows, int(batch.num_rows * self.size / max(1, batch.nbytes))))
            for i in range(0, batch.num_rows, step):
                out = self.fn(batch.slice(i, step))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=True) for f in schema], schema=schema)
