"""The corpus pipeline: quality classifier, line dedup, near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last give the columns of documents, with n_chars brought up to date where the text has changed.

In every stage: a null text is treated like an empty one and stays null; a null doc_id keeps its row, which no copy and no label names;
rows that repeat a doc_id are kept one by one, up to near_copies, which keeps one of them; other columns, whatever their
names, go through as they are; no rows in, none out. Ties go to the smallest doc_id, so the same rows give the same rows out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import scratch_dir
from lotwise.llm.lines import drop_recurring_lines
from lotwise.llm.packing import pack
from lotwise.llm.pii import pseudonymise
from lotwise.llm.quality import keep_good
from lotwise.llm.queries import PII_KEY, tokenizer_path
from lotwise.llm.simhash import drop_near_copies


def _renewed(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars counts the code points of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below one half; without labels to learn from it drops none. Empty texts are scored too."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that recur across documents, but for the first document that holds them. A document of which no line is left stays, empty."""
    return _renewed(drop_recurring_lines(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id. Empty texts are copies of one another. Every pair
    of texts that share a block is compared, in large groups and long texts too."""
    return drop_near_copies(docs, exact=True)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates; one identity has one surrogate in all documents."""
    return _renewed(pseudonymise(docs, PII_KEY), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into windows; an empty text is its closing id."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("pii", pii), ("packing", packing)]

#: No SQL: the classifier is fitted and the tokenizer is a library's. tests/llm/test_pipeline.py has a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/lotwise-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
