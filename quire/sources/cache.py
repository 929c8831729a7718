"""A cache of service responses in a shared folder, by content address.

Each run asks only for digests that no committed run has answered, each once, and appends its answers under a folder of
its own; a commit record, written when all of them are stored, makes them visible. A run that dies leaves nothing
visible, a rerun asks for nothing, and where two runs answered the same digest one answer counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ocr import call_service

ANSWERS = "digest string, raw string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, path: str) -> DataFrame:
    """digest, raw of all committed runs, one row a digest; an empty table where there is no cache yet."""
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], ANSWERS)
    commits = spark.read.schema("run string").option("recursiveFileLookup", "true").parquet(f"{path}/commits")
    answers = spark.read.schema(f"{ANSWERS}, run string").parquet(f"{path}/answers")
    return answers.join(commits.distinct(), "run").groupBy("digest").agg(F.min_by("raw", "run").alias("raw"))


def ask(requests: DataFrame, path: str, send: Callable[[bytes], str], attempts: int = 2) -> DataFrame:
    """requests (digest, content) with raw: from the cache at `path`, after asking `send` for what it lacks.

    Requests alike in digest are asked once. Null digests are not asked and get no response. An empty table asks for nothing.
    """
    spark, run = requests.sparkSession, uuid.uuid4().hex
    missing = requests.where("digest is not null").join(cached(spark, path).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))
    pages = missing.select(F.col("digest").alias("doc_id"), F.lit(1).alias("page_no"), "content")
    answers = call_service(pages, send, attempts).select(F.col("doc_id").alias("digest"), "raw")
    answers.write.parquet(f"{path}/answers/run={run}")  # not visible without the record below
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.parquet(f"{path}/commits/{run}")
    return requests.join(cached(spark, path), "digest", "left")
