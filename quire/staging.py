"""Tables written once and read again: where lineage ends and what several steps read is worked out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def work_dir(spark: SparkSession, name: str = "document") -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir); a temporary one only on a local master without it."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quire-"))
        shared = _OWN[0]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(path: str) -> Callable[[DataFrame, str], DataFrame]:
    """A keeper of tables: each is written under `path` and read again, so that lineage ends there."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    return keep


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own and read again: for rows that several branches of a plan start from, so that none makes them anew."""
    return staged(work_dir(df.sparkSession, name))(df, "rows")
