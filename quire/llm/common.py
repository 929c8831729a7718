"""Shared plumbing: staged tables, default columns, batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import forget_powers

#: `[\x20\x09-\x0D]`: what counts as blank wherever a contract says so (fixed value).
BLANK = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset, and only on a local master, a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="quire-"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


#: While a staged table is written: shuffle files go when it is done, and Arrow batches stay small.
_WHILE_STAGING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def materialise(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and return it as read from there.

    Lineage ends here: a lost executor costs a re-read, and no value that depended on
    task order can change afterwards. `by` names a column of few values, each of which has its own files.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = {k: spark.conf.get(k) for k in _WHILE_STAGING}
    for k, v in _WHILE_STAGING.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete what materialise() wrote, or a part of it, once nothing lazily reads it any more."""
    path, sc = df._quire_path, df.sparkSession.sparkContext  # type: ignore[attr-defined]
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fresh(names: list[str], base: str) -> str:
    """A column name like `base` that is not among `names`, whatever their case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


#: Bits of the filter that seen_ids() broadcasts, at most 8 MB.
FILTER_BITS = 26


def seen_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id may be in `ids` (one column): all of those and, the more ids there are, some others.

    A bitmap of hashed ids of fixed size is broadcast, so what a join will drop need not be shuffled.
    """
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << FILTER_BITS))
    page, place = F.shiftright(spot, 15), spot.bitwiseAND((1 << 15) - 1)
    table = ids.toDF(id_col).select(page.alias("_page"), place.alias("_place")).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    names = rows.columns
    out = rows.withColumns({"_page": page, "_place": place}).join(F.broadcast(table), "_page")  # at most 2**(FILTER_BITS - 15) pages of 4 kB
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_place", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.col("_place").bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return out.where(hit).select(*names)


#: A key is hot from this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with a table of one row a key that says in `count` how many rows each key has.

    Hot keys meet by a broadcast, which HOT_SHARE bounds, so no task gets all rows of one.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= F.lit(max(2, HOT_SHARE * total))
    few = F.broadcast(table.where(hot).drop(count))  # at most 1 / HOT_SHARE rows
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(table.where(~hot).drop(count), key))


def null_safe(c: Column) -> Column:
    """A string key that tells null from every string."""
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` holds about most_bytes at once (one long row may hold more)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        i = batch.schema.get_field_index(column)
        mean = max(1, batch.column(i).nbytes // n)
        step = int(max(1, min(most_rows, most_bytes // mean)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def frugal(f: Callable) -> Callable:
    """A batch function that hands memory back when its partition ends: workers stay for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            forget_powers()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return run


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
