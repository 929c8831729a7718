"""Exact deduplication by skew-safe combining. DataFrame functions only.

1. Local: the map side of the first aggregation keeps one row per digest, salt and whole
   text in each input partition, so a group of copies leaves a partition as one row.
2. Salted: rows meet by (digest, salt, text); a group that all partitions hold is spread
   over `salts` tasks.
3. Global: salt winners meet by (digest, text).

Whole texts are grouping keys at every stage, so equal digests never merge unequal texts.
The mapping back to rows carries digests only, except for digests that stage 3 found to have
several texts; those rows are matched by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, text_of

#: A group is hot from this share of all rows; so there are at most 1 / HOT_SHARE hot groups,
#: which bounds the table that is broadcast.
HOT_SHARE = 0.001


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = 16) -> DataFrame:
    """One row per distinct text: digest, text, keep_id (largest id; null if all are null), group_size."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("_id"), digest(text).alias("digest"), text.alias("text"))
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = 16) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256 added; columns of docs with these names are replaced.

    Null texts count as empty. Of equal texts the row with the largest id stays; a null id is
    the least. Rows that share both text and that id are all marked kept: ids are taken to be keys,
    and remove_exact_duplicates() leaves one of them.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*(c for c in added if c != id_col and c != text_col))
    groups = duplicate_groups(docs, id_col, text_col, digest, salts)
    clash = F.count(F.lit(1)).over(_by_digest())
    total = docs.count()
    sized = groups.select("digest", F.when(F.col("group_size") >= F.lit(max(2, HOT_SHARE * total)), True).otherwise(False).alias("hot"), "keep_id", "group_size", F.xxhash64("text", F.lit(7)).alias("text_hash"))
    table = materialise(sized.withColumn("texts", clash), "exact-groups")

    key, own = fresh(docs.columns, "_digest"), fresh(docs.columns, "_text")
    rows = docs.withColumn(key, digest(text_of(docs, text_col)))
    one = table.where("texts = 1").select(F.col("digest").alias(key), "keep_id", "group_size", "hot")
    hot = F.broadcast(one.where("hot").drop("hot"))  # at most 1 / HOT_SHARE rows
    # Digests with several texts: none for SHA-256; for a weaker digest they are matched by the texts themselves.
    several = table.where("texts > 1")
    parts = [rows.join(hot, key), rows.join(hot, key, "left_anti").join(one.where("not hot").drop("hot"), key)]
    if not several.isEmpty():
        texts = groups.join(several.select("digest").distinct(), "digest", "left_semi").select(F.col("digest").alias(key), F.col("text").alias(own), "keep_id", "group_size")
        parts.append(rows.withColumn(own, text_of(rows, text_col)).join(texts, [key, own]).drop(own))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    sha = F.col(key) if digest is sha256_hex else sha256_hex(text_of(out, text_col))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).withColumn("text_sha256", sha).drop(key)


def _by_digest():
    from pyspark.sql import Window

    return Window.partitionBy("digest")


def remove_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = 16) -> DataFrame:
    """One whole row of docs for each distinct text: the one with the largest id. Same columns as docs.

    Rows that share text and id are told apart by their other columns; rows alike in all are one.
    """
    names = docs.columns
    others = [c for c in names if c not in (id_col, text_col)]
    # The text travels once, as a key; the row keeps whether it was null.
    row = F.struct(docs[id_col].alias("id"), docs[text_col].isNotNull().alias("set"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)])
    text = text_of(docs, text_col)
    rows = docs.select(digest(text).alias("_digest"), text.alias("_text"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"), row.alias("_row"))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_row").alias("_row"))
    best = salted.groupBy("_digest", "_text").agg(F.max("_row").alias("_row"))
    back = {id_col: F.col("_row.id"), text_col: F.when(F.col("_row.set"), F.col("_text").cast(docs.schema[text_col].dataType))} | {c: F.col(f"_row.c{i}") for i, c in enumerate(others)}
    return best.select(*[back[c].alias(c) for c in names])
