"""Line deduplication across documents. DataFrame functions only.

Lines are keyed (trimmed, A-Z lowered) and hashed in their places; each document gives each hash once to the count;
lines whose hashes enough documents hold are exploded with their positions and dropped; what stays is put together
again by position. Texts do not travel with their lines: a document meets the list of its dropped positions. Every step is linear in the
lines of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, ascii_lower, materialise, null_safe, text_of
from .sharding import let


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def line_hash(line: Column) -> Column:
    """128 bits of a line's key, as text: array_distinct() has a hash table for strings, not for bytes."""
    return F.substring(F.base64(F.unhex(F.md5(line_key(line).cast("binary")))), 1, 22)


#: A dropped line is hot from this share of all dropped places; so at most 1 / HOT_SHARE lines are
#: broadcast, and no other line has more rows in one task.
HOT_SHARE = 0.0001


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """_key of each row and the hashes of its lines in order, null for lines with fewer than min_chars code points in their keys."""
    text = text_of(docs, text_col)
    hashes = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(line_key(x)) >= min_chars, line_hash(x)))
    return docs.select(row_key(docs[id_col], text).alias("_key"), hashes.alias("hashes"))


def row_key(id_: Column, text: Column) -> Column:
    return F.struct(null_safe(id_).alias("id"), F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(text, F.lit(2)).alias("b"))


def repeated_line_hashes(hashed: DataFrame, min_docs: int = 10) -> DataFrame:
    """(hash, n_docs) of the lines that at least min_docs rows hold.

    A line counts once in a row however often it stands there. Partial counts leave each input
    partition, so a line that every document holds moves as one row a partition.
    """
    once = hashed.select(F.explode(F.array_distinct("hashes")).alias("hash")).where("hash is not null")
    return once.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text added (columns of these names are replaced).

    Every row is a document of its own for counting, rows alike included. Null or empty text is
    one empty line, and empty keys are never dropped while min_chars is 1 or more. An empty
    table gives no rows. Rows are matched with their dropped lines by id and text hash, so
    null and repeated ids do no harm.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    hashed = materialise(hashed_lines(docs, id_col, text_col, min_chars), "line-hashes")
    repeated = materialise(repeated_line_hashes(hashed, min_docs), "repeated-lines")
    places = repeated.agg(F.sum("n_docs")).first()[0] or 0
    is_hot = F.col("n_docs") >= F.lit(HOT_SHARE * places)
    hot = F.broadcast(repeated.where(is_hot).select("hash"))  # at most 1 / HOT_SHARE rows
    rows = hashed.select("_key", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    common = rows.join(hot, "hash")
    rest = rows.join(hot, "hash", "left_anti").join(repeated.where(~is_hot).select("hash"), "hash")
    # Rows alike in id and text share a key, so a position may come more than once.
    found = common.unionByName(rest).groupBy("_key").agg(F.collect_set("pos").alias("_drop"))
    out = docs.withColumn("_key", row_key(docs[id_col], text_of(docs, text_col))).join(found, "_key", "left")
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    # let() makes the lines once, not once a position.
    kept = let(F.split(text_of(out, text_col), "\n", -1), lambda lines: F.struct(F.size(lines).cast("long").alias("n"), F.when(F.col("_drop").isNull(), lines).otherwise(F.transform(places(lines), lambda i: F.get(lines, i))).alias("kept")))
    out = out.withColumn("_made", kept).withColumns({"_lines": F.col("_made.n"), "_kept": F.col("_made.kept")})
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("_lines").alias("n_lines"),
        (F.col("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept_text"),
    )
