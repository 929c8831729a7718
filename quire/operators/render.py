"""Render items, questions and the checklist as row streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCERTAIN = "[불확실]"  # fixed value


def first_text_items(items: DataFrame) -> DataFrame:
    """Each question's first text item; every question but the document's first breaks the column."""
    k = F.row_number().over(Window.partitionBy("doc_id", "question_no").orderBy("ord"))
    first = items.where("type = 'text'").withColumn("_k", k).where("_k = 1").drop("_k")
    return first.withColumn("column_break", F.col("question_no") > F.min("question_no").over(Window.partitionBy("doc_id")))


def uncertain(confidence: Column, needs_review: Column) -> Column:
    return (confidence < 0.78) | needs_review


def mark_triaged(items: DataFrame, issues: DataFrame) -> DataFrame:
    """items with the marker before the first text item of each question that has an issue worth one."""
    flagged = issues.where(F.col("severity").isin("high", "medium") & F.col("question_no").isNotNull()).select("doc_id", F.col("question_no").cast("int").alias("question_no")).distinct().withColumn("_hit", F.lit(True))
    k = F.row_number().over(Window.partitionBy("doc_id", "question_no", "type").orderBy("ord"))
    rows = items.withColumn("_k", k).join(flagged, ["doc_id", "question_no"], "left")
    here = F.col("_hit") & (F.col("type") == "text") & (F.col("_k") == 1) & ~F.startswith(F.col("content"), F.lit(UNCERTAIN))
    return rows.withColumn("content", F.when(here, F.concat(F.lit(UNCERTAIN + " "), "content")).otherwise(F.col("content"))).drop("_k", "_hit")


def checklist_rows(issues: DataFrame, file_name: str) -> DataFrame:
    rows = issues.where("question_no is not null")
    return rows.select("doc_id", "ord", F.lit(file_name).alias("file_name"), "question_no", F.col("question_no").alias("page"), "category", "severity", "message", "asset")


def checklist_text(rows: DataFrame) -> DataFrame:
    """One text per document: a head and five lines an entry."""
    entry = F.format_string("[Q%d][%s][%s]\n%s\npage: %d\nasset: %s\n", "question_no", "category", "severity", "message", "page", "asset")
    texts = rows.groupBy("doc_id", "file_name").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))).alias("i"))
    body = F.array_join(F.transform("i", lambda x: x["e"]), "\n")
    return texts.select("doc_id", F.concat(F.rtrim(F.concat(F.lit("파일명: "), "file_name", F.lit("\n\n"), F.regexp_replace(body, r"\n+$", ""))), F.lit("\n")).alias("checklist"))


def text_width(script: Column, inline: bool) -> Column:
    """Width of an equation in document units, by its length."""
    return F.least(F.lit(9000), F.greatest(F.lit(1000), 380 * F.length(script))) if inline else F.least(F.lit(20500), F.greatest(F.lit(1800), 420 * F.length(script)))


def table_geometry(stats: DataFrame) -> DataFrame:
    return stats.select("doc_id", "table_id", F.floor(F.lit(25230) / F.greatest(F.lit(1), F.col("n_cols"))).cast("int").alias("column_width"), F.greatest(F.lit(282), F.col("n_rows") * 800).cast("int").alias("height"))


def picture_geometry(width_px: Column, height_px: Column) -> Column:
    """struct<width,height,original_width,original_height>"""
    scaled = (F.lit(24247) * height_px / F.greatest(F.lit(1), width_px)).cast("int")
    return F.struct(F.lit(24247).alias("width"), F.greatest(F.lit(1000), scaled).alias("height"), (width_px * 75).cast("int").alias("original_width"), (height_px * 75).cast("int").alias("original_height"))


def media_entries(items: DataFrame) -> DataFrame:
    """Image items numbered through the document, with their place in the package."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("question_no", "ord"))
    rows = items.where("type = 'image'").withColumn("_n", n)
    return rows.select("doc_id", "question_no", "ord", F.concat(F.lit("image"), "_n").alias("media_id"), F.concat(F.lit("BinData/image"), "_n", F.lit(".png")).alias("href"), F.lit("image/png").alias("media_type"))


def section_rows(items: DataFrame, notes: DataFrame) -> DataFrame:
    """The document body as rows: doc_id, para_seq, kind, question_no, text, column_break, page_break.

    Items of all questions in order; then, on a new page, the notes that have text.
    """
    k = F.row_number().over(Window.partitionBy("doc_id", "question_no").orderBy("ord"))
    opening = (k == 1) & (F.col("question_no") > F.min("question_no").over(Window.partitionBy("doc_id")))
    body = items.select("doc_id", F.lit(0).alias("part"), "question_no", F.col("ord").cast("long").alias("ord"), F.col("type").alias("kind"), F.coalesce(F.nullif("target", F.lit("")), "content").alias("text"), opening.alias("column_break"))
    tail = notes.where("exists").select("doc_id", F.lit(1).alias("part"), F.col("question_no").cast("int").alias("question_no"), F.lit(0).cast("long").alias("ord"), F.lit("note").alias("kind"), F.concat("question_no", F.lit(". "), "raw_text").alias("text"), F.lit(False).alias("column_break"))
    rows = body.unionByName(tail)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "question_no", "ord"))
    first_note = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("question_no", "ord")) == 1
    return rows.select("doc_id", seq.alias("para_seq"), "kind", "question_no", "text", "column_break", ((F.col("part") == 1) & first_note).alias("page_break"))


def preview_text(rows: DataFrame) -> DataFrame:
    texts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_seq", "text"))).alias("i"))
    return texts.select("doc_id", F.array_join(F.transform("i", lambda x: x["text"]), "\r\n").alias("preview"))


# Measures of a preview (fixed values): columns of a line, of which wide characters take two; room of a picture, a line, and around a question.
LINE_COLUMNS, WIDE_FROM, PICTURE_ROOM, LINE_ROOM, AROUND = 60, 0x2E7F, 180, 14, 48


def wrapped_lines(text: Column) -> Column:
    """How many lines a text takes when it breaks greedily at LINE_COLUMNS: a fold over its characters."""
    columns = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c == "\n", -1).when(F.ascii(c) > WIDE_FROM, 2).otherwise(1))
    zero = F.struct(F.lit(1).alias("lines"), F.lit(0).alias("used"))

    def step(a: Column, n: Column) -> Column:
        breaks = (n < 0) | (a["used"] + n > LINE_COLUMNS)
        return F.struct((a["lines"] + breaks.cast("int")).alias("lines"), F.when(n < 0, 0).when(breaks, n).otherwise(a["used"] + n).alias("used"))

    return F.aggregate(columns, zero, step)["lines"]


def block_room(kind: Column, text: Column) -> Column:
    """Height of a block in a preview."""
    return F.when(kind == "image", PICTURE_ROOM).otherwise(LINE_ROOM * wrapped_lines(F.coalesce(text, F.lit(""))))
