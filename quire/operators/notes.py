"""Answer notes: spans of blocks per question, and the text inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .scan import largest_group, scan_groups

#: Blocks of a document that are scanned as one band, as a power of two.
BAND_BITS = 14
ANCHOR = r"^\\s*\\(?([0-9]+)\\)?[.)]?\\s*(.*)$"


def note_anchors(blocks: DataFrame, sized: int | None = None) -> DataFrame:
    """Blocks that begin with a number: doc_id, question_no, start_ord, end_ord (the block before the next anchor of any number)."""
    number = F.expr(f"try_cast(nullif(regexp_extract(text, '{ANCHOR}', 1), '') as bigint)")
    numbered = blocks.select("doc_id", "ord", number.alias("question_no"))
    # From the end backwards: the anchor last seen is the one that follows.
    following = {"_next": ("last", F.when(F.col("question_no").isNotNull(), F.col("ord")))}
    heads = scan_groups(numbered, ["doc_id"], -band(), [([-F.col("ord")], {}, following, {"_last": ("max", F.col("ord"))}, {})], sized).where("question_no is not null")
    return heads.select("doc_id", "question_no", F.col("ord").alias("start_ord"), F.coalesce(F.col("_next") - 1, F.col("_last")).alias("end_ord"))


def band():
    return F.shiftright(F.col("ord").cast("long"), BAND_BITS)


def note_spans(blocks: DataFrame, expected: DataFrame, sized: int | None = None) -> DataFrame:
    """The first anchor of each expected number. `sized` is the number of blocks of the largest document, where it is known."""
    mine = note_anchors(blocks, sized).join(expected, ["doc_id", "question_no"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "question_no").orderBy("start_ord"))
    return mine.withColumn("_k", first).where("_k = 1").drop("_k")


def note_summary(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, missing, extra (sorted lists), confidence, needs_review, for every document with expected numbers."""
    seen = note_spans(blocks, expected).select("doc_id", "question_no")
    missing = expected.join(seen, ["doc_id", "question_no"], "left_anti").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("question_no").cast("long"))).alias("missing"))
    extra = note_anchors(blocks).join(expected, ["doc_id", "question_no"], "left_anti").groupBy("doc_id").agg(F.sort_array(F.collect_set("question_no")).alias("extra"))
    empty = F.array().cast("array<bigint>")
    out = expected.select("doc_id").distinct().join(missing, "doc_id", "left").join(extra, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("missing", empty).alias("missing"), F.coalesce("extra", empty).alias("extra"))
    return out.withColumns({"confidence": F.when(F.size("missing") == 0, 0.91).otherwise(0.76), "needs_review": (F.size("missing") > 0) | (F.size("extra") > 0)})


def span_blocks(blocks: DataFrame, spans: DataFrame, sized: int | None = None) -> DataFrame:
    """Blocks inside spans that do not overlap and begin at a block: each block looks back to the last beginning.

    A span meets its first block by an equi-join and is carried on by a window, so a document costs its blocks, not blocks times spans.
    """
    span = F.struct("question_no", "start_ord", "end_ord")
    heads = blocks.join(spans.select("doc_id", F.col("start_ord").alias("ord"), span.alias("_span")), ["doc_id", "ord"], "left")
    inside = scan_groups(heads, ["doc_id"], band(), [(["ord"], {"_now": ("last", F.col("_span"))}, {}, {}, {})], blocks if sized is None else sized).drop("_span").withColumnRenamed("_now", "_span").where(F.col("ord") <= F.col("_span.end_ord"))
    return inside.select(*[F.col(c) for c in blocks.columns], "_span.question_no", "_span.start_ord", "_span.end_ord")


def build_notes(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, question_no, exists, raw_text, missing_note for each expected number.

    A header of the question gives what follows its number; other lines count while the last header is the question's.
    """
    sized = largest_group(blocks, ["doc_id"])  # once: no scan below has a larger group
    spans = stage(note_spans(blocks, expected, sized), "spans")
    inside = span_blocks(blocks, spans, sized)
    own = F.expr(r"try_cast(nullif(regexp_extract(text, '^\\s*([0-9]+)[.)]', 1), '') as bigint)")
    steps = [(["ord"], {"_now": ("last", F.col("_own"))}, {}, {}, {})]
    rows = scan_groups(inside.withColumn("_own", own), ["doc_id", "question_no"], band(), steps, sized).where("_now = question_no")
    said = F.when(F.col("_own").isNull(), F.col("text")).otherwise(F.trim(F.regexp_extract("text", r"^\s*\d+[.)]\s*(.*)", 1)))
    texts = rows.withColumn("_t", said).where("_t <> ''").groupBy("doc_id", "question_no").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("_t").alias("t")))).alias("_items"))
    out = expected.withColumn("question_no", F.col("question_no").cast("long")).join(texts, ["doc_id", "question_no"], "left").join(spans.select("doc_id", "question_no", "start_ord"), ["doc_id", "question_no"], "left")
    return out.select("doc_id", "question_no", F.col("_items").isNotNull().alias("exists"), F.coalesce(F.array_join(F.transform("_items", lambda i: i["t"]), "\n"), F.lit("")).alias("raw_text"), F.col("start_ord").isNull().alias("missing_note"))
