"""Question packages and blocks: spatial joins of words, lines, tables and layout elements with page regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import contains, expand, intersects
from ..functions.text import is_chart_label
from .decisions import block_type, classify_text
from .spatial import PAGE, join_corners, join_meeting

WORD_MARGIN, TABLE_MARGIN, LAYOUT_MARGIN, IMAGE_MARGIN, LABEL_MARGIN = 8, 16, 6, 24, 140


def in_ranges(items: DataFrame, ranges: DataFrame, margin: int) -> DataFrame:
    """Items (with bbox) inside page regions (question_no, range), over the cells of the page's grid."""
    return join_corners(items, ranges.select(*PAGE, "question_no", "range"), "range", contains(F.col("range"), F.col("bbox"), margin), margin)


def outside_boxes(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items that no excluded box of their page (column box) meets."""
    return join_meeting(items, boxes.select(*PAGE, F.col("box").alias("_box")), "_box", intersects(F.col("bbox"), F.col("_box")), "left_anti")


def lines_without_words(lines: DataFrame, words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines in regions in which no word was found."""
    with_words = in_ranges(words, ranges, WORD_MARGIN).select("doc_id", "question_no").distinct()
    return in_ranges(lines, ranges, WORD_MARGIN).join(with_words, ["doc_id", "question_no"], "left_anti")


def layout_text(elements: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, question_no, text: contents of elements inside or across a region, in reading order."""
    meets = contains(F.col("range"), F.col("bbox"), LAYOUT_MARGIN) | intersects(F.col("range"), F.col("bbox"))
    met = join_meeting(elements.where(F.trim("content") != ""), ranges.select(*PAGE, "question_no", "range"), "range", meets, "inner", LAYOUT_MARGIN)
    texts = met.groupBy("doc_id", "question_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "order_index", F.trim("content").alias("t")))).alias("i"))
    return texts.select("doc_id", "question_no", F.array_join(F.transform("i", lambda x: x["t"]), "\n").alias("text"))


def merge_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Candidates of both, one for each page, text and box; those of `first` take precedence."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    k = F.row_number().over(Window.partitionBy(*PAGE, "text", "bbox").orderBy("_side", F.desc("score")))
    return both.withColumn("_k", k).where("_side = 0 or _k = 1").drop("_side", "_k")


def near_images(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Chart labels within LABEL_MARGIN of an image of their page (column box)."""
    near = intersects(expand(F.col("bbox"), LABEL_MARGIN), F.col("_box"))
    return join_meeting(labels.where(is_chart_label(F.col("text"))), images.select(*PAGE, F.col("box").alias("_box")), "_box", near, "left_semi", LABEL_MARGIN)


def number_blocks(blocks: DataFrame) -> DataFrame:
    """block_id q{question}_b{k}: text first, then tables, then images, each in order."""
    rank = F.when(F.col("type") == "table", 1).when(F.col("type") == "image", 2).otherwise(0)
    k = F.row_number().over(Window.partitionBy("doc_id", "question_no").orderBy(rank, "ord"))
    return blocks.withColumn("block_id", F.concat(F.lit("q"), "question_no", F.lit("_b"), k))


def should_refine(top_type: Column, confidence: Column, is_table: Column, image_score: Column) -> Column:
    """Blocks worth a second reading."""
    doubtful = (confidence < 0.9) | (top_type.isin("equation", "chem_equation") & (confidence < 0.98))
    return ~is_table & ~(image_score >= 0.9) & doubtful


def refine(blocks: DataFrame, second: DataFrame) -> DataFrame:
    """blocks with the text and confidence of a second reading where it has text; the first reading is kept beside."""
    read = second.select("doc_id", "block_id", F.col("text").alias("_t"), F.col("confidence").alias("_c"))
    joined = blocks.join(read, ["doc_id", "block_id"], "left")
    has = F.coalesce(F.trim("_t") != "", F.lit(False))
    pick = lambda a, b: F.when(has, F.col(a)).otherwise(F.col(b))
    return joined.select(
        *[c for c in blocks.columns if c not in ("text", "confidence")], pick("_t", "text").alias("text"), pick("_c", "confidence").alias("confidence"),
        F.when(has, F.col("text")).alias("coarse_text"), F.when(has, F.col("confidence")).alias("coarse_confidence"), F.when(has, "block_ocr").otherwise("page_ocr").alias("ocr_engine"),
    )


def type_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (text, around) with candidates and the decided type, confidence and review flag."""
    rows = blocks.withColumn("candidates", classify_text(F.col("text")))
    decided = rows.withColumn("_d", block_type(F.col("text"), F.col("candidates"), F.coalesce("around", F.lit(""))))
    return decided.select(*blocks.columns, "candidates", F.col("_d.type").alias("final_type"), F.col("_d.confidence").alias("final_confidence"), F.col("_d.needs_review").alias("needs_review"))


def sort_packages(packages: DataFrame) -> DataFrame:
    """packages (page_no, question_pages, question_no) with place: order of the page among question pages, then number."""
    at = F.array_position("question_pages", F.col("page_no"))
    rank = F.when(at > 0, at - 1).otherwise(10**6)
    return packages.withColumn("_at", rank).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "question_no"))).drop("_at")
