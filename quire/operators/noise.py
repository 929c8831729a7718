"""Headers and footers that repeat over a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_in, canonicalize

FOOTER_KEYWORDS = ("저작권", "다음 면", "세종과학고등학교", "- 끝")  # fixed values
FOOTER_FROM, HEADER_TO, BOTTOM_FROM, SLACK = 0.8, 0.18, 0.92, 6


def noise_buckets(lines: DataFrame) -> DataFrame:
    """Lines in the footer or header region, or with a footer keyword: doc_id, page_no, ord, region, canonical, text, bbox."""
    keyword = any_in(F.col("text"), FOOTER_KEYWORDS)
    foot = (F.col("bbox.y0") >= (F.col("height") * F.lit(FOOTER_FROM)).cast("int")) | keyword
    head = F.col("bbox.y1") <= (F.col("height") * F.lit(HEADER_TO)).cast("int")
    region = F.when(foot, "footer").when(head, "header")
    return lines.withColumn("region", region).where("region is not null").withColumn("canonical", canonicalize(F.col("text"))).select("doc_id", "page_no", "ord", "region", "canonical", "text", "bbox")


def noise_patterns(buckets: DataFrame) -> DataFrame:
    """Patterns that repeat: doc_id, region, canonical, pages, edge (lowest header edge or highest footer edge)."""
    grouped = buckets.groupBy("doc_id", "region", "canonical").agg(
        F.count_distinct("page_no").alias("pages"), F.min_by("text", F.struct("page_no", "ord")).alias("sample"), F.max("bbox.y1").alias("bottom"), F.min("bbox.y0").alias("top")
    )
    repeated = (F.col("pages") >= 2) | any_in(F.col("sample"), FOOTER_KEYWORDS)
    header = (F.col("pages") >= 3) & (F.length(F.trim("sample")) >= 12) & ~F.startswith(F.col("canonical"), F.lit("#. "))
    kept = grouped.where(repeated & ((F.col("region") == "footer") | header))
    return kept.select("doc_id", "region", "canonical", "pages", F.when(F.col("region") == "header", F.col("bottom")).otherwise(F.col("top")).alias("edge"))


def noise_profile(patterns: DataFrame) -> DataFrame:
    """doc_id, header_bottom, footer_top, header_patterns, footer_patterns."""
    head, foot = F.col("region") == "header", F.col("region") == "footer"
    return patterns.groupBy("doc_id").agg(
        F.max(F.when(head, F.col("edge"))).alias("header_bottom"), F.min(F.when(foot, F.col("edge"))).alias("footer_top"),
        F.sort_array(F.collect_set(F.when(head, F.col("canonical")))).alias("header_patterns"), F.sort_array(F.collect_set(F.when(foot, F.col("canonical")))).alias("footer_patterns"),
    )


def is_noise(text: Column, bbox: Column, height: Column) -> Column:
    """For rows joined with their document's profile; without a profile false."""
    canonical, keyword = canonicalize(text), any_in(text, FOOTER_KEYWORDS)
    foot = (bbox["y0"] >= F.col("footer_top") - SLACK) & (F.array_contains("footer_patterns", canonical) | keyword)
    head = (bbox["y1"] <= F.col("header_bottom") + SLACK) & F.array_contains("header_patterns", canonical)
    low = (bbox["y0"] >= (height * F.lit(BOTTOM_FROM)).cast("int")) & keyword
    known = F.col("footer_patterns").isNotNull()
    return known & (F.coalesce(foot, F.lit(False)) | F.coalesce(head, F.lit(False)) | low)


def flag_noise(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """lines with noise (boolean); profiles are one row per document."""
    return lines.join(profile, "doc_id", "left").withColumn("noise", is_noise(F.col("text"), F.col("bbox"), F.col("height"))).drop("header_bottom", "footer_top", "header_patterns", "footer_patterns")
