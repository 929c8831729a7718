"""OCR service responses and PDF words as base tables: lines, words, tables; cache lookup and request plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, polygon_box, union_box, zero_box

POINT = "struct<x:double,y:double>"
FIELD = f"struct<text:string,lineBreak:boolean,confidence:double,vertices:array<{POINT}>>"
CELL = f"struct<rowIndex:int,columnIndex:int,rowSpan:int,columnSpan:int,lines:array<array<string>>,confidence:double,vertices:array<{POINT}>>"


def fields_to_lines(fields: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, text, lineBreak, confidence, vertices -> a row per line.

    Fields with fewer than four vertices are left out, their line break too; a line ends after a
    break and at the end of the page.
    """
    used = fields.where(F.size("vertices") >= 4)
    w = Window.partitionBy("doc_id", "page_no").orderBy("ord")
    broken = used.withColumn("_b", F.coalesce(F.lag(F.coalesce("lineBreak", F.lit(False)).cast("int")).over(w), F.lit(0)))
    placed = broken.withColumn("_line", F.sum("_b").over(w)).withColumn("_box", polygon_box(F.col("vertices")))
    lines = placed.groupBy("doc_id", "page_no", "_line").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_i"), union_box("_box").alias("bbox"), F.avg("confidence").alias("confidence"))
    text = F.trim(F.array_join(F.transform("_i", lambda i: i["text"]), " "))
    return lines.withColumn("text", text).where("text <> ''").select("doc_id", "page_no", F.col("_line").cast("int").alias("line_no"), "text", "bbox", "confidence")


def raw_tables(tables: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, vertices, cells -> tables with typed cells; those without cells are left out."""
    cells = F.transform(
        "cells",
        lambda c: F.struct(
            F.coalesce(c["rowIndex"], F.lit(0)).alias("row"), F.coalesce(c["columnIndex"], F.lit(0)).alias("col"), F.coalesce(c["rowSpan"], F.lit(1)).alias("rowspan"), F.coalesce(c["columnSpan"], F.lit(1)).alias("colspan"),
            F.array_join(F.flatten(c["lines"]), " ").alias("text"), F.coalesce(c["confidence"], F.lit(1.0)).alias("confidence"), polygon_box(c["vertices"]).alias("bbox"),
        ),
    )
    rows = tables.where(F.size("cells") > 0).withColumns({"_c": cells, "_b": polygon_box(F.col("vertices"))})
    real = F.filter(F.transform("_c", lambda c: c["bbox"]), lambda b: b != zero_box())
    side = lambda f, s: f(F.transform(real, lambda b: b[s]))
    around = F.when(F.size(real) > 0, box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))).otherwise(zero_box())
    most = lambda at, span: F.array_max(F.transform("_c", lambda c: c[at] + c[span]))
    return rows.select("doc_id", "page_no", F.concat(F.lit("clova_table_"), "ord").alias("table_id"), F.when(F.col("_b") == zero_box(), around).otherwise(F.col("_b")).alias("bbox"), most("row", "rowspan").alias("n_rows"), most("col", "colspan").alias("n_cols"), F.col("_c").alias("cells"))


def number_items(pages: DataFrame, column: str, letter: str) -> DataFrame:
    """An array of texts per page as rows with ids p{page}_{letter}{i}; i counts blanks, which are left out."""
    rows = pages.select("doc_id", "page_no", F.posexplode(column).alias("_p", "_t"))
    text = F.trim("_t")
    return rows.where(text != "").select("doc_id", "page_no", (F.col("_p") + 1).alias("ord"), F.concat(F.lit("p"), "page_no", F.lit("_" + letter), F.col("_p") + 1).alias("id"), text.alias("text"))


def lines_from_words(words: DataFrame) -> DataFrame:
    """PDF words (block_no, line_no, word_no) as lines; the index counts lines that are blank, which are left out."""
    rows = words.groupBy("doc_id", "page_no", F.coalesce("block_no", F.lit(0)).alias("block_no"), F.coalesce("line_no", F.lit(0)).alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct("word_no", F.trim("text").alias("t")))).alias("_i"), union_box("bbox").alias("bbox"), F.avg(F.coalesce("confidence", F.lit(1.0))).alias("confidence")
    )
    i = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("block_no", "line_no"))
    text = F.array_join(F.filter(F.transform("_i", lambda x: x["t"]), lambda t: t != ""), " ")
    return rows.withColumns({"ord": i, "text": text}).where("text <> ''").select("doc_id", "page_no", "ord", F.concat(F.lit("p"), "page_no", F.lit("_l"), "ord").alias("line_id"), "text", "bbox", "confidence")


def cache_digest(image: Column, version: str, language: str, tables: bool, url: str, extra: str = "") -> Column:
    """Content address of a request."""
    return F.sha1(F.concat_ws("|", F.hex(image), F.lit(version), F.lit(language), F.lit(str(tables).lower()), F.lit(url), F.lit(extra)))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("digest"), "digest", "left_anti")


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "digest")


def normalize_url(url: Column) -> Column:
    """http becomes https for one vendor's hosts only."""
    return F.when(url.rlike(r"^http://[^/]*ncloud\.com(?:[:/]|$)"), F.regexp_replace(url, "^http:", "https:")).otherwise(url)


def call_service(pages: DataFrame, send: Callable[[bytes], str], attempts: int = 2) -> DataFrame:
    """pages (doc_id, page_no, content) with raw, the response of `send` for each image; a failed request is tried again.

    `send` makes one request and is shipped to the executors; rows stream, so an executor holds one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = []
            for content in batch["content"]:
                for k in range(attempts):
                    try:
                        raw.append(send(bytes(content)))
                        break
                    except Exception:
                        if k + 1 == attempts:
                            raise
            yield batch[["doc_id", "page_no"]].assign(raw=raw)

    return pages.mapInPandas(run, "doc_id string, page_no int, raw string")


def ocr_pages(service: DataFrame | None, from_pdf: DataFrame) -> DataFrame:
    """Lines of the OCR service where it is on, else those of the PDF's own text."""
    return from_pdf if service is None else service


def crop_lines(crops: DataFrame, service: DataFrame | None = None) -> DataFrame:
    """doc_id, block_id, text, confidence: a crop's second reading; without a service its first text at full confidence."""
    if service is not None:
        return service
    return crops.select("doc_id", "block_id", "text", F.lit(1.0).alias("confidence"))
