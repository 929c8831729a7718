"""Tables from cells: acceptance as evidence, reliability, best match for a box, simple construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, overlap_ratio
from ..functions.text import is_prose

LEAST_OVERLAP = 0.45


def table_stats(cells: DataFrame) -> DataFrame:
    """One row per table: counts over its cells and an ordered list of the filled ones."""
    t = F.trim("text")
    filled = t != ""
    out = cells.groupBy("doc_id", "table_id", "n_rows", "n_cols").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(filled).alias("filled"), F.count_distinct(F.when(filled, F.col("row"))).alias("full_rows"), F.count_distinct(F.when(filled, F.col("col"))).alias("full_cols"),
        F.count_if(filled & (F.length(t) >= 40)).alias("long"), F.count_if(filled & (F.length(t) <= 8)).alias("short"), F.count_if(filled & t.rlike(r"^\d+$")).alias("numeric"), F.count_if(filled & t.rlike(r"\p{L}")).alias("alpha"),
        F.array_sort(F.collect_list(F.when(filled, F.struct("row", "col", t.alias("t"))))).alias("items"),
        F.min("row").alias("least_row"), F.min("col").alias("least_col"), F.max("row").alias("most_row"), F.max("col").alias("most_col"),
    )
    return out


def lookup_grid() -> Column:
    c = F.col
    return (c("n_rows") >= 2) & (c("n_cols") >= 3) & (c("filled") == c("cells")) & (c("short") >= c("filled") - 1) & (c("numeric") >= 1) & (c("alpha") >= 2)


def key_value() -> Column:
    """Two columns with short labels and values in nearly every row."""
    values = lambda col: F.map_from_entries(F.transform(F.filter("items", lambda i: i["col"] == col), lambda i: F.struct(i["row"], i["t"])))
    labels, texts = values(0), values(1)
    complete = F.filter(F.map_keys(labels), lambda r: F.map_contains_key(texts, r))
    n = F.size(complete)
    fits = lambda m, most: F.size(F.filter(complete, lambda r: F.length(F.element_at(m, r)) <= most)) >= F.greatest(F.lit(2), n - 1)
    return (F.col("n_cols") == 2) & (F.col("n_rows") >= 2) & (n >= F.greatest(F.lit(2), F.col("n_rows") - 1)) & fits(labels, 40) & fits(texts, 20)


def structured() -> Column:
    c = F.col
    joined = F.array_join(F.transform(F.slice("items", 1, 6), lambda i: i["t"]), " ")
    dense = (c("filled") / F.greatest(F.lit(1), c("cells")) >= 0.5) & (c("full_cols") >= 2) & (c("long") <= F.floor(c("filled") / 2)) & ~(is_prose(joined) & (c("n_rows") <= 3))
    return (c("n_rows") > 1) & (c("n_cols") > 1) & (c("filled") >= 4) & (lookup_grid() | key_value() | dense)


def reliable() -> Column:
    c = F.col
    enough = c("cells") >= F.greatest(F.lit(2), F.least(F.lit(4), c("n_rows") * c("n_cols")))
    cover = (c("full_rows") / F.greatest(F.lit(1), c("n_rows")) >= 0.75) & ((c("n_cols") <= 1) | (c("full_cols") / F.greatest(F.lit(1), c("n_cols")) >= 0.75))
    return (c("n_rows") > 0) & (c("n_cols") > 0) & ~((c("n_rows") == 1) & (c("n_cols") == 1)) & (c("filled") > 0) & enough & (c("filled") / F.greatest(F.lit(1), c("cells")) >= 0.6) & cover


def best_table(boxes: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """For each box of `key` the table of its document and page that overlaps it most; nearer areas, then earlier tables win ties."""
    pairs = boxes.select(*key, F.col("bbox").alias("_b")).join(tables.select(*key[:2], "table_id", F.col("ord").alias("_t_ord"), F.col("bbox").alias("_t")), key[:2])
    score = overlap_ratio(F.col("_t"), F.col("_b"))
    rank = F.struct(score.alias("score"), (-F.abs(area(F.col("_t")) - area(F.col("_b")))).alias("near"), (-F.col("_t_ord")).alias("first"))
    best = pairs.groupBy(*key).agg(F.max_by("table_id", rank).alias("table_id"), F.max(score).alias("score"))
    return best.where(F.col("score") >= LEAST_OVERLAP)


def simple_table(rows: DataFrame) -> DataFrame:
    """doc_id, rows (array of arrays of text) -> a cell each, with the table's size."""
    n_cols = F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0))
    out = rows.select("doc_id", F.size("rows").alias("n_rows"), n_cols.alias("n_cols"), F.posexplode("rows").alias("row", "_r"))
    return out.select("doc_id", "n_rows", "n_cols", "row", F.posexplode("_r").alias("col", "text")).withColumns({"rowspan": F.lit(1), "colspan": F.lit(1)})
