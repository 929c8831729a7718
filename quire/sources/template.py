"""Template fields: whether to apply, how to read them, how they fill exam metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def should_apply(enabled: bool, keywords: list[str], stem: Column, pages: Column) -> Column:
    match = F.lit(True) if not keywords else F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(stem, k))
    return F.lit(enabled) & match & (pages >= 1)


def _first_filled(row: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(row[n]), F.lit("")) for n in names])


def read_fields(rows: DataFrame) -> DataFrame:
    """doc_id, title, fields (arrays of structs of names and values) -> fields as a map; later entries win, fields over title.

    A name is the first filled of name, label, key, inferFieldName; a value the first of inferText, value, text, inferFieldValue.
    """
    both = F.concat("title", "fields")
    pairs = F.transform(both, lambda f: F.struct(_first_filled(f, ("name", "label", "key", "inferFieldName")).alias("k"), _first_filled(f, ("inferText", "value", "text", "inferFieldValue")).alias("v")))
    full = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    last = F.filter(full, lambda p, i: ~F.exists(F.slice(full, i + 2, F.size(full)), lambda q: q["k"] == p["k"]))
    return rows.select("doc_id", F.map_from_entries(last).alias("template"))


ALIASES = {"school": ("school", "학교"), "subject": ("subject", "과목"), "exam_type": ("exam_type", "시험")}


def merge_meta(meta: DataFrame, fields: DataFrame) -> DataFrame:
    """meta with empty attributes filled from the template, and where they came from."""
    joined = meta.join(fields, "doc_id", "left")
    value = lambda c: F.coalesce(*[F.try_element_at("template", F.lit(a)) for a in ALIASES[c]])
    filled = {c: F.coalesce(F.col(c), value(c)) for c in ALIASES}
    sources = {f"{c}_source": F.when(F.col(c).isNotNull(), F.col(f"{c}_source")).when(value(c).isNotNull(), "template") for c in ALIASES}
    return joined.select("doc_id", *[v.alias(c) for c, v in filled.items()], *[v.alias(c) for c, v in sources.items()])
