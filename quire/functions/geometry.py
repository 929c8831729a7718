"""Boxes as struct<x0:int,y0:int,x1:int,y1:int>, origin top left, in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, (int, float)) else v).cast("int").alias(n) for n, v in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def zero_box() -> Column:
    return box(0, 0, 0, 0)


def union_box(b: str | Column) -> Column:
    """Aggregate: the least box around all; zeros for none."""
    b = F.col(b) if isinstance(b, str) else b
    return box(*[F.coalesce(f(b[s]), F.lit(0)) for f, s in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def polygon_box(vertices: Column) -> Column:
    """The box of an array of struct<x,y>; a missing coordinate is 0, no vertices give zeros."""
    xs = F.transform(vertices, lambda v: F.coalesce(v["x"], F.lit(0)))
    ys = F.transform(vertices, lambda v: F.coalesce(v["y"], F.lit(0)))
    return F.when(F.size(vertices) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(zero_box())


def area(b: Column) -> Column:
    w, h = (F.greatest(F.lit(0), b[hi] - b[lo]).cast("long") for lo, hi in (("x0", "x1"), ("y0", "y1")))
    return w * h


def intersects(a: Column, b: Column) -> Column:
    """Strict: touching edges do not count."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def intersection(a: Column, b: Column) -> Column:
    both = box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when(intersects(a, b), both).otherwise(zero_box())


def contains(outer: Column, inner: Column, margin: int = 0) -> Column:
    return (inner["x0"] >= outer["x0"] - margin) & (inner["y0"] >= outer["y0"] - margin) & (inner["x1"] <= outer["x1"] + margin) & (inner["y1"] <= outer["y1"] + margin)


def expand(b: Column, margin: int) -> Column:
    return box(b["x0"] - margin, b["y0"] - margin, b["x1"] + margin, b["y1"] + margin)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    inter = area(intersection(a, b))
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / F.greatest(F.lit(1), F.least(area(a), area(b))))


def clamp(b: Column, width: Column, height: Column) -> Column:
    return box(F.greatest(F.lit(0), b["x0"]), F.greatest(F.lit(0), b["y0"]), F.least(width, b["x1"]), F.least(height, b["y1"]))


def pdf_to_pixels(b: Column, width: Column, height: Column, pdf_width: Column, pdf_height: Column) -> Column:
    """A box in points, origin bottom left, to pixels; rounds half to even and stays on the page."""
    sx, sy = (p / F.greatest(q, F.lit(1.0)) for p, q in ((width, pdf_width), (height, pdf_height)))
    flat = box(*[F.bround(v).cast("int") for v in (b["left"] * sx, height - b["top"] * sy, b["right"] * sx, height - b["bottom"] * sy)])
    return clamp(flat, width, height)


def scale_word(b: Column, sx, sy) -> Column:
    """Coordinates in points to pixels, truncated."""
    return box(*[(b[s] * k).cast("int") for s, k in zip(SIDES, (sx, sy, sx, sy), strict=True)])
