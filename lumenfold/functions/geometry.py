"""Column expressions on half-open pixel boxes: structs x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def area_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger area; 0 if either box is empty."""
    small, large = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    return F.when(small > 0, small / large).otherwise(F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def overlap_fraction(a: Column, b: Column) -> Column:
    """The share of a that lies in b; 0 if a is empty."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def near(a: Column, b: Column, px: int, py: int) -> Column:
    """Whether the boxes overlap or touch within the margins."""
    return (a["x0"] <= b["x1"] + px) & (b["x0"] <= a["x1"] + px) & (a["y0"] <= b["y1"] + py) & (b["y0"] <= a["y1"] + py)


def expand(b: Column, px: int, py: int, w: Column, h: Column) -> Column:
    """Grown on all sides, cut off at the frame w x h."""
    return box(F.greatest(F.lit(0), b["x0"] - px), F.greatest(F.lit(0), b["y0"] - py), F.least(w, b["x1"] + px), F.least(h, b["y1"] + py))


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2.0


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2.0


def center_offset(a: Column, b: Column) -> Column:
    """How far b's centre lies to the right of a's."""
    return center_x(b) - center_x(a)


def enough_evidence(w: Column, h: Column, min_area: int = 450, min_width: int = 18, min_height: int = 12) -> Column:
    return (w >= min_width) & (h >= min_height) & (w * h >= min_area)


def points_to_pixels(v: Column, dpi: int) -> Column:
    """Page points to pixels, halves to even."""
    return F.bround(v * (dpi / 72.0)).cast("int")
