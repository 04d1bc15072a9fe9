"""Where figures lie on the pages of a paper, from the titles and captions of its text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import points_to_pixels
from ..functions.labels import figure_number


def pixel_box(dpi: int) -> Column:
    """struct<x, y, w, h> in pixels from the top, of a match in points from the bottom (columns x, y, w, h, and the page's height)."""
    top = F.col("height") - F.col("y") - F.col("h")
    return F.struct(*[points_to_pixels(v, dpi).alias(n) for n, v in (("x", F.col("x")), ("y", top), ("w", F.col("w")), ("h", F.col("h")))])


def discover_figures(matches: DataFrame, dpi: int = 180, only: int | None = None) -> DataFrame:
    """matches: page, width, height, kind, text, index, x, y, w, h -> figure, page, crop_top, crop_bottom.

    A figure lies between its title and the first caption below that comes later in the text and begins in the left
    35 % of the page, or the page's end; crops under 100 pixels are left out, and so are supplementary figures.
    """
    placed = matches.withColumn("px", pixel_box(dpi))
    number = figure_number(F.col("text"))
    titles = placed.where((F.col("kind") == "figure_title") & ~F.lower("text").startswith("supplementary")).withColumn("figure", number).where("figure IS NOT NULL")
    if only is not None:
        titles = titles.where(F.col("figure") == only)
    titles = titles.select("page", "figure", F.col("index").alias("t"), (F.col("px.y") + F.col("px.h") + max(12, int(dpi * 0.08))).alias("crop_top"), points_to_pixels(F.col("height"), dpi).alias("page_height"))
    captions = placed.where("kind = 'panel_caption' AND x <= 0.35 * width").select("page", F.col("index").alias("c"), F.col("px.y").alias("cy"))
    below = titles.join(captions, "page", "left")
    fits = (F.col("c") > F.col("t")) & (F.col("cy") > F.col("crop_top"))
    first = below.groupBy("page", "figure", "t", "crop_top", "page_height").agg(F.min(F.when(fits, F.col("cy"))).alias("cy"))
    bottom = F.coalesce(F.col("cy") - max(8, int(dpi * 0.04)), F.col("page_height") - 80)
    return first.select("figure", "page", "crop_top", bottom.alias("crop_bottom")).where("crop_bottom - crop_top >= 100")
