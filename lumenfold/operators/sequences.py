"""Ordered sequences: smoothing, islands, interval unions, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, w: int) -> DataFrame:
    """Adds `smooth`: the centred mean over w places, zeros beyond the ends."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(w // 2), (w - 1) // 2)
    return df.withColumn("smooth", F.sum(value).over(frame) / w)


def islands(df: DataFrame, keys: list[str], at: str, value: str, threshold: float, merge_gap: int, min_length: int) -> DataFrame:
    """keys, begin, end (half-open) of stretches over the threshold, joined over gaps up to merge_gap, then of min_length at least."""
    w = Window.partitionBy(*keys).orderBy(at)
    over = df.where(F.col(value) > threshold)
    begins = over.withColumn("begins", F.coalesce(F.col(at) - F.lag(at).over(w) - 1 > merge_gap, F.lit(True)).cast("int"))
    numbered = begins.withColumn("island", F.sum("begins").over(w))
    out = numbered.groupBy(*keys, "island").agg(F.min(at).alias("begin"), (F.max(at) + 1).alias("end"))
    return out.where(F.col("end") - F.col("begin") >= min_length).drop("island")


def union_length(df: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """keys, covered: the length of the union of half-open intervals; empty ones count nothing."""
    before = Window.partitionBy(*keys).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(begin), F.coalesce(reach, F.col(begin))))
    return df.withColumn("__fresh", fresh).groupBy(*keys).agg(F.sum("__fresh").alias("covered"))


def coverage(covered: Column, width: Column) -> Column:
    """Share of a row that is covered, at most 1; null without a row."""
    return F.round(F.least(F.lit(1.0), F.try_divide(covered, width)), 4)


def running_offset(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds `offset`: characters of all lines before, a line end counted for each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, start: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1))


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def sliding_windows(df: DataFrame, y0: str, y1: str) -> DataFrame:
    """A row for each window of a region: top, size = clamp(height // 7, 14, 30), step = max(5, size // 3)."""
    size = F.greatest(F.lit(14), F.least(F.lit(30), F.floor((F.col(y1) - F.col(y0)) / 7))).cast("int")
    sized = df.withColumn("size", size).where(F.col(y1) - F.col(y0) >= F.col("size"))
    step = F.greatest(F.lit(5), F.floor(F.col("size") / 3)).cast("int")
    return sized.withColumn("top", F.explode(F.sequence(F.col(y0).cast("int"), (F.col(y1) - F.col("size")).cast("int"), step)))
