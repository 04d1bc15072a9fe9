"""Joins by position inside a key: containment, bands, nearest, first below."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import expand, intersection, overlap_fraction
from ..functions.labels import has_text


def words_in_boxes(boxes: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Every (box, word) of a key that overlap, the word's box re-based to the box. boxes: key, id, box; words: key, text, conf, wbox."""
    joined = boxes.join(words, key).where(intersection(F.col("box"), F.col("wbox")) > 0)
    rebased = F.struct(*[(F.col(f"wbox.{c}") - F.col(f"box.{c[0]}0")).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return joined.select(key, "id", *[c for c in words.columns if c not in (key, "wbox")], rebased.alias("wbox"))


def without_text_regions(boxes: DataFrame, words: DataFrame, key: str, min_conf: float = 55, w: int = 1 << 30, h: int = 1 << 30) -> DataFrame:
    """Boxes of which no confident word, padded by 3 x 2, lies more than 60 % inside while it covers more than 30 %."""
    sure = words.where((F.col("conf") >= min_conf) & has_text(F.col("text"))).select(F.col(key).alias("__key"), expand(F.col("wbox"), 3, 2, F.lit(w), F.lit(h)).alias("__w"))
    b, word = F.col("box"), F.col("__w")
    return boxes.join(sure, (F.col(key) == F.col("__key")) & (overlap_fraction(word, b) > 0.6) & (overlap_fraction(b, word) > 0.3), "left_anti")


def nearest(queries: DataFrame, rows: DataFrame, key: str, tolerance: float) -> DataFrame:
    """queries: key, q, v; rows: key, index, y -> key, q, distance, index (null beyond the tolerance). Ties: the lowest index.

    Both sides are merged in order of position and each query looks at its neighbours on both sides, so a key with
    many rows makes no pairs.
    """
    # equal positions: the lowest index stands for all
    single = rows.groupBy(key, "y").agg(F.min("index").alias("index"))
    mixed = queries.select(key, F.col("v").alias("p"), "q", F.lit(None).cast("struct<y:double,index:long>").alias("r")).unionByName(
        single.select(key, F.col("y").alias("p"), F.lit(None).cast("long").alias("q"), F.struct(F.col("y").cast("double").alias("y"), F.col("index").cast("long").alias("index")).alias("r"))
    )
    up = Window.partitionBy(key).orderBy(F.col("p"), F.col("q").isNotNull())
    down = Window.partitionBy(key).orderBy(F.col("p").desc(), F.col("q").isNotNull())
    found = mixed.withColumn("below", F.last("r", ignorenulls=True).over(up)).withColumn("above", F.last("r", ignorenulls=True).over(down)).where("q IS NOT NULL")
    near = F.array_min(F.filter(F.array(*[F.struct(F.abs(F.col("p") - F.col(f"{s}.y")).alias("d"), F.col(f"{s}.index").alias("i"), F.col(s).isNotNull().alias("ok")) for s in ("below", "above")]), lambda x: x["ok"]))
    out = found.withColumn("n", near).where("n IS NOT NULL")
    return out.select(key, "q", F.col("n.d").alias("distance"), F.when(F.col("n.d") <= tolerance, F.col("n.i")).alias("index"))


def band_pairs(left: DataFrame, right: DataFrame, key: str, tolerance: int) -> DataFrame:
    """left: key, a, ya; right: key, b, yb -> all pairs of a key within the tolerance, by an equi-join on bands of that width."""
    step = max(1, tolerance)
    near = right.withColumn("band", F.explode(F.array(*[F.floor(F.col("yb") / step) + d for d in (-1, 0, 1)])))
    return left.withColumn("band", F.floor(F.col("ya") / step)).join(near, [key, "band"]).where(F.abs(F.col("ya") - F.col("yb")) <= tolerance).drop("band")


def first_below(titles: DataFrame, captions: DataFrame, key: str) -> DataFrame:
    """titles: key, t, y; captions: key, c, cy -> key, t and the first caption with cy > y (ties: the lowest c), or null.

    Both sides are merged from below: the last caption met before a title is the one, so no pairs are made.
    """
    place = F.struct("cy", "c")
    first = captions.groupBy(key, "cy").agg(F.min("c").alias("c"))
    kind = place_type(captions)
    mixed = titles.select(key, F.col("y").cast("double").alias("p"), F.lit(True).alias("title"), "t", F.lit(None).cast(kind).alias("m")).unionByName(
        first.select(key, F.col("cy").cast("double").alias("p"), F.lit(False).alias("title"), F.lit(None).cast(titles.schema["t"].dataType).alias("t"), place.alias("m"))
    )
    # downwards, a title before captions of its own position, which aren't below it
    below = F.last("m", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("p"), F.desc("title")))
    return mixed.withColumn("m", below).where("title").select(key, "t", F.col("m.c").alias("c"), F.col("m.cy").alias("cy"))


def place_type(captions: DataFrame) -> str:
    return f"struct<cy:{captions.schema['cy'].dataType.simpleString()},c:{captions.schema['c'].dataType.simpleString()}>"
