"""Labels of panels, protein rows of blots, and the choice and rows of strips."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import center_y, enough_evidence
from ..functions.labels import panel_label, present, protein_label
from . import evidence, greedy, kernels, sequences, spatial

LETTERS = string.ascii_uppercase


def row_major(boxes: DataFrame, key: str) -> DataFrame:
    """boxes: key, id, box -> key, id, ord (from 0): row by row, each from left to right. Meant for the boxes of one figure."""

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for i, b in sorted(zip(frame["id"], frame["box"])):
            found.setdefault((b["x0"], b["y0"], b["x1"], b["y1"]), []).append(i)
        ids = [found[b].pop(0) for b in kernels.reading_order([b for b, same in found.items() for _ in same])]
        return pd.DataFrame({key: frame[key].iloc[0], "id": ids, "ord": range(len(ids))})

    return boxes.select(key, "id", "box").groupBy(key).applyInPandas(order, f"{key} {boxes.schema[key].dataType.simpleString()}, id {boxes.schema['id'].dataType.simpleString()}, ord int")


def label_candidates(boxes: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Every (box, word) where the word may be the box's letter: key, a (the box's ord), b (letter), cost, w, conf.

    boxes: key, ord, box; words: key, w (their order), text, conf, wbox. The letter's centre lies in the top left
    corner, it is small against the box, and the OCR is sure of it.
    """
    letters = words.withColumn("b", panel_label(F.col("text"))).where("b IS NOT NULL AND conf >= 35")
    size = lambda b, axis: F.col(f"{b}.{axis}1") - F.col(f"{b}.{axis}0")
    middle = lambda axis: (F.col(f"wbox.{axis}0") + F.col(f"wbox.{axis}1")) / 2
    small = (size("wbox", "x") <= F.greatest(F.lit(50.0), 0.30 * size("box", "x"))) & (size("wbox", "y") <= F.greatest(F.lit(45.0), 0.30 * size("box", "y")))
    inside = lambda axis, before: middle(axis).between(F.col(f"box.{axis}0") - before, F.col(f"box.{axis}0") + 0.34 * size("box", axis))
    away = lambda axis: F.greatest(F.lit(0.0), middle(axis) - F.col(f"box.{axis}0"))
    near = boxes.select(key, "ord", "box").join(letters, key).where(small & inside("x", 45) & inside("y", 30))
    return near.select(key, F.col("ord").alias("a"), "b", (away("x") + 1.8 * away("y") - 0.2 * F.col("conf")).alias("cost"), "w", "conf")


def label_panels(boxes: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """boxes (key, ord, box and more) with panel, label_source and label_confidence.

    Letters that the OCR found are given greedily by cost, none twice; the other boxes get the unused letters in
    order, and P with their number beyond Z.
    """
    pairs = label_candidates(boxes, words, key)
    given = greedy.assign_one_to_one(pairs, key, ["cost", "w"], carry=["conf"]).select(key, F.col("a").alias("ord"), F.col("b").alias("__letter"), F.col("conf").alias("__conf"))
    used = given.groupBy(key).agg(F.collect_set("__letter").alias("__used"))
    joined = boxes.join(given, [key, "ord"], "left").join(used, key, "left")
    turn = F.row_number().over(Window.partitionBy(key, F.col("__letter").isNull()).orderBy("ord"))
    free = F.array_except(F.array(*map(F.lit, LETTERS)), F.coalesce("__used", F.array().cast("array<string>")))
    fallback = F.coalesce(F.get(free, F.col("__turn") - 1), F.concat(F.lit("P"), (F.col("ord") + 1).cast("string")))
    out = joined.withColumn("__turn", turn).withColumns({
        "panel": F.coalesce("__letter", fallback), "label_source": F.when(F.col("__letter").isNull(), "row_major").otherwise("ocr"), "label_confidence": F.round("__conf", 2),
    })
    return out.drop("__letter", "__conf", "__used", "__turn")


def protein_rows(panels: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_index (from 0, downwards), row_label, center_y, source, confidence: the rows of blots.

    panels: keys, region (box or null), width, centers (of rows seen in the image); words: keys, w, text, conf, wbox in the
    panel. Protein names to the right of the region go to the row centres within 12, greedily by distance, then
    confidence; those left over are rows of their own unless a row lies within 14.
    """
    x = (F.col("wbox.x0") + F.col("wbox.x1")) / 2
    y = (F.col("wbox.y0") + F.col("wbox.y1")) / 2
    r = F.col("region")
    low = F.when(r.isNull(), 0.55 * F.col("width")).otherwise(r["x0"] + 0.72 * (r["x1"] - r["x0"]))
    high = F.when(r.isNull(), F.col("width") + 40).otherwise(F.least(F.col("width") + 40, r["x1"] + F.greatest(F.lit(80), (0.35 * F.col("width")).cast("int"))))
    named = words.withColumn("label", protein_label(F.col("text"), short=True)).where("label IS NOT NULL AND conf >= 20")
    names = panels.join(named, keys).where(x.between(low, high)).select(*keys, "w", "label", "conf", y.alias("y"))
    seen = panels.select(*keys, F.posexplode("centers").alias("a", "ya"))
    whole = F.struct(*keys)
    pairs = seen.withColumn("key", whole).join(names.select(whole.alias("key"), F.col("w").alias("b"), "y", "label", "conf"), "key").where(F.abs(F.col("ya") - F.col("y")) <= 12)
    pairs = pairs.select("key", "a", "b", "label", "conf", F.abs(F.col("ya") - F.col("y")).alias("gap"), (-F.col("conf")).alias("sure"))
    given = greedy.assign_one_to_one(pairs, "key", ["gap", "sure"], carry=["label", "conf"]).select("key.*", "a", "b", "label", "conf")
    rows = seen.join(given.drop("b"), [*keys, "a"], "left").select(
        *keys, F.col("label").alias("row_label"), F.round("ya", 2).alias("center_y"), F.when(F.col("label").isNull(), "image").otherwise("ocr").alias("source"), F.round("conf", 2).alias("confidence")
    )
    left = names.join(given.select(*keys, F.col("b").alias("w")), [*keys, "w"], "left_anti")
    taken = rows.groupBy(*keys).agg(F.collect_list("center_y").alias("taken"))
    listed = left.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("w", "y", "label", "conf"))).alias("left")).join(taken, keys, "left")
    # each one that is added keeps others away, too
    fold = (
        "aggregate(left, slice(left, 1, 0), (acc, c) -> IF(exists(coalesce(taken, array()), t -> abs(t - c.y) <= 14) OR exists(acc, k -> abs(round(k.y, 2) - c.y) <= 14), acc, array_append(acc, c)))"
    )
    added = listed.select(*keys, F.explode(F.expr(fold)).alias("c")).select(
        *keys, F.col("c.label").alias("row_label"), F.round("c.y", 2).alias("center_y"), F.lit("ocr").alias("source"), F.round("c.conf", 2).alias("confidence")
    )
    return sequences.numbered(rows.unionByName(added), keys, ["center_y", "row_label"], "row_index", 0)


def judged_strips(raw: DataFrame, words: DataFrame, keys: list[str], min_area: int = 450, min_width: int = 18, min_height: int = 12) -> DataFrame:
    """raw (keys, n, kind, box, spread, dark) with status: small, flat, text or candidate - the first that fits - and rank.

    words: keys, text, conf, wbox in the panel, and the panel's width and height.
    """
    size = lambda axis: F.col(f"box.{axis}1") - F.col(f"box.{axis}0")
    of = lambda place: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[place])) for k, v in kernels.STRIPS.items()])
    small = of(3) & ~enough_evidence(size("x"), size("y"), min_area, min_width, min_height)
    flat = (F.col("spread") < of(0)) | (F.col("dark") < of(1))
    first = raw.withColumn("rank", F.col("spread") + F.col("dark") * of(2)).withColumn("status", F.when(small, "small").when(flat, "flat")).withColumn("key", F.struct(*keys))
    open_ = first.where("status IS NULL")
    plain = spatial.without_text_regions(open_, words.select(F.struct(*keys).alias("key"), "text", "conf", "wbox"), "key").select(*keys, "n").withColumn("plain", F.lit(True))
    return first.drop("key").join(plain, [*keys, "n"], "left").withColumn("status", F.coalesce("status", F.when(F.col("plain"), "candidate").otherwise("text"))).drop("plain")


def chosen_strips(judged: DataFrame, keys: list[str], most: int = 48) -> DataFrame:
    """keys, strip_index (from 1, downwards), box, rank: the candidates that non-maximum suppression leaves."""
    candidates = judged.where("status = 'candidate'").withColumn("key", F.struct(*keys))
    kept = greedy.non_maximum_suppression(candidates.select("key", F.col("n").alias("id"), "box", F.col("rank").alias("score")), "key", most).select("key.*", F.explode("kept").alias("n"))
    out = judged.select(*keys, "n", "box", F.round("rank", 4).alias("rank")).join(kept, [*keys, "n"])
    return sequences.numbered(out, keys, ["box.y0", "box.x0", "n"], "strip_index").drop("n")


def strip_rows(strips: DataFrame, rows: DataFrame, keys: list[str], tolerance: float = 22) -> DataFrame:
    """strips (keys, strip_index, box) with row_index, row_label, row_source and row_distance of the nearest protein row, the first three null beyond the tolerance."""
    key = F.struct(*keys).alias("key")
    asked = strips.select(key, F.col("strip_index").cast("long").alias("q"), center_y(F.col("box")).alias("v"))
    found = spatial.nearest(asked, rows.select(key, F.col("row_index").alias("index"), F.col("center_y").alias("y")), "key", tolerance)
    found = found.select("key.*", F.col("q").alias("strip_index"), F.round("distance", 2).alias("row_distance"), F.col("index").alias("row_index"))
    named = found.join(rows.select(*keys, "row_index", "row_label", F.col("source").alias("row_source")), [*keys, "row_index"], "left")
    return strips.join(named, [*keys, "strip_index"], "left")


def propagated_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (figure, page, panel, row_index, row_label, source, confidence) with labels that all labelled rows of the same index agree on."""
    panel = F.struct(*keys)
    filled = evidence.propagated(rows.withColumn("__was", present(F.col("row_label"))).withColumn("__panel", panel), [*keys[:-1], "row_index"], "__panel", "row_label")
    new = ~F.col("__was") & F.col("row_label").isNotNull()
    return filled.withColumns({"source": F.when(new, "propagated").otherwise(F.col("source")), "confidence": F.when(~new, F.col("confidence"))}).drop("__was", "__panel")


def relabelled_strips(strips: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Strips with a row but no label take the row's label and source."""
    known = rows.where(present(F.col("row_label"))).select(*keys, "row_index", F.col("row_label").alias("__label"), F.col("source").alias("__source"))
    bare = F.col("row_label").isNull()
    joined = strips.join(known, [*keys, "row_index"], "left")
    fill = lambda old, new: F.when(bare & F.col("__label").isNotNull(), F.col(new)).otherwise(F.col(old))
    return joined.withColumns({"row_source": fill("row_source", "__source"), "row_label": F.coalesce("row_label", "__label")}).drop("__label", "__source")


def strip_in_row(label: Column, index: Column, row_label: Column, row_index: Column) -> Column:
    """Whether a strip belongs to a row: by the row's label if it has one, else by its index."""
    return F.when(row_label.isNotNull(), label.eqNullSafe(row_label)).otherwise(F.coalesce(index == row_index, F.lit(False)))
