"""Images to figures, panels and strip candidates: the kernels over rows that hold one image each.

A row with an image has height, width and pixels (RGB bytes); a task holds one batch of them. Everything that needs
no pixels is left to joins and expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box
from . import kernels

IMAGE = "height int, width int, pixels binary"
CORNERS = "x0 int, y0 int, x1 int, y1 int"


def each_row(df: DataFrame, schema: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The rows that make(row) yields, in the schema."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                if made := list(make(row)):
                    yield pd.DataFrame(made, columns=names)

    return df.mapInPandas(run, schema)


def image_of(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3)


def image_row(image: np.ndarray) -> tuple[int, int, bytes]:
    return *image.shape[:2], np.ascontiguousarray(image).tobytes()


def cropped(image: np.ndarray, b: kernels.Box) -> np.ndarray:
    return image[b[1] : b[3], b[0] : b[2]]


def boxed(df: DataFrame) -> DataFrame:
    """With the corners as one column box."""
    return df.withColumn("box", box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).drop("x0", "y0", "x1", "y1")


def decoded(images: DataFrame) -> DataFrame:
    """images: figure, image (Spark's image struct: BGR, BGRA or gray) -> figure and the image as RGB."""

    def make(row) -> Iterator[tuple]:
        a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
        yield row.figure, *image_row(np.repeat(a, 3, axis=2) if row.channels == 1 else a[:, :, 2::-1])

    flat = images.select("figure", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return each_row(flat, f"figure int, {IMAGE}", make)


def trimmed(images: DataFrame, pad: int = 8, only: int | None = None) -> DataFrame:
    """images: figure, image columns -> figure, page (the same number), box in the image, and what lies in it: the content and `pad` around, or all of a blank image."""

    def make(row) -> Iterator[tuple]:
        a = image_of(row)
        found = kernels.content_box(kernels.gray(a))
        b = kernels.padded(found, pad, pad, a.shape) if found else (0, 0, row.width, row.height)
        yield row.figure, row.figure, *b, *image_row(cropped(a, b))

    chosen = images if only is None else images.where(F.col("figure") == only)
    return boxed(each_row(chosen, f"figure int, page int, {CORNERS}, {IMAGE}", make))


def crop_figures(specs: DataFrame, pages: DataFrame, dpi: int = 180) -> DataFrame:
    """specs: figure, page, crop_top, crop_bottom; pages: page and its image -> as trimmed(). Figures without a page or content are left out."""
    pad = max(8, int(dpi * 0.05))

    def make(row) -> Iterator[tuple]:
        a = image_of(row)
        top, bottom = max(0, row.crop_top), min(row.height, row.crop_bottom)
        if found := kernels.content_box(kernels.gray(a[top:bottom])):
            b = kernels.padded((found[0], top + found[1], found[2], top + found[3]), pad, pad, a.shape)
            yield row.figure, row.page, *b, *image_row(cropped(a, b))

    return boxed(each_row(specs.join(pages, "page"), f"figure int, page int, {CORNERS}, {IMAGE}", make))


def panel_boxes(figures: DataFrame, most: int = 26) -> DataFrame:
    """figures: figure, page and their images -> figure, page, ord (from 0, in reading order), box."""

    def make(row) -> Iterator[tuple]:
        for k, b in enumerate(kernels.panels(kernels.gray(image_of(row)), most)):
            yield row.figure, row.page, k, *b

    return boxed(each_row(figures, f"figure int, page int, ord int, {CORNERS}", make))


def panel_crops(figures: DataFrame, panels: DataFrame) -> DataFrame:
    """panels: figure, page, panel, box -> figure, page, panel, category, colorfulness, horizontal_score, the blot's region (null without), its row centres, and the panel's image."""

    def make(row) -> Iterator[tuple]:
        a = cropped(image_of(row), (row.x0, row.y0, row.x1, row.y1))
        g = kernels.gray(a)
        category, color, score = kernels.panel_features(a)
        region = kernels.blot_region(g)
        # no region: an empty box
        yield row.figure, row.page, row.panel, category, round(color, 4), round(score, 4), *(region or (0, 0, 0, 0)), [float(c) for c in kernels.blot_rows(g, region)] if region else [], *image_row(a)

    key = ["figure", "page"]
    joined = panels.select(*key, "panel", "box.*").join(figures.select(*key, "height", "width", "pixels"), key)
    out = each_row(joined, f"figure int, page int, panel string, category string, colorfulness double, horizontal_score double, {CORNERS}, centers array<double>, {IMAGE}", make)
    return boxed(out).withColumn("region", F.when(F.col("box.x1") > 0, F.col("box"))).drop("box")


def raw_strips(crops: DataFrame, min_width: int = 18, min_height: int = 12) -> DataFrame:
    """crops: as panel_crops() -> figure, page, panel, n (the order in which they are found), kind, box, spread, dark of all candidates in blots."""

    def make(row) -> Iterator[tuple]:
        for k, (kind, b, spread, dark) in enumerate(kernels.strip_candidates(kernels.gray(image_of(row)), min_width, min_height)):
            yield row.figure, row.page, row.panel, k, kind, *b, spread, dark

    blots = crops.where("category = 'blot'").select("figure", "page", "panel", "height", "width", "pixels")
    return boxed(each_row(blots, f"figure int, page int, panel string, n int, kind string, {CORNERS}, spread double, dark double", make))


def strip_patches(strips: DataFrame, crops: DataFrame, size: tuple[int, int] = (180, 36)) -> DataFrame:
    """strips: figure, page, panel, strip, box -> figure, page, panel, strip, patch (comparable form of the strip's pixels, float32)."""

    def make(row) -> Iterator[tuple]:
        crop = cropped(image_of(row), (row.x0, row.y0, row.x1, row.y1))
        yield row.figure, row.page, row.panel, row.strip, kernels.descriptor(crop, size).astype("<f4").tobytes()

    key = ["figure", "page", "panel"]
    joined = strips.select(*key, "strip", "box.*").join(crops.select(*key, "height", "width", "pixels"), key)
    return each_row(joined, "figure int, page int, panel string, strip string, patch binary", make)


def panel_patches(crops: DataFrame, size: int = 180) -> DataFrame:
    """figure, page, panel, patch of whole panels."""

    def make(row) -> Iterator[tuple]:
        yield row.figure, row.page, row.panel, kernels.descriptor(image_of(row), (size, size), pad=0).astype("<f4").tobytes()

    return each_row(crops.select("figure", "page", "panel", "height", "width", "pixels"), "figure int, page int, panel string, patch binary", make)


def oriented(patches: DataFrame, pairs: DataFrame, shape: tuple[int, int], turns: tuple[str, ...]) -> DataFrame:
    """pairs: figure, page, a, b (names of patches of the figure) -> with score and orientation: the best over the turns of b, the first on ties.

    patches: figure, page, name, patch. A figure has at most 26 panels of 48 strips, so its patches fit in a task. Turning
    the patch equals turning the crop before: stretching and resizing treat both directions alike.
    """

    def score(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        patch = {n: np.frombuffer(p, "<f4").reshape(shape).astype(float) for n, p in zip(held["name"], held["patch"])}
        turned: dict[str, dict[str, np.ndarray]] = {}
        best = []
        for a, b in zip(wanted["a"], wanted["b"]):
            each = turned.setdefault(b, {t: kernels.TRANSFORMS[t](patch[b]) for t in turns})
            best.append(kernels.best_orientation(patch[a], each))
        return wanted.assign(score=[s for s, _ in best], orientation=[o for _, o in best])[["figure", "page", "a", "b", "score", "orientation"]]

    key = ["figure", "page"]
    schema = "figure int, page int, a string, b string, score double, orientation string"
    return pairs.select(*key, "a", "b").groupBy(*key).cogroup(patches.select(*key, "name", "patch").groupBy(*key)).applyInPandas(score, schema)


def context_scores(pairs: DataFrame, crops: DataFrame, margin: int = 10, size: tuple[int, int] = (220, 80)) -> DataFrame:
    """pairs: figure, page, a, b, panel_a, panel_b, box_a, box_b, orientation -> figure, page, a, b, context: the score of both with their surroundings; 0 without a margin."""
    key = ["figure", "page"]
    if margin <= 0:
        return pairs.select(*key, "a", "b", F.lit(0.0).alias("context"))

    def score(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        images = {r.panel: image_of(r) for r in held.itertuples(index=False)}

        def around(panel: str, b: dict, turn: str) -> np.ndarray:
            g = kernels.gray(images[panel])
            return kernels.descriptor(cropped(g, kernels.padded((b["x0"], b["y0"], b["x1"], b["y1"]), margin, margin, g.shape)), size, turn, pad=None)

        scores = [kernels.ncc(around(r.panel_a, r.box_a, "none"), around(r.panel_b, r.box_b, r.orientation)) for r in wanted.itertuples(index=False)]
        return wanted[["figure", "page", "a", "b"]].assign(context=scores)

    asked = pairs.select(*key, "a", "b", "panel_a", "panel_b", "box_a", "box_b", "orientation").groupBy(*key)
    return asked.cogroup(crops.select(*key, "panel", "height", "width", "pixels").groupBy(*key)).applyInPandas(score, "figure int, page int, a string, b string, context double")
