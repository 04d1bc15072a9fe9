"""Review images: panels side by side with what was found in them outlined. Captions are in the tables; there is no font here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .segmentation import each_row

# Colours of a strip, a row, and the pieces of evidence in turn; colours of labels by where they come from, and of words.
STRIP, ROW = (220, 0, 0), (0, 114, 178)
EVIDENCE = ((213, 94, 0), (0, 158, 115), (204, 121, 167), (230, 159, 0), (86, 180, 233))
LABELS, WORD = {"ocr": (0, 114, 178), "row_major": (80, 80, 80)}, (232, 140, 0)


def outline(image: np.ndarray, b: kernels.Box, color: tuple[int, int, int], width: int = 4) -> None:
    """Draws a frame inside the box, in place."""
    x0, y0, x1, y1 = b
    for part in (image[y0 : y0 + width, x0:x1], image[max(y0, y1 - width) : y1, x0:x1], image[y0:y1, x0 : x0 + width], image[y0:y1, max(x0, x1 - width) : x1]):
        part[...] = color


def beside(images: list[np.ndarray], gap: int = 30) -> np.ndarray:
    """On white, from left to right."""
    out = np.full((max(i.shape[0] for i in images), sum(i.shape[1] for i in images) + gap * (len(images) - 1), 3), 255, np.uint8)
    at = 0
    for i in images:
        out[: i.shape[0], at : at + i.shape[1]] = i
        at += i.shape[1] + gap
    return out


def below(images: list[np.ndarray], gap: int = 20) -> np.ndarray:
    return beside([np.swapaxes(i, 0, 1) for i in images], gap).swapaxes(0, 1)


def thumbnail(image: np.ndarray, width: int = 160, height: int = 34) -> np.ndarray:
    """No larger than given, in its own proportions."""
    scale = min(1.0, width / image.shape[1], height / image.shape[0])
    size = max(1, int(image.shape[1] * scale)), max(1, int(image.shape[0] * scale))
    return np.dstack([kernels.resize(image[..., c], size).astype(np.uint8) for c in range(3)])


def pair_images(pairs: DataFrame, crops: DataFrame) -> DataFrame:
    """pairs: name, figure_a, page_a, panel_a, figure_b, page_b, panel_b, boxes_a, boxes_b (struct of box and colour, in order of pairs), rows_a, rows_b (boxes or null), orientation -> name, content (PNG).

    A few rows: what a report shows.
    """
    from ..sources.sinks import png

    def make(row) -> Iterator[tuple]:
        views, thumbs = [], []
        for s in "ab":
            size = getattr(row, f"height_{s}"), getattr(row, f"width_{s}"), 3
            clean = np.frombuffer(getattr(row, f"pixels_{s}"), np.uint8).reshape(size)
            view = clean.copy()
            if (r := getattr(row, f"row_{s}")) is not None:
                outline(view, (r["x0"], r["y0"], r["x1"], r["y1"]), ROW, 3)
            boxes = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in getattr(row, f"boxes_{s}")]
            for k, b in enumerate(boxes):
                outline(view, b, EVIDENCE[k % len(EVIDENCE)] if len(boxes) > 1 else STRIP)
            thumbs.append([thumbnail(clean[b[1] : b[3], b[0] : b[2]]) for b in boxes])
            views.append(kernels.TRANSFORMS[row.orientation](view) if s == "b" and not boxes else view)
        rows = [beside([a, b]) for a, b in zip(*thumbs)]
        yield row.name, png(below([beside(views), *rows]))

    out = pairs
    for s in "ab":
        held = crops.select(*[F.col(c).alias(f"{c}_{s}") for c in ("figure", "page", "panel", "height", "width", "pixels")])
        out = out.join(held, [f"figure_{s}", f"page_{s}", f"panel_{s}"])
    return each_row(out, "name string, content binary", make)


def overlays(figures: DataFrame, panels: DataFrame, words: DataFrame) -> DataFrame:
    """name, content: each figure with its panels, coloured by where their letters come from, and its words of confidence 35 or more."""
    from ..sources.sinks import png

    key = ["figure", "page"]
    p = panels.groupBy(*key).agg(F.collect_list(F.struct("box", "label_source")).alias("panels"))
    w = words.where("conf >= 35").groupBy(*key).agg(F.collect_list("wbox").alias("words"))

    def make(row) -> Iterator[tuple]:
        image = np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3).copy()
        corners = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
        for b in row.words if row.words is not None else ():
            outline(image, corners(b), WORD, 2)
        for x in row.panels if row.panels is not None else ():
            outline(image, corners(x["box"]), LABELS[x["label_source"]], 3)
        yield f"figure-{row.figure}_page-{row.page:03d}_overlay.png", png(image)

    return each_row(figures.select(*key, "height", "width", "pixels").join(p, key, "left").join(w, key, "left"), "name string, content binary", make)
