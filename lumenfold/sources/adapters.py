"""What outside tools read: pages of PDF files, with the fitz module, and words in images, with Tesseract.

Both run on the executors, a file or an image at a time, and both are optional: without fitz reading a PDF is an
error that says so; without Tesseract no image has words.
"""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kernels
from ..operators.segmentation import IMAGE, each_row, image_of, image_row
from .readers import CAPTION, TITLE

# Where Tesseract may be beside the path, and the languages it is asked for, in order.
TESSERACT = ("/opt/homebrew/bin/tesseract", "/usr/local/bin/tesseract")
LANGUAGES = ("eng", "chi_sim", "chi_tra")


def has_pdf() -> bool:
    return importlib.util.find_spec("fitz") is not None


def need_pdf(backend: str = "auto") -> None:
    """backend: auto or pymupdf, which are one here; the swift backend needs another system's tools."""
    if backend not in ("auto", "pymupdf"):
        raise ValueError(f"no PDF backend {backend!r}: auto and pymupdf are supported")
    if not has_pdf():
        raise RuntimeError("reading a PDF needs the fitz module (PyMuPDF) on the driver and all executors")


def find_tesseract() -> str | None:
    return shutil.which("tesseract") or next((p for p in TESSERACT if os.path.exists(p)), None)


def tesseract_languages(program: str) -> set[str]:
    said = subprocess.run([program, "--list-langs"], capture_output=True, text=True, check=False)
    return set(said.stdout.split()) if said.returncode == 0 else set()


def preferred_languages(known: set[str]) -> str:
    return "+".join(x for x in LANGUAGES if x in known) or LANGUAGES[0]


def missing_tools(pdf: bool) -> list[str]:
    """What isn't there, as notes; nothing of it stops a run on images."""
    notes = [] if not pdf or has_pdf() else ["fitz (PyMuPDF) is missing: PDF files can't be read"]
    if (program := find_tesseract()) is None:
        return [*notes, "tesseract is missing: panels are lettered in reading order and rows have no names"]
    if gone := sorted({*LANGUAGES[1:]} - tesseract_languages(program)):
        notes.append(f"tesseract has no data for {', '.join(gone)}")
    return notes


def parsed_words(raw: DataFrame, keys: list[str], scale: float = 2.0) -> DataFrame:
    """raw: keys and the columns of Tesseract's table as text -> keys, w (order), text, conf, wbox at the scale of the image."""
    number = lambda c: F.col(c).try_cast("double")
    at = lambda v: (v / scale).cast("int")
    x, y, w, h = (number(c) for c in ("left", "top", "width", "height"))
    kept = raw.where((F.trim("text") != "") & (number("conf") >= 0) & x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull())
    return kept.select(*keys, "w", F.trim("text").alias("text"), number("conf").alias("conf"), F.struct(at(x).alias("x0"), at(y).alias("y0"), at(x + w).alias("x1"), at(y + h).alias("y1")).alias("wbox"))


def ocr_words(figures: DataFrame, scale: float = 2.0, mode: int = 11) -> DataFrame:
    """figures: figure, page and their images -> figure, page, w, text, conf, wbox; nothing where Tesseract is missing or fails."""
    fields = ("text", "conf", "left", "top", "width", "height")

    def make(row) -> Iterator[tuple]:
        if (program := find_tesseract()) is None:
            return
        g = kernels.autocontrast(kernels.gray(image_of(row)))
        big = kernels.resize(g, (max(1, int(row.width * scale)), max(1, int(row.height * scale)))).astype(np.uint8)
        with tempfile.TemporaryDirectory() as folder:  # seen by this process and its child only
            path = os.path.join(folder, "figure.pgm")
            with open(path, "wb") as f:
                f.write(b"P5 %d %d 255\n" % (big.shape[1], big.shape[0]) + big.tobytes())
            said = subprocess.run([program, path, "stdout", "--psm", str(mode), "-l", preferred_languages(tesseract_languages(program)), "tsv"], capture_output=True, text=True, check=False)
        lines = [x.split("\t") for x in said.stdout.splitlines()] if said.returncode == 0 else []
        if lines and set(fields) <= set(lines[0]):
            for k, cells in enumerate(lines[1:]):
                if len(cells) >= len(lines[0]):
                    named = dict(zip(lines[0], cells))
                    yield row.figure, row.page, k, *[named[f] for f in fields]

    raw = each_row(figures, "figure int, page int, w int, " + ", ".join(f"{f} string" for f in fields), make)
    return parsed_words(raw, ["figure", "page"], scale)


def match_places(text: Column, pattern: str) -> Column:
    """array<struct<text, at>>: all matches of a pattern in a text, and where each begins."""
    found, apart = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(found, lambda m, k: F.struct(m.alias("text"), (total(F.slice(apart, 1, k + 1)) + total(F.slice(found, 1, k))).alias("at")))


def line_matches(lines: DataFrame) -> DataFrame:
    """lines: page, width, height, n (order), text, x0, y0, x1, y1 (points, from the top) -> page, width, height, kind, text, index, x, y, w, h: titles and captions, y from the bottom, as in layout files."""
    text = F.trim("text")
    kept = lines.withColumn("text", text).where(F.col("text") != "")
    before = Window.partitionBy("page").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), match_places(F.col("text"), p).alias("found")) for kind, p in (("figure_title", TITLE), ("panel_caption", CAPTION))])
    each = kept.withColumn("k", F.explode(kinds)).withColumn("m", F.explode("k.found"))
    return each.select(
        "page", "width", "height", "k.kind", F.col("m.text").alias("text"), (F.col("offset") + F.col("m.at")).cast("int").alias("index"), F.col("x0").alias("x"), (F.col("height") - F.col("y1")).alias("y"),
        F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")).alias("w"), F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")).alias("h"),
    )


def _pages(spark: SparkSession, path: str, pages: list[int] | None, schema: str, read) -> DataFrame:
    """A row for each page number of the file, read on the executors: each task opens the file and goes to its page."""
    need_pdf()
    file = spark.read.format("binaryFile").load(path).select("content")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame({"page": range(1, fitz.open(stream=content, filetype="pdf").page_count + 1), "content": content})

    def make(row) -> Iterator[tuple]:
        import fitz

        yield from read(row.page, fitz.open(stream=row.content, filetype="pdf")[row.page - 1])

    listed = file.mapInPandas(count, "page int, content binary")
    return each_row(listed if pages is None else listed.where(F.col("page").isin(pages)), schema, make)


def pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """page, width, height, n, text, x0, y0, x1, y1 of every line of a PDF's text layer."""

    def read(number: int, page) -> Iterator[tuple]:
        lines = (line for b in page.get_text("dict").get("blocks", []) if b.get("type") == 0 for line in b.get("lines", []))
        for n, line in enumerate(lines):
            yield number, float(page.rect.width), float(page.rect.height), n, "".join(s.get("text", "") for s in line.get("spans", [])), *map(float, line["bbox"])

    return _pages(spark, path, None, "page int, width double, height double, n int, text string, x0 double, y0 double, x1 double, y1 double", read)


def pdf_pages(spark: SparkSession, path: str, dpi: int, pages: list[int] | None = None) -> DataFrame:
    """page and its image at the resolution, without transparency."""

    def read(number: int, page) -> Iterator[tuple]:
        import fitz

        p = page.get_pixmap(matrix=fitz.Matrix(dpi / 72.0, dpi / 72.0), alpha=False)
        a = np.frombuffer(p.samples, np.uint8).reshape(p.height, p.stride)[:, : p.width * p.n].reshape(p.height, p.width, p.n)
        yield number, *image_row(np.repeat(a, 3, axis=2) if p.n == 1 else a[:, :, :3])

    return _pages(spark, path, pages, f"page int, {IMAGE}", read)
