"""Results as tables of JSON lines, and the first rows of them as a report in Markdown and HTML."""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import figure_name
from ..functions.render import escaped, html_row, markdown_row


@dataclass(frozen=True)
class Section:
    """A heading, its table, the columns to show by name, and the order; most: rows shown, as a top-k report."""

    title: str
    rows: DataFrame
    columns: dict[str, Column]
    order: list
    most: int = 40


def write_tables(tables: dict[str, DataFrame], out: str) -> None:
    """Every row of every table, each as out/name in JSON lines."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/{name}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def panel_totals(panels: DataFrame) -> DataFrame:
    """panels: label_source, text_filtered, small_filtered. One row: panels, ocr_labels, and the sums of what was filtered."""
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("text_filtered", "small_filtered")]
    return panels.agg(F.count("*").alias("panels"), F.count_if(F.col("label_source") == "ocr").alias("ocr_labels"), *total)


def write_report(spark: SparkSession, out: str, title: str, counts: dict[str, int], sections: list[Section]) -> None:
    """out/report.md and out/report.html. At most `most` rendered rows of a section come to the driver; empty sections say none."""
    md, html = [f"# {title}", "", *[f"- {k}: {v}" for k, v in counts.items()]], []
    name = spark.range(1).select(escaped(F.lit(title))).first()[0]
    listed = "".join(f"<li>{k}: {v}</li>" for k, v in counts.items())
    for s in sections:
        cells = list(s.columns.values())
        shown = s.rows.orderBy(*s.order).limit(s.most).select(markdown_row(cells).alias("md"), html_row(cells).alias("html")).collect()
        md += ["", f"## {s.title}", ""]
        md += ["| " + " | ".join(s.columns) + " |", "|-" * len(cells) + "|", *[r["md"] for r in shown]] if shown else ["none"]
        head = "<tr>" + "".join(f"<th>{c}</th>" for c in s.columns) + "</tr>"
        html.append(f"<h2>{s.title}</h2>" + ("<table>" + "\n".join([head, *[r["html"] for r in shown]]) + "</table>" if shown else "<p>none</p>"))
    write_text(spark, f"{out}/report.md", "\n".join(md) + "\n")
    write_text(spark, f"{out}/report.html", f'<!doctype html><meta charset="utf-8"><title>{name}</title><h1>{name}</h1><ul>{listed}</ul>\n' + "\n".join(html) + "\n")


# The folders a run clears, what a review must say, and the prompt of a review task.
CLEARED = ("figures", "panels", "strips", "matches", "aggregates", "ocr")
REVIEW = {
    "aggregate_id": "string", "status": "supports | uncertain | does_not_support", "confidence": "number from 0 to 1", "rationale": "brief visual rationale", "checked_image": "relative review image path",
    "model": "optional model or agent name",
}
PROMPT = (
    "Review this Western blot/gel image-duplication evidence aggregate with a vision-capable model. Use the aggregate review image, not only the numeric scores. The image shows two figure panels, a blue protein-row box, "
    "colored local evidence boxes, and local evidence thumbnails. Assess whether the highlighted local patches visually support suspicious localized reuse in the same protein row. Do not claim misconduct. Do not claim "
    "whole-row duplication unless the full-row diagnostic score and visible row context support it. Return JSON only with keys: aggregate_id, status, confidence, rationale, checked_image. "
    "Allowed status values: supports, uncertain, does_not_support. Confidence must be 0 to 1. "
)


def review_prompt(image: Column) -> Column:
    """The text of a review task, from the columns of an aggregate and the path of its image."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    parts = {
        "aggregate_id": text("aggregate_id"), "checked_image": image, "figure": figure_name(F.col("figure")), "panels": F.concat("panel_a", F.lit(" vs "), "panel_b"),
        "row": F.coalesce(F.nullif("row_label", F.lit("")), text("row_index_a")), "independent_local_matches": text("match_count"), "raw_pairwise_matches": text("raw_match_count"),
        **{n: text(n) for n in ("top_score", "mean_top_score", "mean_context_score", "dominant_orientation", "lane_offset_std", "full_row_score")},
    }
    return F.concat(F.lit(PROMPT), F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()]), F.lit("."))


def guard_inputs(paths: list[str], out: str) -> None:
    """Refuses inputs that lie in a folder which the run clears."""
    plain = lambda p: posixpath.normpath(p.removeprefix("file://"))
    lost = [p for p in paths if any(plain(p).startswith(f"{plain(out)}/{name}/") for name in CLEARED)]
    if lost:
        raise ValueError(f"these inputs lie in folders that the run clears: {', '.join(lost)}; move them or choose another output folder")


def write_review_package(aggregates: DataFrame, out: str, prompt: Column, order: list, most: int = 5, image: Column | None = None) -> DataFrame:
    """The first `most` aggregates (0: all) as review tasks under out/review, before any review, and as one page of Markdown: aggregate_id, review_image, prompt, aggregate."""
    ranked = aggregates.orderBy(*order)
    picture = F.lit("") if image is None else image
    tasks = (ranked.limit(most) if most else ranked).select("aggregate_id", picture.alias("review_image"), prompt.alias("prompt"), F.struct(*aggregates.columns).alias("aggregate"))
    tasks.write.mode("overwrite").json(f"{out}/review")
    spark, lines = aggregates.sparkSession, ["# Evidence review tasks", "", "Answer each with JSON of this form:", "", "```json", json.dumps(REVIEW, indent=1), "```", ""]
    for r in tasks.toLocalIterator():
        lines += [f"## {r['aggregate_id']}", "", f"Image: `{r['review_image']}`", "", r["prompt"], ""]
    write_text(spark, f"{out}/review.md", "\n".join(lines))
    return tasks


# What a reader checks by hand, by heading.
CHECKLIST = {
    "Check for": (
        "Whole-image duplication: the same panel under different labels or conditions.", "Transformed reuse: mirrored, flipped, rotated, scaled, cropped or recoloured.",
        "Local cloning: repeated cells, tissue, colonies, scratches, bubbles, dust or background.", "Splicing that isn't declared: lane joins, steps in the background, mismatched exposure.",
        "Selective enhancement or concealment: erased, smoothed or painted regions, uneven noise.", "Relabelling: the same content for another sample, antibody, time or genotype.",
        "Plot reuse: identical dot clouds, histograms, gates or traces under changed labels.",
    ),
    "False positives": (
        "Captions and methods may disclose shared controls, representative images or composite borders.", "Labels, axes, legends, scale bars and markers repeat without the content repeating.",
        "Tiny blobs, blank background, compression artefacts and very simple bands count little.", "Neighbouring fields need repeated structure and repeated noise before they are reported.",
    ),
    "Reporting": (
        "Name the kind of anomaly in cautious words: a suspicious reuse candidate, or one that requires manual review.", "Cite figure, panel, page, condition, score, transform and the path of the evidence image.",
        "Keep image observations apart from statistical ones.", "Infer no intent; ask for raw images where the evidence matters.",
    ),
}


def write_checklist(spark: SparkSession, out: str, n_matches: int, n_panel_matches: int) -> None:
    lines = ["# Manual checklist", "", "The output is a triage, not a conclusion.", "", "## Review first", "", f"- {n_matches} local candidates of blots", f"- {n_panel_matches} candidates of whole panels"]
    for title, items in CHECKLIST.items():
        lines += ["", f"## {title}", "", *[f"- {x}" for x in items]]
    write_text(spark, f"{out}/manual_review_checklist.md", "\n".join(lines) + "\n")


def png(image: np.ndarray) -> bytes:
    """An RGB or gray image as a PNG file."""
    h, w = image.shape[:2]
    rows = np.ascontiguousarray(image).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def write_files(files: DataFrame, folder: str) -> None:
    """files: name, content (bytes). Executors write each row as a file of the folder, under another name until it is whole."""

    def write(rows: Iterator) -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for r in rows:
            with store.open_output_stream(f"{path}/.{r['name']}") as f:
                f.write(bytes(r["content"]))
            store.move(f"{path}/.{r['name']}", f"{path}/{r['name']}")

    spark = files.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(at, True)
    system.mkdirs(at)
    files.select("name", "content").foreachPartition(write)
