"""The screening from files to reports, on planted images."""

import json

import numpy as np
import pytest
from lumenfold import cli
from lumenfold.operators import figures, panels, screening, segmentation
from lumenfold.operators.screening import Settings
from lumenfold.sources import adapters, readers, sinks
from pyspark.sql import functions as F


def blot(seed, height=180, width=300):
    """A grey field with three rows of bands, on white."""
    rnd = np.random.default_rng(seed)
    out = np.full((height, width), 255, np.uint8)
    out[8:-8, 8:-8] = 205 + rnd.integers(0, 8, (height - 16, width - 16))
    for y in (45, 90, 135):
        for x in range(40, width - 50, 45):
            w, h = int(rnd.integers(16, 26)), int(rnd.integers(6, 11))
            out[y - h // 2 : y + h // 2, x : x + w] = rnd.integers(40, 130, (h // 2 * 2, w))
    return out


def figure(seed=3):
    """Two blots, the second one a copy of the first, and two textured panels, one the other mirrored."""
    out = np.full((520, 760, 3), 255, np.uint8)
    a = blot(seed)
    out[30:210, 30:330] = a[..., None]
    out[30:210, 420:720] = a[..., None]
    rnd = np.random.default_rng(seed)
    t = np.kron(rnd.integers(0, 230, (16, 24)), np.ones((10, 10))).astype(np.uint8)
    out[300:460, 50:290], out[300:460, 440:680] = t[..., None], np.fliplr(t)[..., None]
    return out


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("screen")
    (folder / "f.png").write_bytes(sinks.png(figure()))
    o = cli.options(cli.parser().parse_args([f"{folder}/f.png", "--out", f"{folder}/out", "--compare-other-panels", "--min-aggregate-context-score", "0.3"]))
    return folder / "out", cli.run(spark, [f"file://{folder}/f.png"], f"{folder}/out", o)


def test_planted_copies_are_reported(result):
    out, tables = result
    assert sorted((r["panel"], r["category"]) for r in tables["panels"].collect()) == [("A", "blot"), ("B", "blot"), ("C", "other"), ("D", "other")]
    best = tables["matches"].collect()
    assert best and best[0]["score"] > 0.99 and {r["panel_a"] + r["panel_b"] for r in best} == {"AB"}
    found = tables["panel_matches"].collect()
    assert [(r["panel_a"], r["panel_b"], r["orientation"]) for r in found] == [("C", "D", "h")] and found[0]["score"] > 0.99
    groups = tables["aggregates"].collect()
    assert groups and all(r["match_count"] >= 2 and r["panel_a"] == "A" and r["review_status"] == "not-run" for r in groups)


def test_counters_add_up(result):
    _, tables = result
    n = {r["name"]: r["n"] for r in tables["counters"].collect()}
    skipped = sum(v for k, v in n.items() if k.startswith("pairs_") and k != "pairs_considered")
    strips = {p: tables["strips"].where(F.col("panel") == p).count() for p in "AB"}
    assert n["pairs_considered"] == strips["A"] * strips["B"] >= skipped
    assert (n["panel_pairs_considered"], n["panel_pairs_skipped_scope"], n["panel_pairs_skipped_blot"]) == (6, 0, 5)


def test_files_of_a_run(result):
    out, tables = result
    doc = json.loads((out / "results.json").read_text())
    assert doc["settings"]["min_score"] == 0.82 and len(doc["matches"]) == tables["matches"].count()
    for name in ("report.md", "report.html", "manual_review_checklist.md", "review.md"):
        assert (out / name).read_text()
    assert len(list((out / "panels").glob("*.png"))) == 4 and len(list((out / "matches").glob("*.png"))) == len(doc["matches"]) + 1
    assert len(list((out / "strips").glob("*.png"))) == tables["strips"].count() and list((out / "aggregates").glob("*.png")) and list((out / "ocr").glob("*.png"))
    with pytest.raises(ValueError, match="clears"):
        sinks.guard_inputs([f"{out}/panels/x.png"], str(out))


def test_figures_with_one_name_in_two_folders(spark, tmp_path):
    for k, value in enumerate((10, 90)):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "same name.png").write_bytes(sinks.png(np.full((20, 30), value, np.uint8)))
    paths = [f"file://{tmp_path}/{k}/same name.png" for k in (1, 0)]
    got = segmentation.decoded(readers.read_images(spark, paths)).orderBy("figure").collect()
    assert [(r["figure"], r["pixels"][0]) for r in got] == [(1, 90), (2, 10)]
    trimmed = segmentation.trimmed(segmentation.decoded(readers.read_images(spark, paths)), only=2).collect()
    assert [(r["figure"], tuple(r["box"])) for r in trimmed] == [(2, (0, 0, 30, 20))]


def test_panel_labels_against_a_loop(spark):
    boxes = [(f, k, 100 * (k % 3), 120 * (k // 3)) for f in (1, 2) for k in range(5)]
    words = [(1, 0, "b", 90.0, 105, 5), (1, 1, "A.", 80.0, 3, 3), (1, 2, "A", 99.0, 203, 130), (1, 3, "C", 20.0, 1, 1), (1, 4, "word", 90.0, 2, 2), (2, 0, "B", 50.0, 0, 0), (2, 1, "B", 50.0, 100, 0)]
    b = spark.createDataFrame(boxes, "figure int, ord int, x int, y int").select("figure", "ord", F.expr("struct(x AS x0, y AS y0, x + 90 AS x1, y + 100 AS y1)").alias("box"))
    w = spark.createDataFrame(words, "figure int, w int, text string, conf double, x int, y int").select("figure", "w", "text", "conf", F.expr("struct(x AS x0, y AS y0, x + 10 AS x1, y + 10 AS y1)").alias("wbox"))

    def loop(figure):
        cost = []
        for _, n, text, conf, x, y in (x for x in words if x[0] == figure):
            letter = "".join(c for c in text if c.isalpha()).upper()
            for _, k, bx, by in (x for x in boxes if x[0] == figure):
                cx, cy = x + 5, y + 5
                if len(letter) == 1 and conf >= 35 and bx - 45 <= cx <= bx + 0.34 * 90 and by - 30 <= cy <= by + 34:
                    cost.append((max(0, cx - bx) + 1.8 * max(0, cy - by) - 0.2 * conf, n, k, letter))
        got = {}
        for _, _, k, letter in sorted(cost):
            if k not in got and letter not in got.values():
                got[k] = letter
        free = [c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in got.values()]
        return {k: (got[k], "ocr") if k in got else (free.pop(0), "row_major") for k in range(5)}

    out = panels.label_panels(b, w, "figure").collect()
    for f in (1, 2):
        assert {r["ord"]: (r["panel"], r["label_source"]) for r in out if r["figure"] == f} == loop(f)
    many = spark.range(30).select(F.lit(1).alias("figure"), F.col("id").cast("int").alias("ord"), F.expr("struct(1 AS x0, 1 AS y0, 2 AS x1, 2 AS y1)").alias("box"))
    names = [r["panel"] for r in panels.label_panels(many, w.where("figure = 9"), "figure").orderBy("ord").collect()]
    assert names[:2] == ["A", "B"] and names[25:] == ["Z", "P27", "P28", "P29", "P30"]


def test_protein_rows(spark):
    p = spark.createDataFrame([("A", (10, 10, 200, 190), 300, [40.0, 90.0]), ("B", None, 100, [])], "panel string, region struct<x0:int,y0:int,x1:int,y1:int>, width int, centers array<double>")
    said = [("A", 0, "TBK1", 90.0, 210, 36), ("A", 1, "STING", 60.0, 210, 30), ("A", 2, "actin", 80.0, 210, 150), ("A", 3, "ACTIN", 80.0, 215, 158), ("A", 4, "GAPDH", 10.0, 210, 80), ("A", 5, "GAPDH", 90.0, 20, 86), ("B", 0, "cGAS", 30.0, 80, 7)]
    w = spark.createDataFrame(said, "panel string, w int, text string, conf double, x int, y int").select("panel", "w", "text", "conf", F.expr("struct(x AS x0, y AS y0, x + 20 AS x1, y + 8 AS y1)").alias("wbox"))
    rows = panels.protein_rows(p, w, ["panel"])
    got = sorted((r["panel"], r["row_index"], r["row_label"], r["center_y"], r["source"]) for r in rows.collect())
    assert got == [("A", 0, "TBK1", 40.0, "ocr"), ("A", 1, None, 90.0, "image"), ("A", 2, "actin", 154.0, "ocr"), ("B", 0, "cGAS", 11.0, "ocr")]
    strips = spark.createDataFrame([("A", 1, 30, 48), ("A", 2, 110, 116), ("A", 3, 88, 90)], "panel string, strip_index int, y0 int, y1 int").select("panel", "strip_index", F.expr("struct(0 AS x0, y0, 9 AS x1, y1)").alias("box"))
    near = {r["strip_index"]: (r["row_index"], r["row_label"], r["row_distance"]) for r in panels.strip_rows(strips, rows, ["panel"]).collect()}
    assert near == {1: (0, "TBK1", 1.0), 2: (None, None, 23.0), 3: (1, None, 1.0)}


def test_figures_of_a_layout(spark):
    lines = [(1, 600.0, 800.0, 0, "Supplementary Figure 9.", 50.0, 10.0, 90.0, 20.0), (1, 600.0, 800.0, 1, "See Figure 2. ok", 50.0, 60.0, 300.0, 72.0), (1, 600.0, 800.0, 2, "A. one B-C. two", 50.0, 400.0, 300.0, 410.0),
             (2, 600.0, 800.0, 0, "Figure 3", 50.0, 100.0, 90.0, 112.0), (2, 600.0, 800.0, 1, "A. right", 300.0, 300.0, 350.0, 310.0), (2, 600.0, 800.0, 2, "Figure 4", 50.0, 720.0, 90.0, 740.0)]
    m = adapters.line_matches(spark.createDataFrame(lines, "page int, width double, height double, n int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r["page"], r["index"], r["text"]) for r in m.collect()) == [(1, 0, "Supplementary Figure 9."), (1, 28, "Figure 2."), (1, 41, "A."), (1, 48, "B-C."), (2, 0, "Figure 3"), (2, 9, "A."), (2, 18, "Figure 4")]
    got = sorted(tuple(r) for r in figures.discover_figures(m, 72).collect())
    assert got == [(2, 1, 84, 392), (3, 2, 124, 720)]
    assert figures.discover_figures(m, 72, 3).count() == 1
    if not adapters.has_pdf():
        with pytest.raises(RuntimeError, match="fitz"):
            adapters.pdf_lines(spark, "x.pdf")


def test_reading_order_and_crops(spark):
    b = spark.createDataFrame([(1, 0, 200, 10, 80), (1, 1, 0, 20, 90), (1, 2, 0, 200, 300), (1, 3, 100, 0, 120)], "figure int, id int, x int, y0 int, y1 int").select("figure", "id", F.expr("struct(x AS x0, y0, x + 50 AS x1, y1)").alias("box"))
    assert [r["id"] for r in panels.row_major(b, "figure").orderBy("ord").collect()] == [1, 3, 0, 2]
    page = figure()
    pages = spark.createDataFrame([(4, *segmentation.image_row(page))], "page int, height int, width int, pixels binary")
    specs = spark.createDataFrame([(1, 4, 0, 250), (2, 4, 212, 240), (3, 5, 0, 99)], "figure int, page int, crop_top int, crop_bottom int")
    assert [(r["figure"], tuple(r["box"])) for r in segmentation.crop_figures(specs, pages).collect()] == [(1, (29, 29, 721, 211))]


def test_reviews_that_cannot_be_read(spark, tmp_path):
    groups = spark.createDataFrame([("x",), ("y",)], "aggregate_id string")
    assert {r["review_status"] for r in cli.reviewed(spark, groups, str(tmp_path / "none.json")).collect()} == {"error"}
    (tmp_path / "r.json").write_text(json.dumps([{"aggregate_id": "x", "status": " Supports ", "confidence": 2}, {"aggregate_id": "y", "status": "error"}]))
    assert {r["aggregate_id"]: (r["review_status"], r["review_confidence"]) for r in cli.reviewed(spark, groups, str(tmp_path / "r.json")).collect()} == {"x": ("supports", 1.0), "y": ("uncertain", None)}


def test_all_figures_scope(spark, tmp_path):
    rows = []
    for f, seed in ((1, 5), (2, 5), (3, 6)):
        t = np.kron(np.random.default_rng(seed).integers(0, 230, (10, 12)), np.ones((10, 10))).astype(np.uint8)
        rows.append((f, f, "A", *segmentation.image_row(np.dstack([t] * 3))))
    crops = spark.createDataFrame(rows, "figure int, page int, panel string, height int, width int, pixels binary")
    p = crops.select("figure", "page", "panel", F.lit(0).alias("ord"), F.lit("other").alias("category"), F.expr("struct(0 AS x0, 0 AS y0, width AS x1, height AS y1)").alias("box"))
    how = Settings(all_figures=True)
    pairs, counts = screening.panel_candidates(p, how)
    found = screening.panel_matches(pairs, segmentation.panel_patches(crops), how)
    assert [(r["figure_a"], r["figure_b"], r["score"]) for r in found.collect()] == [(1, 2, 1.0)]
    assert {r["name"]: r["n"] for r in screening.panel_counters(counts, pairs, found).collect()} == {"panel_pairs_considered": 3, "panel_pairs_skipped_scope": 0, "panel_pairs_skipped_blot": 0, "panel_pairs_skipped_area_ratio": 0, "panel_pairs_below_score": 2}
