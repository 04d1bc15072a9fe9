import html
import json
from pathlib import Path

from lumenfold.functions.render import escaped, optional_number
from lumenfold.sources import sinks
from pyspark.sql import functions as F


def test_render(spark):
    texts = ["a<b>&amp;\"'", "", None, "x|y\nz"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(escaped(F.col("t"))).collect()]
    assert got == [t and html.escape(t) if t is not None else None for t in texts]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (None,)], "x double").select(optional_number(F.col("x"))).collect()] == ["0.5000", "n/a"]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("A|b", 0.9, "<i>"), ("C", 0.95, None), ("D", 0.1, "two\nlines")], "aggregate_id string, score double, note string")
    s = sinks.Section("Best", rows, {"id": F.col("aggregate_id"), "score": optional_number(F.col("score")), "note": F.col("note")}, [F.desc("score")], 2)
    empty = sinks.Section("Nothing", rows.where("false"), {"id": F.col("aggregate_id")}, ["aggregate_id"])
    sinks.write_report(spark, f"file://{tmp_path}", "A & B", {"rows": 3}, [s, empty])
    md, page = (Path(tmp_path) / "report.md").read_text(), (Path(tmp_path) / "report.html").read_text()
    assert md.splitlines()[6:10] == ["| id | score | note |", "|-|-|-|", "| C | 0.9500 |  |", "| A\\|b | 0.9000 | <i> |"]
    assert "none" in md and "<p>none</p>" in page and "&lt;i&gt;" in page and "A &amp; B" in page and "two" not in page


def test_tables_and_review_package(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0.9, None), ("B", 0.95, 1)], "aggregate_id string, score double, n int")
    sinks.write_tables({"all": rows}, f"file://{tmp_path}")
    assert sorted(json.loads(x)["aggregate_id"] for p in tmp_path.glob("all/*.json") for x in p.read_text().splitlines()) == ["A", "B"]
    sinks.write_review_package(rows, f"file://{tmp_path}", F.format_string("Look at %s", "aggregate_id"), [F.desc("score")], 1)
    assert [json.loads(x)["prompt"] for p in tmp_path.glob("review/*.json") for x in p.read_text().splitlines()] == ["Look at B"]
    panels = spark.createDataFrame([("ocr", 1, 2), ("row_major", None, 3)], "label_source string, text_filtered int, small_filtered int")
    assert sinks.panel_totals(panels).first().asDict() == {"panels": 2, "ocr_labels": 1, "text_filtered": 1, "small_filtered": 5}
    assert sinks.panel_totals(panels.where("false")).first().asDict() == {"panels": 0, "ocr_labels": 0, "text_filtered": 0, "small_filtered": 0}
