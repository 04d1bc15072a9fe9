"""The whole screening of figures, from files to a report: python -m lumenfold.cli FILE... --out FOLDER."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import aggregate_image_name, figure_name
from .functions.render import optional_number
from .operators import drawing, evidence, figures, panels, screening, segmentation, spatial
from .operators.screening import Settings
from .sources import adapters, readers, sinks

log = logging.getLogger("lumenfold")
KEY, PANEL = ["figure", "page"], ["figure", "page", "panel"]


@dataclass(frozen=True)
class Options:
    """What a run takes beside the thresholds."""

    dpi: int = 180
    figure: int | None = None
    review_package: bool = True
    review_json: str | None = None
    max_reviews: int = 5
    compare_other_panels: bool = False
    keep_existing: bool = False
    pdf_backend: str = "auto"
    how: Settings = field(default_factory=Settings)


class Store:
    """The tables of a run, each written under out/tables and read again, so that nothing is computed twice."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.out}/tables/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.out}/tables/{name}")

    def held(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/tables/{name}/_SUCCESS")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.out}/tables/{name}") if there else None


def load_figures(spark: SparkSession, inputs: list[str], store: Store, o: Options) -> DataFrame:
    """figure, page, box and the image of every figure."""
    if readers.input_kind(inputs) == "image":
        return store.write(segmentation.trimmed(segmentation.decoded(readers.read_images(spark, inputs)), only=o.figure), "figures")
    kept = (lambda name: store.held(name)) if o.keep_existing else (lambda name: None)
    layout = kept("layout")
    if layout is None:
        adapters.need_pdf(o.pdf_backend)
        layout = store.write(adapters.line_matches(adapters.pdf_lines(spark, inputs[0])), "layout")
    specs = store.write(figures.discover_figures(layout, o.dpi, o.figure), "figure_specs")
    if specs.isEmpty():
        raise RuntimeError("the text layer of the PDF names no figure that can be cropped")
    pages = kept("pages")
    if pages is None:
        pages = store.write(adapters.pdf_pages(spark, inputs[0], o.dpi, sorted(r["page"] for r in specs.select("page").distinct().collect())), "pages")
    return store.write(segmentation.crop_figures(specs, pages, o.dpi), "figures")


def segment(store: Store, found: DataFrame, o: Options) -> dict[str, DataFrame]:
    """Panels, their crops, protein rows and strips of all figures."""
    how, by = o.how, F.struct(*KEY).alias("key")
    words = store.write(adapters.ocr_words(found), "words")
    boxes = segmentation.panel_boxes(found).select(by, "ord", "box")
    labelled = store.write(panels.label_panels(boxes, words.select(by, "w", "text", "conf", "wbox"), "key").select("key.*", "ord", "box", "panel", "label_source", "label_confidence"), "panel_boxes")
    crops = store.write(segmentation.panel_crops(found, labelled), "crops")
    inner = spatial.words_in_boxes(labelled.select(by, F.col("panel").alias("id"), "box"), words.select(by, "w", "text", "conf", "wbox"), "key")
    inner = store.write(inner.select("key.*", F.col("id").alias("panel"), "w", "text", "conf", "wbox"), "panel_words")
    rows = panels.protein_rows(crops.where("category = 'blot'").select(*PANEL, "region", "width", "centers"), inner, PANEL)
    rows = store.write(panels.propagated_rows(store.write(rows, "rows_read"), PANEL), "rows")
    raw = segmentation.raw_strips(crops, how.min_patch_width, how.min_patch_height)
    judged = store.write(panels.judged_strips(raw, inner, PANEL, how.min_patch_area, how.min_patch_width, how.min_patch_height), "strip_candidates")
    strips = panels.strip_rows(panels.chosen_strips(judged, PANEL), store.spark.read.parquet(f"{store.out}/tables/rows_read"), PANEL)
    strips = panels.relabelled_strips(strips, rows, PANEL).join(labelled.select(*PANEL, F.col("ord").alias("panel_ord")), PANEL).join(crops.select(*PANEL, "category"), PANEL)
    strips = strips.withColumns({"strip": F.format_string("%s-strip-%02d", "panel", "strip_index"), "ord": F.col("panel_ord") * 1000 + F.col("strip_index")})
    strips = store.write(strips, "strips")
    count = lambda df, name, where="true": df.where(where).groupBy(*PANEL).agg(F.count("*").alias(name))
    counts = [count(inner, "ocr_word_count"), count(strips, "strip_count"), count(judged, "text_filtered", "status = 'text'"), count(judged, "small_filtered", "status = 'small'")]
    listed = rows.groupBy(*PANEL).agg(F.sort_array(F.collect_list(F.struct("row_index", "row_label", "center_y", "source", "confidence"))).alias("protein_rows"))
    out = labelled.join(crops.select(*PANEL, "category", "colorfulness", "horizontal_score"), PANEL)
    for c in counts:
        out = out.join(c, PANEL, "left")
    out = out.fillna(0, ["ocr_word_count", "strip_count", "text_filtered", "small_filtered"]).join(listed, PANEL, "left")
    return {"words": words, "crops": crops, "strips": strips, "panels": store.write(out, "panels")}


def compare(store: Store, s: dict[str, DataFrame], o: Options) -> dict[str, DataFrame]:
    """Matches, aggregates, matches of whole panels, and counters."""
    how, spark = o.how, store.spark
    patches = store.write(segmentation.strip_patches(s["strips"], s["crops"]), "strip_patches")
    pairs = store.write(screening.strip_candidates(s["strips"].select(*PANEL, "strip", "ord", "box", "category", "row_label", "row_index"), how), "strip_pairs")
    scored = store.write(screening.scored_strips(pairs, patches, s["crops"], how), "scored_pairs")
    matches = store.write(screening.best_first(screening.strip_matches(scored), how.top_n), "matches")
    groups = store.write(screening.aggregates(matches, s["strips"], s["panels"], patches, how), "aggregates")
    counters = screening.counters(s["panels"], pairs, scored)
    found = spark.createDataFrame([], "score double")
    if o.compare_other_panels:
        open_, counts = screening.panel_candidates(s["panels"], how)
        open_ = store.write(open_, "panel_pairs")
        every = store.write(screening.panel_matches(open_, store.write(segmentation.panel_patches(s["crops"]), "panel_patches"), how), "all_panel_matches")
        counters = counters.unionByName(screening.panel_counters(counts, open_, every))
        found = store.write(screening.best_panels_first(every, how.top_panel_n), "panel_matches")
    return {"matches": matches, "aggregates": groups, "panel_matches": found, "counters": store.write(counters, "counters")}


def reviewed(spark: SparkSession, groups: DataFrame, path: str | None) -> DataFrame:
    """Aggregates with the reviews of a file; if it can't be read all have the status error and say why."""
    none = {"review_confidence": "double", "review_rationale": "string", "review_model": "string", "review_error": "string"}
    if path is None:
        return groups.withColumns({"review_status": F.lit("not-run"), **{k: F.lit(None).cast(v) for k, v in none.items()}})
    try:
        items = readers.read_reviews(spark, path)
        said = items.select("aggregate_id", "seq", *[c.alias(n) for n, c in evidence.review_columns(*[F.col(x) for x in ("status", "confidence", "rationale", "model", "agent")], F.lit(path)).items()])
        said.first()
    except Exception as error:  # noqa: BLE001 - whatever is wrong with the file is told in the report
        why = F.lit(f"can't read reviews of {path}: {type(error).__name__}")
        return groups.withColumns({"review_status": F.lit("error"), **{k: F.lit(None).cast(v) for k, v in none.items()}, "review_error": why})
    merged = evidence.merge_reviews(groups, said)
    return merged.withColumnsRenamed({c: f"review_{c}" for c in ("status", "confidence", "rationale", "model")}).withColumn("review_error", F.lit(None).cast("string"))


def draw(out: str, found: DataFrame, s: dict[str, DataFrame], r: dict[str, DataFrame]) -> None:
    """Crops of figures, panels and strips, and review images, as files."""
    def pixels(df: DataFrame, name: Column) -> DataFrame:
        make = lambda row: [(row.name, sinks.png(segmentation.image_of(row)))]
        return segmentation.each_row(df.select(name.alias("name"), "height", "width", "pixels"), "name string, content binary", make)

    stem = F.format_string("figure-%d_page-%03d", "figure", "page")
    sinks.write_files(pixels(found, F.concat(stem, F.lit(".png"))), f"{out}/figures")
    sinks.write_files(pixels(s["crops"], F.concat(stem, F.lit("_panel-"), "panel", F.lit(".png"))), f"{out}/panels")
    cut = s["strips"].select(*PANEL, "strip_index", "box.*").join(s["crops"].select(*PANEL, "height", "width", "pixels"), PANEL)
    cut = cut.withColumn("name", F.concat(stem, F.lit("_panel-"), "panel", F.format_string("_strip-%02d.png", "strip_index")))
    make = lambda row: [(row.name, sinks.png(segmentation.cropped(segmentation.image_of(row), (row.x0, row.y0, row.x1, row.y1))))]
    sinks.write_files(segmentation.each_row(cut, "name string, content binary", make), f"{out}/strips")
    sinks.write_files(drawing.overlays(found, s["panels"], s["words"]), f"{out}/ocr")
    none, c = F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>"), F.col
    sides = lambda df: df.withColumns({f"{k}_{x}": c(k) for k in KEY for x in "ab"})
    one = sides(r["matches"]).select(c("review_name").alias("name"), "figure_a", "page_a", "panel_a", "figure_b", "page_b", "panel_b", F.array("box_a").alias("boxes_a"), F.array("box_b").alias("boxes_b"), none.alias("row_a"), none.alias("row_b"), "orientation")
    if "review_name" in r["panel_matches"].columns:
        empty = F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")
        one = one.unionByName(r["panel_matches"].select(c("review_name").alias("name"), "figure_a", "page_a", "panel_a", "figure_b", "page_b", "panel_b", empty.alias("boxes_a"), empty.alias("boxes_b"), none.alias("row_a"), none.alias("row_b"), "orientation"))
    sinks.write_files(drawing.pair_images(one, s["crops"]), f"{out}/matches")
    # the boxes of an aggregate's evidence, in its order
    each = r["aggregates"].select("aggregate_id", *KEY, "panel_a", "panel_b", "row_label", F.posexplode("support_matches").alias("place", "pair"))
    for x, part in (("a", 0), ("b", 1)):
        boxes = s["strips"].select(*KEY, c("panel").alias(f"panel_{x}"), c("strip").alias(f"strip_{x}"), c("box").alias(f"box_{x}"))
        each = each.withColumn(f"strip_{x}", F.split("pair", " vs ")[part]).join(boxes, [*KEY, f"panel_{x}", f"strip_{x}"])
    listed = lambda x: F.transform(F.sort_array(F.collect_list(F.struct("place", f"box_{x}"))), lambda p: p[f"box_{x}"]).alias(f"boxes_{x}")
    many = sides(each.groupBy("aggregate_id", *KEY, "panel_a", "panel_b", "row_label").agg(listed("a"), listed("b")))
    many = many.select(aggregate_image_name(c("figure"), c("row_label"), c("panel_a"), c("panel_b")).alias("name"), "figure_a", "page_a", "panel_a", "figure_b", "page_b", "panel_b", "boxes_a", "boxes_b", none.alias("row_a"), none.alias("row_b"), F.lit("none").alias("orientation"))
    sinks.write_files(drawing.pair_images(many, s["crops"]), f"{out}/aggregates")


def run(spark: SparkSession, inputs: list[str], out: str, o: Options = Options()) -> dict[str, DataFrame]:
    """Screens the files and writes tables, images and reports under `out`. Returns the result tables."""
    kind = readers.input_kind(inputs)
    sinks.guard_inputs(inputs, out)
    for note in adapters.missing_tools(kind == "pdf"):
        log.info(note)
    store = Store(spark, out)
    found = load_figures(spark, inputs, store, o)
    if found.isEmpty():
        raise RuntimeError("no input was selected: is the figure's number right?")
    s = segment(store, found, o)
    r = compare(store, s, o)
    c = F.col
    best = ranked_columns()
    if o.review_package:
        image = F.concat(F.lit("aggregates/"), aggregate_image_name(c("figure"), c("row_label"), c("panel_a"), c("panel_b")))
        sinks.write_review_package(r["aggregates"].withColumn("review_status", F.lit("not-run")), out, sinks.review_prompt(image), best, max(0, o.max_reviews), image)
    r["aggregates"] = store.write(reviewed(spark, r["aggregates"], o.review_json), "reviewed_aggregates")
    draw(out, found, s, r)
    counts = {x["name"]: x["n"] for x in r["counters"].collect()}  # at most twelve rows
    shown = {"figures": found.select(*KEY, "box"), "panels": s["panels"], "strips": s["strips"], "matches": r["matches"], "evidence_aggregates": r["aggregates"], "panel_matches": r["panel_matches"]}
    sinks.write_tables(shown, f"{out}/results")
    settings = {**asdict(o), **asdict(o.how), "input_type": kind, "input_count": len(inputs)}
    del settings["how"]
    totals = sinks.panel_totals(s["panels"]).first().asDict()
    # results.json holds what is bounded by options: the best matches and aggregates; whole tables are beside it
    bounded = {k: [json.loads(x) for x in shown[k].toJSON().toLocalIterator()] for k in ("matches", "evidence_aggregates", "panel_matches")}
    sinks.write_text(spark, f"{out}/results.json", json.dumps({"settings": settings, "comparison_stats": counts, **bounded}, indent=1))
    figure = figure_name(c("figure"))
    sections = [
        sinks.Section("Evidence aggregates", r["aggregates"], {"aggregate": c("aggregate_id"), "level": c("level"), "matches": c("match_count"), "top": optional_number(c("top_score")), "full row": optional_number(c("full_row_score")), "review": c("review_status")}, best),
        sinks.Section("Strip matches", r["matches"], {"figure": figure, "strips": F.concat_ws(" vs ", "strip_a", "strip_b"), "row": c("row_match"), "score": optional_number(c("score")), "context": optional_number(c("context_score")), "orientation": c("orientation"), "level": c("level")}, [F.desc("score"), "review_name"]),
    ]
    if o.compare_other_panels:
        sections.append(sinks.Section("Panel matches", r["panel_matches"], {"panels": F.concat(figure_name(c("figure_a")), "panel_a", F.lit(" vs "), figure_name(c("figure_b")), "panel_b"), "score": optional_number(c("score")), "orientation": c("orientation"), "level": c("level")}, [F.desc("score"), "review_name"], o.how.top_panel_n))
    sinks.write_report(spark, out, "Image screening", {**totals, **counts}, sections)
    sinks.write_checklist(spark, out, r["matches"].count(), r["panel_matches"].count())
    return {**s, **r}


def ranked_columns() -> list:
    return [F.desc(screening.ranked("level", screening.LEVELS)), F.desc("match_count"), F.desc("mean_top_score"), F.desc("top_score"), "aggregate_id"]


def parser() -> argparse.ArgumentParser:
    p, d = argparse.ArgumentParser(prog="lumenfold", description=__doc__), Settings()
    p.add_argument("inputs", nargs="+", help="one PDF, or images")
    p.add_argument("--out", required=True)
    p.add_argument("--dpi", type=int, default=180)
    p.add_argument("--figure", type=int)
    numbers = "min_score top_n min_patch_area min_patch_width min_patch_height min_area_ratio min_context_score context_margin min_aggregate_matches aggregate_top_k min_aggregate_context_score min_aggregate_orientation_fraction min_panel_score min_panel_area_ratio top_panel_n"
    for name in numbers.split():
        p.add_argument(f"--{name.replace('_', '-')}", type=type(getattr(d, name)), default=getattr(d, name))
    p.add_argument("--allow-row-mismatch", action="store_true")
    p.add_argument("--multimodal-package", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--multimodal-review-json")
    p.add_argument("--multimodal-max-aggregates", type=int, default=5)
    p.add_argument("--compare-other-panels", action="store_true")
    p.add_argument("--panel-scope", choices=("same-figure", "all-figures"), default="same-figure")
    p.add_argument("--keep-existing", action="store_true")
    p.add_argument("--pdf-backend", choices=("auto", "pymupdf", "swift"), default="auto")
    return p


def options(a: argparse.Namespace) -> Options:
    said = vars(a)
    how = Settings(**{k: said[k] for k in asdict(Settings()) if k in said}, require_row_match=not a.allow_row_mismatch, all_figures=a.panel_scope == "all-figures")
    return Options(a.dpi, a.figure, a.multimodal_package, a.multimodal_review_json, a.multimodal_max_aggregates, a.compare_other_panels, a.keep_existing, a.pdf_backend, how)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenfold").getOrCreate()
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    run(spark, a.inputs, a.out, options(a))
    log.info("report: %s/report.html", a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
