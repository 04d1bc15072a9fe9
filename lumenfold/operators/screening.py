"""Strips and panels compared, and matches of one row gathered into evidence aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, area_ratio, center_offset, enough_evidence
from ..functions.labels import aggregate_level, aggregate_name, level, match_name, panel_match_name
from . import evidence, greedy, segmentation, sequences, similarity
from .panels import strip_in_row

# Defaults of the screening, what is said of a match, the order of row matches and levels, and the turns that are tried.
STRIP_NOTE = "Same-protein-row WB/gel candidates pass minimum evidence-size filters and show high normalized cross-correlation after contrast normalization."
PANEL_NOTE = "Whole-panel non-WB/gel similarity candidate after contrast normalization and transform search. Useful for microscopy, TEM, colony, gross-photo, or other raster-panel reuse triage; not a local clone or splice claim."
AGGREGATE_NOTE = "Evidence aggregate derived from multiple same-protein-row local WB/gel matches. Use this as row-level support for localized reuse, not as proof that the entire row is pixel-identical."
PRIORITY = (("label", 2), ("row-index", 1))
LEVELS = (("high", 2), ("medium", 1))
STRIP_TURNS, PANEL_TURNS = ("none", "h", "v"), ("none", "h", "v", "rot180", "rot90", "rot270")


@dataclass(frozen=True)
class Settings:
    min_score: float = 0.82
    top_n: int = 40
    min_patch_area: int = 450
    min_patch_width: int = 18
    min_patch_height: int = 12
    min_area_ratio: float = 0.55
    min_context_score: float = 0.0
    context_margin: int = 10
    require_row_match: bool = True
    min_aggregate_matches: int = 2
    aggregate_top_k: int = 5
    min_aggregate_context_score: float = 0.55
    min_aggregate_orientation_fraction: float = 0.80
    min_panel_score: float = 0.92
    min_panel_area_ratio: float = 0.65
    all_figures: bool = False
    top_panel_n: int = 30


def ranked(column: str, order: tuple[tuple[str, int], ...]) -> Column:
    out = F.lit(0)
    for name, rank in reversed(order):
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def best_first(matches: DataFrame, most: int) -> DataFrame:
    """The best strip matches: by row match, score and context as they are shown, then in the order of the strips."""
    return matches.orderBy(F.desc(ranked("row_match", PRIORITY)), F.desc("score"), F.desc("context_score"), "figure", "page", "ord_a", "ord_b").limit(most)


def best_panels_first(matches: DataFrame, most: int) -> DataFrame:
    return matches.orderBy(F.desc("score"), "figure_a", "page_a", "panel_a", "figure_b", "page_b", "panel_b").limit(most)


def best_aggregates_first(aggregates: DataFrame) -> DataFrame:
    return aggregates.orderBy(F.desc(ranked("level", LEVELS)), F.desc("match_count"), F.desc("mean_top_score"), F.desc("top_score"), "figure", "page", "panel_a", "panel_b", "row_label", "row_index_a", "row_index_b")


def strip_candidates(strips: DataFrame, how: Settings) -> DataFrame:
    """Pairs of strips of different panels of a figure, a before b, with area_ratio, row_match and the status of the cascade before any score.

    strips: figure, page, panel, strip, ord, box, category (of the panel), row_label, row_index.
    """
    side = lambda s: strips.select("figure", "page", *[F.col(c).alias(f"{c}_{s}") for c in ("panel", "strip", "ord", "box", "category", "row_label", "row_index")])
    pairs = side("a").join(side("b"), ["figure", "page"]).where("ord_a < ord_b AND panel_a <> panel_b")
    c = F.col
    small = lambda s: ~enough_evidence(c(f"box_{s}.x1") - c(f"box_{s}.x0"), c(f"box_{s}.y1") - c(f"box_{s}.y0"), how.min_patch_area, how.min_patch_width, how.min_patch_height)
    ratio = area_ratio(c("box_a"), c("box_b"))
    match = similarity.row_match(c("row_label_a"), c("row_label_b"), c("row_index_a"), c("row_index_b"), how.require_row_match)
    status = (
        F.when(small("a") | small("b"), "pairs_skipped_small").when(ratio < how.min_area_ratio, "pairs_skipped_size_mismatch")
        .when((c("category_a") != "blot") | (c("category_b") != "blot"), "no blot").when(match.isin("partial-label", "unknown"), "pairs_skipped_row_unknown")
        .when(match == "mismatch", "pairs_skipped_row_mismatch").otherwise("candidate")
    )
    return pairs.withColumns({"area_ratio": ratio, "row_match": match, "status": status})


def scored_strips(pairs: DataFrame, patches: DataFrame, crops: DataFrame, how: Settings) -> DataFrame:
    """The candidates of pairs with raw score, orientation, context and the status of the rest of the cascade."""
    key = ["figure", "page", "a", "b"]
    named = pairs.where("status = 'candidate'").withColumns({"a": F.concat("panel_a", F.lit("/"), "strip_a"), "b": F.concat("panel_b", F.lit("/"), "strip_b")})
    held = patches.select("figure", "page", F.concat("panel", F.lit("/"), "strip").alias("name"), "patch")
    found = named.join(segmentation.oriented(held, named, (36, 180), STRIP_TURNS), key)
    passed = found.where(F.col("score") >= how.min_score)
    context = segmentation.context_scores(passed, crops, how.context_margin)
    joined = found.join(context, key, "left")
    low = F.lit(how.min_context_score > 0) & (F.col("context") < how.min_context_score)
    return joined.withColumn("status", F.when(F.col("score") < how.min_score, "pairs_below_score").when(low, "pairs_skipped_context").otherwise("match")).drop("a", "b")


def strip_matches(scored: DataFrame) -> DataFrame:
    """All matches of scored pairs in the shape of the result table."""
    c = F.col
    shown = {"level": level(c("score")), "note": F.lit(STRIP_NOTE), "review_name": match_name(c("figure"), c("row_label_a"), c("strip_a"), c("strip_b"), c("score"))}
    out = scored.where("status = 'match'").withColumns(shown)
    return out.withColumns({
        "score": F.round("score", 4), "context_score": F.round("context", 4), "evidence_area_a": area(c("box_a")), "evidence_area_b": area(c("box_b")), "area_ratio": F.round("area_ratio", 4),
    }).drop("context", "status", "category_a", "category_b")


def counters(panels: DataFrame, pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """name, n: the counts of the whole comparison. panels: text_filtered, small_filtered (strips that panels lost)."""
    tables = [
        pairs.agg(F.lit("pairs_considered").alias("name"), F.count("*").alias("n")),
        pairs.where("status NOT IN ('candidate', 'no blot')").groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")),
        scored.where("status <> 'match'").groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")),
        *[panels.agg(F.lit(name).alias("name"), F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("n")) for name, column in (("strips_text_filtered", "text_filtered"), ("strips_small_filtered", "small_filtered"))],
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def panel_candidates(panels: DataFrame, how: Settings) -> tuple[DataFrame, DataFrame]:
    """panels: figure, page, panel, ord, box, category -> pairs of panels that aren't blots and alike in area, and a row with the numbers of pairs: all, inside the scope, and of these without blots.

    In one figure pairs meet by figure; over all figures by buckets of the area.
    """
    keys = ["figure", "page"]
    scope = [] if how.all_figures else keys
    plain = panels.where("category <> 'blot'").withColumns({"id": F.struct("figure", "page", "ord"), "area": area(F.col("box"))})
    pairs = similarity.panel_pairs(plain.select("id", "area", *scope), scope, how.min_panel_area_ratio).select("id_a", "id_b", "area_a", "area_b", "area_ratio")
    for s in "ab":
        names = plain.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("figure", "page", "panel")])
        pairs = pairs.join(names, f"id_{s}")
    # counts of pairs come from group sizes, no pair is made for them
    two = lambda c: F.coalesce(F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("long")), F.lit(0))
    sizes = lambda by: panels.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("category") != "blot").alias("k"))
    counts = sizes([]).agg(two("n").alias("all")).crossJoin(sizes(scope).agg(two("n").alias("inside"), two("k").alias("plain")))  # a row each
    return pairs, counts


def panel_counters(counts: DataFrame, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """name, n: the counts of the panels' comparison."""
    row = counts.crossJoin(pairs.agg(F.count("*").alias("pairs"))).crossJoin(matches.agg(F.count("*").alias("matches")))  # a row each
    each = {"panel_pairs_considered": "all", "panel_pairs_skipped_scope": "all - inside", "panel_pairs_skipped_blot": "inside - plain", "panel_pairs_skipped_area_ratio": "plain - pairs", "panel_pairs_below_score": "pairs - matches"}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.expr(v).alias("n")) for k, v in each.items()])).alias("x")).select("x.*")


def panel_matches(pairs: DataFrame, patches: DataFrame, how: Settings) -> DataFrame:
    """The pairs whose best turn reaches the least score, in the shape of the result table. patches: figure, page, panel, patch."""
    name = lambda s: F.concat_ws("/", f"figure_{s}", f"page_{s}", f"panel_{s}")
    together = lambda df: df.withColumns({"figure": F.lit(0), "page": F.lit(0)}) if how.all_figures else df.withColumns({"figure": F.col("figure_a"), "page": F.col("page_a")})
    named = together(pairs.withColumns({"a": name("a"), "b": name("b")}))
    held = patches.select("figure", "page", F.concat_ws("/", "figure", "page", "panel").alias("name"), "patch")
    if how.all_figures:
        # each pair takes its two patches along: pairs of a figure and panels of all others have no common group
        both = named.select("a", "b", F.concat_ws("|", "a", "b").alias("pair"))
        ends = both.select("pair", F.explode(F.array("a", "b")).alias("name")).join(held.select("name", "patch"), "name")
        key = F.pmod(F.xxhash64("pair"), F.lit(1 << 30)).cast("int")
        asked, held = both.select(key.alias("figure"), F.lit(0).alias("page"), "a", "b"), ends.select(key.alias("figure"), F.lit(0).alias("page"), "name", "patch")
    else:
        asked = named
    scores = segmentation.oriented(held, asked, (180, 180), PANEL_TURNS).drop("figure", "page")
    found = named.drop("figure", "page").join(scores, ["a", "b"]).where(F.col("score") >= how.min_panel_score)
    c = F.col
    out = found.withColumn("review_name", panel_match_name(c("figure_a"), c("panel_a"), c("figure_b"), c("panel_b"), c("score"))).withColumns({"level": level(c("score")), "note": F.lit(PANEL_NOTE)})
    return out.withColumns({"score": F.round("score", 4), "area_ratio": F.round("area_ratio", 4)}).drop("a", "b", "id_a", "id_b")


GROUP = ["figure", "page", "panel_a", "panel_b", "row_label", "row_index_a", "row_index_b"]


def row_groups(matches: DataFrame) -> DataFrame:
    """Matches with row_label (of both sides, else empty), the label part of their group."""
    same = F.when(F.col("row_label_a") == F.col("row_label_b"), F.col("row_label_a"))
    return matches.withColumn("row_label", F.coalesce(same, F.lit("")))


def full_row_pairs(groups: DataFrame, strips: DataFrame, panels: DataFrame) -> DataFrame:
    """Of each group the pairs (strip_a, strip_b) of the row's wide strips - 60 and 0.3 of the panel's width, or else the representative one.

    strips: figure, page, panel, strip, ord, box, row_label, row_index; panels: figure, page, panel, box.
    """
    width = F.col("box.x1") - F.col("box.x0")
    need = panels.select("figure", "page", "panel", F.greatest(F.lit(60), (0.30 * width).cast("int")).alias("need"))
    wide = strips.withColumn("width", width).join(need, ["figure", "page", "panel"]).withColumnRenamed("row_label", "own_label").withColumnRenamed("row_index", "own_index")
    sides = {}
    for s in "ab":
        mine = wide.withColumnRenamed("panel", f"panel_{s}")
        found = groups.select("group", *GROUP).join(mine, ["figure", "page", f"panel_{s}"]).where(strip_in_row(F.col("own_label"), F.col("own_index"), F.nullif("row_label", F.lit("")), F.col(f"row_index_{s}")))
        best = F.struct(F.col("width") >= F.col("need"), "width", area(F.col("box")), -F.col("ord"))
        top = Window.partitionBy("group")
        found = found.withColumn("any", F.max(F.col("width") >= F.col("need")).over(top)).withColumn("first", F.row_number().over(top.orderBy(F.desc(best))))
        chosen = found.where(F.when(F.col("any"), F.col("width") >= F.col("need")).otherwise(F.col("first") == 1))
        sides[s] = chosen.select("group", "figure", "page", F.concat(F.col(f"panel_{s}"), F.lit("/"), "strip").alias(s), F.col("box").alias(f"row_{s}"), F.col("ord").alias(f"row_ord_{s}"))
    return sides["a"].join(sides["b"], ["group", "figure", "page"])


def aggregates(matches: DataFrame, strips: DataFrame, panels: DataFrame, patches: DataFrame, how: Settings) -> DataFrame:
    """The evidence aggregates of all groups that pass the gates; matches: as strip_matches()."""
    least, top_k = max(1, how.min_aggregate_matches), max(1, how.aggregate_top_k)
    c = F.col
    grouped = row_groups(matches).withColumn("group", F.xxhash64(F.to_json(F.struct(*GROUP), {"ignoreNullFields": "false"})))
    groups = grouped.groupBy("group", *GROUP).agg(F.count("*").alias("raw_match_count")).where(c("raw_match_count") >= least)
    offsets = grouped.join(groups.select("group"), "group").select("group", c("strip_a").alias("a"), c("strip_b").alias("b"), center_offset(c("box_a"), c("box_b")).alias("offset"), "score", c("context_score").alias("context"))
    support = greedy.offset_support(offsets, "group").where(F.size("support") >= least).select("group", F.posexplode(F.slice("support", 1, top_k)).alias("place", "s"))
    rows = support.select("group", "place", c("s.a").alias("strip_a"), c("s.b").alias("strip_b")).join(grouped, ["group", "strip_a", "strip_b"])
    stats = evidence.match_stats(rows.select("group", c("place").alias("id"), "score", c("context_score").alias("context"), "orientation", center_offset(c("box_a"), c("box_b")).alias("offset")), ["group"], ["id"])
    first = rows.groupBy("group").agg(
        *[F.min_by(x, "place").alias(x) for x in ("row_label_a", "row_label_b", "row_match")],
        F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat("strip_a", F.lit(" vs "), "strip_b").alias("pair"), "score"))), lambda x: F.struct(x["pair"], x["score"])).alias("listed"),
    )
    pairs = full_row_pairs(groups, strips, panels)
    held = patches.select("figure", "page", F.concat("panel", F.lit("/"), "strip").alias("name"), "patch")
    scores = segmentation.oriented(held, pairs.select("figure", "page", "a", "b").distinct(), (36, 180), STRIP_TURNS)
    order = F.struct("score", -c("row_ord_a"), -c("row_ord_b"))
    full = pairs.join(scores, ["figure", "page", "a", "b"]).groupBy("group").agg(F.round(F.max("score"), 4).alias("full_row_score"), F.max_by("row_a", order).alias("row_a"), F.max_by("row_b", order).alias("row_b"))
    out = groups.join(stats, "group").join(first, "group").join(full, "group", "left")
    for s in "ab":
        spans = rows.select("group", c(f"box_{s}.x0").alias("x0"), c(f"box_{s}.x1").alias("x1"))
        out = out.join(sequences.union_length(spans, ["group"], "x0", "x1").withColumnRenamed("covered", f"covered_{s}"), "group", "left")
        out = out.withColumn(f"row_coverage_{s}", sequences.coverage(c(f"covered_{s}"), c(f"row_{s}.x1") - c(f"row_{s}.x0")))
    gated = out.where((c("mean_context") >= how.min_aggregate_context_score) & (c("orientation_share") >= how.min_aggregate_orientation_fraction))
    label = F.nullif("row_label", F.lit(""))
    return gated.select(
        aggregate_name(c("figure"), c("panel_a"), c("panel_b"), label, c("row_index_a")).alias("aggregate_id"), "figure", "page", "panel_a", "panel_b", label.alias("row_label"), "row_label_a", "row_label_b", "row_index_a", "row_index_b",
        "row_match", F.lit("row-local-cluster").alias("evidence_type"), aggregate_level(c("n"), c("n_high"), c("mean_top3")).alias("level"), c("n").alias("match_count"), "raw_match_count", c("n_high").alias("high_match_count"),
        c("n_medium").alias("medium_match_count"), F.round("top_score", 4).alias("top_score"), c("mean_top3").alias("mean_top_score"), "mean_score", F.round("top_context", 4).alias("max_context_score"), c("mean_context").alias("mean_context_score"),
        c("orientation").alias("dominant_orientation"), c("orientation_share").alias("dominant_orientation_fraction"), (c("orientation_share") >= how.min_aggregate_orientation_fraction).alias("orientation_consistent"), c("offset_std").alias("lane_offset_std"),
        c("offset_consistent").alias("lane_offset_consistent"), "row_coverage_a", "row_coverage_b", "full_row_score", c("listed.pair").alias("support_matches"), c("listed.score").alias("support_scores"), F.lit(AGGREGATE_NOTE).alias("note"),
    )
