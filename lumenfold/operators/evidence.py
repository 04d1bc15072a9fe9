"""Evidence aggregates over matches, and the merge of external reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import HIGH, MEDIUM, aggregate_level

# What a review may say.
STATUSES = ("supports", "uncertain", "does_not_support")


def _mean(c: Column) -> Column:
    """The mean of values of 4 decimals, to 4 decimals, halves up; summed as whole numbers, so that ties are exact."""
    total, n = F.sum(F.round(c * 10_000).cast("long")), F.count(c)
    return F.floor((2 * total + n) / (2.0 * n)) / 10_000.0


def match_stats(matches: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """matches: keys, id, score, context, orientation, offset. One row for each group: counts, means, the orientation's mode, the offsets' spread.

    order: how the matches of a group follow each other, by score, context and id if not given.
    """
    w = Window.partitionBy(*keys).orderBy(*(order or [F.desc("score"), F.desc("context"), "id"]))
    ranked = matches.withColumn("rank", F.row_number().over(w))
    stats = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("score") >= HIGH).alias("n_high"), F.count_if((F.col("score") >= MEDIUM) & (F.col("score") < HIGH)).alias("n_medium"),
        F.max("score").alias("top_score"), _mean(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean_top3"), _mean(F.col("score")).alias("mean_score"),
        F.max("context").alias("top_context"), _mean(F.col("context")).alias("mean_context"),
        F.when(F.count("*") >= 2, F.round(F.stddev_pop("offset"), 4)).alias("offset_std"),
    )
    modes = ranked.groupBy(*keys, "orientation").agg(F.count("*").alias("c"), F.min("rank").alias("first"))
    mode = modes.groupBy(*keys).agg(F.max_by("orientation", F.struct("c", F.col("orientation") == "none", -F.col("first"))).alias("orientation"), F.max("c").alias("c"))
    both = stats.join(mode, [stats[k].eqNullSafe(mode[k]) for k in keys]).select(*[stats[c] for c in stats.columns], mode["orientation"], mode["c"])
    return both.withColumns({
        "orientation_share": F.round(F.col("c") / F.col("n"), 4), "offset_consistent": F.coalesce(F.col("offset_std") <= 6.0, F.lit(False)),
        "level": aggregate_level(F.col("n"), F.col("n_high"), F.col("mean_top3")),
    }).drop("c")


def gated(stats: DataFrame, min_matches: int = 2, min_context: float = 0.55, min_share: float = 0.80) -> DataFrame:
    return stats.where((F.col("n") >= min_matches) & (F.col("mean_context") >= min_context) & (F.col("orientation_share") >= min_share))


def unanimous(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The label that all labelled rows of a key agree on."""
    known = rows.where(F.col(label).isNotNull() & (F.col(label) != ""))
    return known.groupBy(*keys).agg(F.min(label).alias(label), F.max(label).alias("__most")).where(F.col(label) == F.col("__most")).drop("__most")


def propagated(rows: DataFrame, keys: list[str], panel: str, label: str) -> DataFrame:
    """Rows with missing labels filled by the unanimous one, unless the panel has that label already."""
    own = rows.groupBy(panel).agg(F.collect_set(label).alias("__own"))
    agreed = unanimous(rows, keys, label).withColumnRenamed(label, "__agreed")
    joined = rows.join(agreed, keys, "left").join(own, panel, "left")
    fill = F.when(~F.coalesce(F.array_contains("__own", F.col("__agreed")), F.lit(False)), F.col("__agreed"))
    return joined.withColumn(label, F.coalesce(F.nullif(F.col(label), F.lit("")), fill)).drop("__agreed", "__own")


def representative(strips: DataFrame, keys: list[str]) -> DataFrame:
    """The widest strip of each key, then the largest, then the first."""
    return strips.groupBy(*keys).agg(F.max_by("sid", F.struct("w", F.col("w") * F.col("h"), -F.col("sid"))).alias("sid"))


def review_columns(status: Column, confidence: Column, rationale: Column, model: Column, agent: Column, source: Column) -> dict[str, Column]:
    said = F.lower(F.trim(status))
    sure = confidence.try_cast("double")
    name = F.coalesce(F.nullif(model, F.lit("")), F.nullif(agent, F.lit("")), source)
    return {
        "status": F.when(said.isin(*STATUSES), said).otherwise("uncertain"), "confidence": F.when(sure.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 3)),
        "rationale": F.substring(F.trim(F.coalesce(rationale, F.lit(""))), 1, 1000), "model": F.substring(F.trim(name), 1, 120),
    }


def merge_reviews(aggregates: DataFrame, reviews: DataFrame, alone: bool | None = None) -> DataFrame:
    """Left join of the last review (by seq) of each aggregate_id; a lone aggregate takes the last review of its id, or else the last of all.

    alone: whether there is one aggregate in all; if not given it is found in the same plan, without a job of its own.
    """
    w = Window.partitionBy("aggregate_id").orderBy(F.desc("seq"))
    last = reviews.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    said = [c for c in last.columns if c not in ("aggregate_id", "seq")]
    out = aggregates.join(last.select("aggregate_id", F.struct(*said).alias("__own")), "aggregate_id", "left")
    if alone is not False:
        # one row: the last review of all, and whether there is one aggregate
        latest = last.agg(F.max_by(F.struct(*said), "seq").alias("__any"))
        single = F.lit(True) if alone else F.col("__single")
        out = out.crossJoin(F.broadcast(latest)).crossJoin(F.broadcast(aggregates.limit(2).agg((F.count("*") == 1).alias("__single"))))
        out = out.withColumn("__own", F.coalesce("__own", F.when(single, F.col("__any")))).drop("__any", "__single")
    return out.select(*aggregates.columns, *[F.col(f"__own.{c}").alias(c) for c in said]).fillna({"status": "not-run"})
