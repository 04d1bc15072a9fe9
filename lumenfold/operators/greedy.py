"""Order-dependent selections as folds over a totally ordered array. Groups are small by construction (at most a panel's candidates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_if_far(df: DataFrame, key: str, value: str, gap: float) -> DataFrame:
    """key, kept: ascending values, each `gap` or more from the last kept one."""
    last = "element_at(acc, -1)"
    fold = f"aggregate(sort_array(collect_list({value})), cast(array() as array<double>), (acc, v) -> IF(size(acc) = 0 OR v - {last} >= {gap}, array_append(acc, v), acc))"
    return df.withColumn(value, F.col(value).cast("double")).groupBy(key).agg(F.expr(fold).alias("kept"))


def non_maximum_suppression(df: DataFrame, key: str, most: int = 48, overlap: float = 0.65, similar: float = 0.35) -> DataFrame:
    """df: key, id, box, score -> key, kept ids by falling score (ties: id).

    A box goes if a kept one covers more than `overlap` of the smaller of both and their area ratio is over `similar`.
    """
    inter = "greatest(0, least(k.box.x1, c.box.x1) - greatest(k.box.x0, c.box.x0)) * greatest(0, least(k.box.y1, c.box.y1) - greatest(k.box.y0, c.box.y0))"
    area = lambda b: f"(({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0))"
    small, large = f"least({area('k.box')}, {area('c.box')})", f"greatest({area('k.box')}, {area('c.box')})"
    hit = f"exists(acc, k -> {inter} > {overlap} * {small} AND {small} > {similar} * {large})"
    listed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "box"))).alias("all"))
    fold = f"aggregate(all, slice(all, 1, 0), (acc, c) -> IF(size(acc) >= {most} OR {hit}, acc, array_append(acc, c)))"
    return listed.select(key, F.expr(f"transform({fold}, k -> k.id)").alias("kept"))


def assign_one_to_one(pairs: DataFrame, key: str, order: list[str], carry: list[str] = ()) -> DataFrame:
    """pairs: key, a, b, the order columns and those to carry along -> key, a, b, carried ones, greedily so that no a and no b is used twice."""
    listed = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "a", "b", *carry))).alias("all"))
    fold = "aggregate(all, slice(all, 1, 0), (acc, c) -> IF(exists(acc, k -> k.a = c.a OR k.b = c.b), acc, array_append(acc, c)))"
    return listed.select(key, F.explode(F.expr(fold)).alias("x")).select(key, "x.a", "x.b", *[f"x.{c}" for c in carry])


def offset_support(matches: DataFrame, key: str, within: float = 6.0) -> DataFrame:
    """matches: key, a, b, offset, score, context -> key, offset, support: the best consistent 1:1 set of a group.

    Each distinct offset (one decimal) is a centre; matches within `within` of it are taken by score, then context,
    no a or b twice; the largest set wins, then the highest sum of scores, then the lowest offset.
    """
    m = matches.withColumn("one", F.struct((-F.col("score")).alias("s"), (-F.col("context")).alias("c"), "a", "b"))
    centres = matches.select(key, F.round("offset", 1).alias("centre")).distinct()
    near = m.join(centres, key).where(F.abs(F.col("offset") - F.col("centre")) <= within)
    listed = near.groupBy(key, "centre").agg(F.sort_array(F.collect_list("one")).alias("all"))
    fold = "aggregate(all, slice(all, 1, 0), (acc, c) -> IF(exists(acc, k -> k.a = c.a OR k.b = c.b), acc, array_append(acc, c)))"
    picked = listed.withColumn("taken", F.expr(fold)).withColumn("total", F.expr("aggregate(taken, 0D, (x, k) -> x - k.s)"))
    best = picked.groupBy(key).agg(F.max_by(F.struct("centre", "taken"), F.struct(F.size("taken").alias("n"), F.round("total", 9).alias("t"), (-F.col("centre")).alias("o"))).alias("x"))
    return best.select(key, F.col("x.centre").alias("offset"), F.expr("transform(x.taken, k -> struct(k.a AS a, k.b AS b, -k.s AS score))").alias("support"))
