"""Counts over the pairs of similarity.panel_pairs(), without forming a pair."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MOST_BLOCKS = 512  # the driver holds the square of it as 64-bit counts


def limits(area: np.ndarray, min_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest double that has a ratio of min_ratio or more to each area, as doubles are divided."""
    low, high = area * min_ratio, area / min_ratio
    for inward in (False, True):  # division is monotone, so single steps end at the exact bounds
        while True:
            x, y = (np.nextafter(low, np.inf), np.nextafter(high, 0)) if inward else (np.nextafter(low, 0), np.nextafter(high, np.inf))
            a, b = (low / area < min_ratio, area / high < min_ratio) if inward else (x / area >= min_ratio, area / y >= min_ratio)
            if not (a.any() or b.any()):
                break
            low, high = np.where(a, x, low), np.where(b, y, high)
    return low, high


def below(values: np.ndarray, weights: np.ndarray, start: np.ndarray, stop: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query the sum of the weights at the places start to stop (without it) whose value is under its limit: a wavelet matrix."""
    total = np.zeros(len(limit), np.int64)
    for bit in reversed(range(int(max(values.max(initial=0), limit.max(initial=0))).bit_length())):
        zero, up = (values >> bit) & 1 == 0, (limit >> bit) & 1 == 1
        zeros, weight = (np.concatenate(([0], np.cumsum(x))) for x in (zero, np.where(zero, weights, 0)))
        total += np.where(up, weight[stop] - weight[start], 0)
        start, stop = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (start, stop))
        order = np.concatenate((np.flatnonzero(zero), np.flatnonzero(~zero)))
        values, weights = values[order], weights[order]
    return total


def _numpy(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy() for n in names]


def panel_pair_counts(panels: DataFrame, min_ratio: float = 0.65, block_rows: int = 1 << 16) -> DataFrame:
    """panels: id (a whole number), area; id_a and in how many pairs of panel_pairs() over all panels it comes first.

    The pairs of a row are the rows of a larger id whose area lies between two limits. Ids and areas fall into ranges of some
    `block_rows` rows. Of the ranges of ids above its own, a row takes the sums of whole ranges of areas from a table on the driver
    and counts in the two ranges where its limits lie; there equal areas of a range of ids are one cell. In its own range of ids it
    counts by ranks. So work grows as n log n, and a common area or a wide limit makes no task larger.
    """
    kept = panels.where("area > 0 AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("area").cast("double").alias("area"))
    area, shares = F.col("area"), [i / MOST_BLOCKS for i in range(1, MOST_BLOCKS)]
    spread = kept.select("id", F.explode(F.array(area, area * min_ratio, area / min_ratio)).alias("x"))
    n, *found = spread.agg(F.count("*"), F.percentile_approx("id", shares), F.percentile_approx("x", shares)).first()
    blocks = max(1, min(MOST_BLOCKS, -(-n // (3 * block_rows))))
    ids, areas = (np.unique([(f or [])[i * MOST_BLOCKS // blocks - 1] for i in range(1, blocks)]) for f in found)  # only how even ranges are depends on them

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, a = _numpy(batch, "id", "area")
            yield pa.record_batch({"id": i, "area": a, "block": np.searchsorted(ids, i).astype(np.int32), "bucket": np.searchsorted(areas, a).astype(np.int32)})

    dealt = kept.mapInArrow(deal, "id long, area double, block int, bucket int")
    block, bucket, count = _numpy(dealt.groupBy("block", "bucket").agg(F.count("*").alias("n")).toArrow(), "block", "bucket", "n")
    above = np.zeros((len(ids) + 2, len(areas) + 2), np.int64)  # rows of the ranges of ids from this one on, in the ranges of areas before this one
    above[block, bucket + 1] = count
    above = np.cumsum(np.cumsum(above[::-1], 0)[::-1], 1)
    last = len(ids)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, a, held = _numpy(batch, "block", "area", "n")
            low, high = limits(a, min_ratio)
            for sign, x in ((0, a), (1, high), (-1, low)):
                yield pa.record_batch({"bucket": np.searchsorted(areas, x).astype(np.int32), "sign": np.full(len(a), sign, np.int32), "block": b, "x": x, "area": a, "n": held})

    def across(table: pa.Table) -> pa.Table:
        """n: rows of larger ranges of ids up to the limit, or with a minus those under it."""
        bucket, sign, block, x, area, held = _numpy(table, "bucket", "sign", "block", "x", "area", "n")
        own = np.flatnonzero(sign == 0)
        own, asked = own[np.argsort(x[own], kind="stable")], np.flatnonzero(sign)
        stop = np.where(sign[asked] > 0, np.searchsorted(x[own], x[asked], "right"), np.searchsorted(x[own], x[asked], "left"))
        inside = below(last - block[own].astype(np.int64), held[own], np.zeros_like(stop), stop, last - block[asked].astype(np.int64))
        return pa.table({"block": block[asked], "area": area[asked], "n": sign[asked] * (inside + above[block[asked] + 1, bucket[asked]])})

    def inside(rows: pa.Table, cells: pa.Table) -> pa.Table:
        i, a = _numpy(rows, "id", "area")
        order = np.argsort(i, kind="stable")
        i, a = i[order], a[order]
        known, rank = np.unique(a, return_inverse=True)
        low, high = limits(known, min_ratio)
        total = np.zeros(len(known), np.int64)
        at, n = _numpy(cells, "area", "n")
        np.add.at(total, np.searchsorted(known, at), n)
        start, stop, ones = np.searchsorted(i, i, "right"), np.full(len(i), len(i)), np.ones(len(i), np.int64)
        up, down = np.searchsorted(known, high, "right")[rank], np.searchsorted(known, low, "left")[rank]
        pairs = total[rank] + below(rank, ones, start, stop, up) - below(rank, ones, start, stop, down)
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
        pairs = np.add.reduceat(pairs, first) if len(i) else pairs
        return pa.table({"id_a": i[first], "pairs": pairs}).filter(pa.array(pairs > 0))

    cells = dealt.groupBy("block", "area").agg(F.count("*").alias("n"))
    asked = cells.mapInArrow(ask, "bucket int, sign int, block int, x double, area double, n long")
    met = asked.groupBy("bucket").applyInArrow(across, "block int, area double, n long")
    return dealt.select("block", "id", "area").groupBy("block").cogroup(met.groupBy("block")).applyInArrow(inside, "id_a long, pairs long")


def _totals(panels: DataFrame, keys: list[str], min_ratio: float) -> DataFrame:
    """keys, pairs, ratios: over all pairs of rows of equal keys, whatever their ids."""
    cells = panels.groupBy(*keys, "area").agg(F.count("*").alias("n"))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("low", pa.array(limits(*_numpy(batch, "area"), min_ratio)[0]))

    held = cells.mapInArrow(lowest, StructType([*cells.schema.fields, StructField("low", DoubleType())]))
    # a row's limit lies in its own bucket or in the one before, whose rows are copied into it
    bucket, none = F.floor(F.ln("area") / (1e-9 - math.log(min_ratio))), F.lit(0).cast("long")
    mark = lambda at, x, count, sign: F.struct(at.alias("bucket"), F.col(x).alias("x"), count.alias("count"), F.lit(sign).alias("sign"))
    marks = F.array(mark(bucket, "area", F.col("n"), 1), mark(bucket + 1, "area", F.col("n"), 0), mark(bucket, "low", none, -1))
    events = held.select(*keys, "area", "n", F.explode(marks).alias("e")).select(*keys, "area", "n", "e.*")
    before = Window.partitionBy(*keys, "bucket").orderBy("x", F.col("sign") >= 0).rowsBetween(Window.unboundedPreceding, -1)  # a limit comes before its equal area
    sums = events.withColumns({"rows": F.coalesce(F.sum("count").over(before), none), "mass": F.coalesce(F.sum(F.col("count") * F.col("x")).over(before), F.lit(0.0))}).where("sign <> 0")
    less = sums.groupBy(*keys, "bucket", "area", "n").agg(F.sum(F.col("sign") * F.col("rows")).alias("rows"), F.sum(F.col("sign") * F.col("mass")).alias("mass"))
    equal = F.expr("n * (n - 1) div 2")
    return less.groupBy(*keys).agg(F.sum(F.col("n") * F.col("rows") + equal).alias("pairs"), F.sum(F.col("n") * F.col("mass") / F.col("area") + equal).alias("ratios"))


def panel_pair_totals(panels: DataFrame, scope: list[str], min_ratio: float = 0.65) -> DataFrame:
    """panels: id, area and the scope columns; the scope, and of its pairs in panel_pairs() the number and the sum of their area ratios.

    Equal areas of a scope are one cell. Running sums over the areas of two neighbouring buckets, up to a row and up to the least
    area that may meet it, give both; pairs of rows that share an id are taken off again.
    """
    kept = panels.where("area > 0 AND id IS NOT NULL").where(F.lit(True) if not scope else reduce(and_, (F.col(c).isNotNull() for c in scope)))
    kept = kept.select(*scope, "id", F.col("area").cast("double").alias("area"))
    again = kept.join(kept.groupBy(*scope, "id").agg(F.count("*").alias("n")).where("n > 1").drop("n"), [*scope, "id"], "left_semi")
    off = _totals(again, [*scope, "id"], min_ratio).select(*scope, (-F.col("pairs")).alias("pairs"), (-F.col("ratios")).alias("ratios"))
    both = _totals(kept, scope, min_ratio).unionByName(off)
    return both.groupBy(*scope).agg(F.sum("pairs").alias("pairs"), F.sum("ratios").alias("ratios")).where("pairs > 0")
