"""Counts over panel pairs against loops, and on tables whose pairs can't be formed."""

import numpy as np
import pytest
from lumenfold.operators import pair_counts
from lumenfold.plans.queries import QUERIES
from pyspark.sql import functions as F


def odd_panels(kind: str) -> list[tuple]:
    rnd = np.random.default_rng(5)
    n = 300
    areas = {
        "whole": rnd.integers(1, 40, n).astype(float), "equal": np.full(n, 7.0), "spread": np.exp(rnd.normal(0, 3, n)), "edges": rnd.choice([13.0, 20.0, 26.0, 40.0, 8.45, 0.65, 1.0], n),
        "one low": np.concatenate((np.full(n - 1, 1000.0), [650.0])),
    }[kind]
    ids = rnd.permutation(n) - 100
    ids[:20] = ids[20:40]  # rows of one id are no pair
    rows = [(int(i), float(a), "xyz"[int(i) % 3]) for i, a in zip(ids, areas)]
    return [*rows, (None, 7.0, "x"), (900, None, "x"), (901, 0.0, "x"), (902, 7.0, None)]


def pairs_by_loop(rows: list[tuple]) -> list[tuple]:
    held = [r for r in rows if r[0] is not None and r[1]]
    return [(p, q, min(p[1], q[1]) / max(p[1], q[1])) for p in held for q in held if p[0] < q[0] and min(p[1], q[1]) / max(p[1], q[1]) >= 0.65]


@pytest.mark.parametrize("kind", ["whole", "equal", "spread", "edges", "one low"])
@pytest.mark.parametrize("block_rows", [16, 1 << 16])
def test_counts_of_each_panel_against_a_loop(spark, kind, block_rows):
    rows = odd_panels(kind)
    want = {}
    for p, _, _ in pairs_by_loop(rows):
        want[p[0]] = want.get(p[0], 0) + 1
    got = pair_counts.panel_pair_counts(spark.createDataFrame(rows, "id long, area double, figure string"), block_rows=block_rows).collect()
    assert len(got) == len(want) and {r["id_a"]: r["pairs"] for r in got} == want


def test_no_panels(spark):
    assert pair_counts.panel_pair_counts(spark.createDataFrame([], "id long, area double")).collect() == []


def test_limits_are_the_last_doubles_that_pass():
    area = np.concatenate((np.arange(1, 3000).astype(float), np.exp(np.random.default_rng(2).normal(0, 30, 3000))))
    for ratio in (0.65, 0.55, 1.0, 1 / 3):
        low, high = pair_counts.limits(area, ratio)
        assert (low / area >= ratio).all() and (area / high >= ratio).all()
        assert (np.nextafter(low, 0) / area < ratio).all() and (area / np.nextafter(high, np.inf) < ratio).all()


@pytest.fixture(scope="module")
def one_size(spark, tmp_path_factory):
    """100,000 parts of one brand and one size: 5 thousand million pairs."""
    d = str(tmp_path_factory.mktemp("parts"))
    part = spark.range(0, 97 * 100_000, 97).select(F.col("id").alias("p_partkey"), F.lit("one").alias("p_brand"), F.lit(10).alias("p_size"))
    part.write.parquet(f"{d}/part.parquet")
    return d


def test_each_panel_counts_pairs_without_forming_them(spark, one_size):
    got = QUERIES["panel_pair_bucketed"](spark, one_size)
    assert got.count() == 99_999
    assert got.where(F.col("pairs") != 99_999 - F.col("id_a") / 97).count() == 0


@pytest.mark.parametrize("kind", ["whole", "equal", "spread", "edges", "one low"])
@pytest.mark.parametrize("scope", [["figure"], []])
def test_totals_of_each_scope_against_a_loop(spark, kind, scope):
    rows = odd_panels(kind)
    want = {}
    for p, q, ratio in pairs_by_loop(rows):
        if not scope or p[2] == q[2] is not None:
            n, total = want.get(p[2] if scope else None, (0, 0.0))
            want[p[2] if scope else None] = (n + 1, total + ratio)
    got = pair_counts.panel_pair_totals(spark.createDataFrame(rows, "id long, area double, figure string"), scope).collect()
    assert {r["figure"] if scope else None: r["pairs"] for r in got} == {k: n for k, (n, _) in want.items()}
    assert all(r["ratios"] == pytest.approx(want[r["figure"] if scope else None][1], rel=1e-12) for r in got)


def test_pairs_of_a_figure_are_summed_without_forming_them(spark, one_size):
    (row,) = QUERIES["panel_pair_same_figure"](spark, one_size).collect()
    assert (row["figure"], row["pairs"], row["ratios"]) == ("one", 100_000 * 99_999 // 2, 100_000 * 99_999 / 2)
