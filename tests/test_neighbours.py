"""Neighbour counts by columns against all pairs, also at distances that equal the radius up to rounding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import density, neighbours

FEATURES = ["x", "y", "z"]


def grid(n=700):
    """Few values of x and z, steps of 0.1 so that many distances are 0.5 but for rounding; copies and a hot column."""
    rng = np.random.default_rng(5)
    points = np.stack([rng.integers(0, 12, n) * 0.1, rng.integers(0, 40, n) * 0.05 + rng.integers(0, 2, n) * rng.random(n), rng.integers(0, 9, n) * 0.3], 1)
    points[:200, [0, 2]] = 0.3
    return np.vstack([points, points[:30]])


def brute(points, eps):
    gaps = (points[:, None] - points[None]) ** 2
    return (np.sqrt(gaps[..., 0] + gaps[..., 1] + gaps[..., 2]) <= eps).sum(1).tolist()


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "customer_id long, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("block_spots,right_blocks", [(16_384, 128), (50, 4)])
def test_columns_count_as_all_pairs(spark, block_spots, right_blocks):
    points = grid()
    spots = frame(spark, points).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("rows"))
    for long in ("y", "z"):
        found = {tuple(r.x): r.neighbours for r in neighbours.counts_by_columns(spots, FEATURES, 0.5, long, block_spots, right_blocks).collect()}
        assert [found[tuple(p)] for p in points.tolist()] == brute(points, 0.5)


def test_columns_and_boxes_agree_and_rows_off_the_map_have_none(spark):
    df = frame(spark, grid(200)).unionByName(spark.createDataFrame(
        [(900, 0.1, None, 0.3), (901, 0.1, float("nan"), 0.3)], "customer_id long, x double, y double, z double"))
    counted = [{r.customer_id: r.neighbours for r in density.neighbour_counts(df, FEATURES, columns=way).collect()} for way in (True, False, None)]
    assert counted[0] == counted[1] == counted[2]
    assert counted[0][900] is None and counted[0][901] is None and len(counted[0]) == 232


def test_one_feature_is_one_column(spark):
    df = frame(spark, grid(60))
    found = {r.customer_id: r.neighbours for r in density.neighbour_counts(df, ["y"]).collect()}
    y = grid(60)[:, 1]
    assert [found[i] for i in range(len(y))] == (np.abs(y[:, None] - y[None]) <= 0.5).sum(1).tolist()


def test_a_hot_column_costs_searches_not_pairs(monkeypatch):
    """40,000 spots in two columns: all pairs would be 1.6e9 distances."""
    z = np.sort(np.random.default_rng(1).normal(size=20_000))
    block = np.array([[0.0, 0.1]]), np.array([0, 20_000, 40_000]), np.concatenate([z, z]), np.ones(40_000, np.int64)
    searched, real = [], np.searchsorted
    monkeypatch.setattr(neighbours.np, "searchsorted", lambda keys, wanted, *a: searched.append(len(wanted)) or real(keys, wanted, *a))
    counts = np.zeros(40_000, np.int64)
    neighbours.add_counts(counts, block, block, 0.5, 1)
    assert sum(searched) == 2 * 2 * 40_000
    for i in (0, 777, 39_999):
        apart = [np.sqrt((block[0][0, i // 20_000] - f) ** 2 + (block[2][i] - z) ** 2) for f in (0.0, 0.1)]
        assert counts[i] == sum((a <= 0.5).sum() for a in apart)
