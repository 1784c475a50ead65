"""Density clusters against a plain comparison of all pairs on small point sets."""

import numpy as np
import pytest

from basketry.operators import density
from basketry.operators.components import connected

FEATURES = ["x", "y", "z"]


def brute(points, eps, least):
    """(core, labels) by comparing all pairs; points are in key order."""
    gaps = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)) <= eps
    core = gaps.sum(1) >= least
    labels = np.full(len(points), -1)
    cluster = 0
    for i in range(len(points)):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], frontier = cluster, [i]
        while frontier:
            at = frontier.pop()
            for j in np.flatnonzero(gaps[at]):
                if labels[j] < 0:
                    labels[j] = cluster
                    if core[j]:
                        frontier.append(j)
        cluster += 1
    return core, labels, gaps.sum(1)


def blobs(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(centre, spread, (n, 3)) for centre, spread, n in
             (((0, 0, 0), 0.15, 120), ((0.9, 0.2, 0), 0.15, 60), ((4, 4, 4), 0.3, 80))]
    return np.vstack([*parts, rng.uniform(-3, 6, (60, 3)), np.repeat([[2.0, -2.0, 2.0]], 12, axis=0)])


def frame(spark, points):
    rows = [(int(i), *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "customer_id long, x double, y double, z double").repartition(4)


@pytest.mark.parametrize("seed,budget", [(1, 1000), (2, 4)])
def test_clusters_equal_all_pairs(spark, seed, budget):
    points = blobs(seed)
    core, labels, neighbours = brute(points, 0.5, 10)
    df = frame(spark, points)
    found = {r.customer_id: r.Cluster_DBSCAN for r in density.dbscan(df, FEATURES, pair_budget=budget).collect()}
    assert [found[i] for i in range(len(points))] == labels.tolist()
    counts = {r.customer_id: r.neighbours for r in density.neighbour_counts(df, FEATURES, pair_budget=budget // 200 + 1).collect()}
    assert [counts[i] for i in range(len(points))] == neighbours.tolist()


def test_close_points_border_and_far_point(spark):
    points = np.array([[0.02 * i, 0, 0] for i in range(12)] + [[0.6, 0, 0], [9, 9, 9]])
    found = {r.customer_id: r.Cluster_DBSCAN for r in density.dbscan(frame(spark, points), FEATURES).collect()}
    assert [found[i] for i in range(14)] == [0] * 13 + [-1]
    core = {r.customer_id: r.is_core for r in density.core_points(frame(spark, points), FEATURES).collect()}
    assert core[0] and not core[12] and not core[13]


def test_nothing_dense_is_all_noise(spark):
    points = np.array([[3.0 * i, 0, 0] for i in range(5)])
    found = density.dbscan(frame(spark, points), FEATURES).collect()
    assert len(found) == 5 and {r.Cluster_DBSCAN for r in found} == {-1}


def test_components_of_a_chain_a_ring_and_a_single_node(spark):
    nodes = spark.range(40).withColumnRenamed("id", "id")
    chain = [(i, i + 1) for i in range(0, 19)]
    ring = [(20 + i, 20 + (i + 1) % 15) for i in range(15)]
    links = spark.createDataFrame(chain + ring, "u long, v long")
    roots = {r.id: r.root for r in connected(nodes, links).collect()}
    assert {roots[i] for i in range(20)} == {0}
    assert {roots[i] for i in range(20, 35)} == {20}
    assert all(roots[i] == i for i in range(35, 40))
