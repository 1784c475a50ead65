"""Summed distances through boxes against all distances one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import cluster_metrics, distance_sums
from basketry.operators.distance_sums import Block, Sums, boxes


def blocks(x, at, size, width):
    found = []
    for start in range(0, x.shape[1], size):
        order, table = boxes(x[:, start:start + size])
        found.append((start + order, Block(x[:, start + order], at[:, start + order], table, width)))
    return found


def every_distance(x, at, width):
    member = np.zeros((x.shape[1], width))
    for place in at:
        member[np.arange(x.shape[1]), place] = 1.0
    return np.concatenate([np.sqrt(((x[:, k:k + 500, None] - x[:, None]) ** 2).sum(0)) @ member for k in range(0, x.shape[1], 500)])


def drawn(n, kind, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3, n)) * [[1.0], [2.0], [0.5]] + 100.0
    if kind == "planes":
        x[1] = 4 * np.log1p(rng.integers(1, 9, n))
    if kind == "copies":
        x[:, : n // 2] = x[:, :1]
    if kind == "outlier":
        x[:, 7] = 1e6
    return x[:, np.lexsort(x[::-1])], np.stack([rng.integers(0, 3, n), 3 + rng.integers(0, 2, n)]).astype(np.uint8)


@pytest.mark.parametrize("kind", ["cloud", "planes", "copies", "outlier"])
def test_sums_are_those_of_all_distances(kind, monkeypatch):
    monkeypatch.setattr(distance_sums, "LEAF", 100)
    monkeypatch.setattr(distance_sums, "WORTH", 0.9)
    x, at = drawn(4_500, kind)
    found = blocks(x, at, 1_300, 5)
    expected = every_distance(x, at, 5)
    for order, block in found:
        sums = Sums(block)
        for _, other in found:
            sums.add(other)
        assert sums.result() == pytest.approx(expected[order], rel=1e-11, abs=1e-9)


def test_work_grows_slower_than_the_square(monkeypatch):
    points = [0]

    def counting(real):
        def add(totals, x, y, weights):
            points[0] += x.shape[1] * y.shape[1]
            real(totals, x, y, weights)
        return add

    for name in ("add_near", "add_far"):
        monkeypatch.setattr(distance_sums, name, counting(getattr(distance_sums, name)))
    shares = []
    for n in (15_000, 60_000):
        points[0] = 0
        x, at = drawn(n, "planes")
        (_, block), = blocks(x[[1, 0, 2]], at, n, 5)
        sums = Sums(block)
        sums.add(block)
        sums.result()
        shares.append(points[0] / n**2)
    assert shares[1] < 0.4 and shares[1] < shares[0] / 1.7


def test_rows_without_a_number_spoil_their_own_sums_only():
    x, at = drawn(3_000, "planes")
    x[2, 5] = np.nan
    (order, block), = blocks(x, at, 3_000, 5)
    sums = Sums(block)
    sums.add(block)
    found = np.empty((3_000, 5))
    found[order] = sums.result()
    expected = every_distance(x, at, 5)
    assert np.array_equal(np.isnan(found), np.isnan(expected)) and found == pytest.approx(expected, rel=1e-11, nan_ok=True)


def test_silhouette_of_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 12_000
    a, b, c = rng.normal(size=n).round(2), np.log1p(rng.integers(1, 6, n)), rng.normal(size=n)
    label = (a > 0).astype(int) + 2 * (c > 0.3)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (*r, k) in enumerate(zip(a, b, c, label))],
                               "id long, a double, b double, c double, label int").repartition(3)
    sums = every_distance(np.stack([a, b, c]), label[None], 4)
    sizes, each = np.bincount(label, minlength=4), np.arange(n)
    inside, means = sums[each, label] / (sizes[label] - 1), sums / sizes
    means[each, label] = np.inf
    nearest = means.min(1)
    expected = ((nearest - inside) / np.maximum(nearest, inside)).mean()
    for size in (None, 5_000):
        found = cluster_metrics.silhouette_exact(df, ["a", "b", "c"], "label", "id", **({"block_rows": size} if size else {})).first()
        assert found.silhouette == pytest.approx(expected, abs=1e-12) and found.n == n
    everyone = cluster_metrics.silhouette_exact(df.withColumn("a", F.lit(float("nan"))), ["a", "b", "c"], "label", "id").first()
    assert np.isnan(everyone.silhouette) or everyone.silhouette is None
