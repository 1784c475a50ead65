"""What a pass of K-Means reads and how it finds the nearest centres."""

import numpy as np
import pytest

from basketry.operators import kmeans


@pytest.mark.parametrize("k", [1, 7, 64, 65, 300])
def test_nearest_of_every_fit_far_from_the_origin(k):
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(500, 3)) + 1e6, rng.normal(size=(3 * k, 3)) + 1e6
    near = kmeans._nearest(x, centres, k)
    for fit in range(3):
        gaps = ((x[:, None] - centres[None, fit * k:(fit + 1) * k]) ** 2).sum(2)
        assert near[fit].tolist() == gaps.argmin(1).tolist()
    assert kmeans._apart(x, centres, near)[0] == pytest.approx(((x - centres[near[0]]) ** 2).sum(1))


def test_a_pass_adds_what_single_rows_add():
    rng = np.random.default_rng(6)
    x, fits = rng.normal(size=(400, 2)), [rng.normal(size=(2 * k, 2)) for k in (3, 5)]
    sums = [np.zeros((len(c), 4)) for c in fits]
    kmeans._added(sums, x, fits, (3, 5))
    for k, c, total in zip((3, 5), fits, sums):
        for fit in range(2):
            gaps = ((x[:, None] - c[None, fit * k:(fit + 1) * k]) ** 2).sum(2)
            for j in range(k):
                mine = gaps.argmin(1) == j
                assert total[fit * k + j] == pytest.approx([mine.sum(), gaps[mine, j].sum(), *x[mine].sum(0)])


def test_rows_of_one_file_are_dealt_over_all_cores_as_blocks(spark):
    df = spark.range(0, 9000, 1, 1).selectExpr("id AS customer_id", "CAST(id % 90 AS DOUBLE) AS a", "IF(id % 9 = 0, NULL, 1.0D) AS b")
    packed = kmeans.blocks(df, ["a", "b"], "customer_id")
    held = [sum(len(r.x) // 16 for r in part) for part in packed.rdd.glom().collect()]
    assert len(held) == spark.sparkContext.defaultParallelism and sum(held) == 8000 and min(held) > 500
    assert packed.count() <= 2 * len(held)
