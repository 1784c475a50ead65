"""Shared-pass K-Means against single fits, planted clusters, and odd rows."""

import numpy as np
import pytest

from basketry.operators import kmeans, segments


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "customer_id long, " + ", ".join(f"f{d} double" for d in range(x.shape[1]))).cache()


def cost_of(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1).sum()


@pytest.mark.parametrize("kind", ["blobs", "uniform", "long tail", "lattice", "one dimension"])
def test_no_dearer_than_single_fits(spark, kind):
    rng = np.random.default_rng(3)
    x = {"blobs": np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1), (3, 3, 3))]),
         "uniform": rng.random((300, 2)), "long tail": rng.lognormal(0, 1, (300, 3)),
         "lattice": np.array([(i % 10, i // 10) for i in range(200)]), "one dimension": np.sort(rng.normal(size=(250, 1)), 0)}[kind]
    names = [f"f{d}" for d in range(x.shape[1])]
    df = table(spark, x)
    found = kmeans.fit_all(df, names, "customer_id", (3, 4), 6, 42)
    from pyspark.ml.feature import VectorAssembler
    vectors = VectorAssembler(inputCols=names, outputCol="scaled").transform(df)
    for k, (centres, cost) in found.items():
        assert centres.shape == (k, x.shape[1]) and cost == pytest.approx(cost_of(x, centres))
        single = segments.fit_kmeans(vectors, k, restarts=3, seed=42)
        assert cost <= single.summary.trainingCost * 1.02
        labelled = kmeans.model_of(centres).transform(vectors).collect()
        near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        assert [r["cluster"] for r in sorted(labelled, key=lambda r: r["customer_id"])] == near.tolist()


def test_planted_clusters_and_repeatability(spark):
    rng = np.random.default_rng(4)
    middles = np.array([(0, 0), (10, 0), (0, 10), (10, 10), (5, 5)])
    x = np.concatenate([rng.normal(c, 0.2, (80, 2)) for c in middles])
    df = table(spark, x)
    found, again = (kmeans.fit_all(part, ["f0", "f1"], "customer_id", (5,), 4, 1)[5] for part in (df, df.repartition(7)))
    assert np.abs(found[0][np.lexsort(found[0].round(1).T)] - middles[np.lexsort(middles.T)]).max() < 0.15
    assert found[0] == pytest.approx(again[0])


def test_fewer_rows_than_clusters(spark):
    same = table(spark, np.ones((20, 2)))
    centres, cost = kmeans.fit_all(same, ["f0", "f1"], "customer_id", (3,), 2, 1)[3]
    assert centres.tolist() == [[1.0, 1.0]] and cost == 0
    assert len(kmeans.fit_all(same.where("f0 > 2"), ["f0", "f1"], "customer_id", (3,), 2, 1)[3][0]) == 0
    odd = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, None), (None, 4.0)], "customer_id long, f0 double")
    assert sorted(kmeans.fit_all(odd, ["f0"], "customer_id", (2,), 2, 1)[2][0].ravel().tolist()) == [0.0, 4.0]


def test_model_is_saved(spark, tmp_path):
    model = kmeans.model_of(np.array([[0.0, 1.0], [2.0, 3.0]]))
    model.write().overwrite().save(str(tmp_path / "model"))
    from pyspark.ml.clustering import KMeansModel
    assert [c.tolist() for c in KMeansModel.load(str(tmp_path / "model")).clusterCenters()] == [[0.0, 1.0], [2.0, 3.0]]
