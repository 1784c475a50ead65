"""Mixtures from a K-Means start against plain expectation-maximisation, Spark's fit and planted components."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from basketry.operators import kmeans, mixture, segments

CENTRES = np.array([[0.0, 0.0], [6.0, 1.0], [1.0, 7.0]])


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    parts = [rng.normal(c, s, (n, 2)) for c, s, n in zip(CENTRES, ([1, 0.3], [0.5, 0.5], [0.4, 1.2]), (300, 200, 100))]
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(np.concatenate(parts))]
    return spark.createDataFrame(rows, "customer_id long, a double, b double").persist()


@pytest.fixture(scope="module")
def fitted(planted):
    centres = kmeans.fit_all(planted, ("a", "b"), "customer_id", [3], 5, 1)[3][0]
    return centres, mixture.fit(planted, ("a", "b"), centres, tolerance=1e-6)


def test_planted_components_are_found_and_the_likelihood_never_falls(fitted):
    _, found = fitted
    order = [int(((found.means - c) ** 2).sum(1).argmin()) for c in CENTRES]
    assert sorted(order) == [0, 1, 2]
    assert found.means[order] == pytest.approx(CENTRES, abs=0.3)
    assert found.weights[order] == pytest.approx([0.5, 1 / 3, 1 / 6], abs=0.03)
    assert [found.covariances[order[0]][d, d] for d in (0, 1)] == pytest.approx([1, 0.09], rel=0.25)
    assert all(later >= earlier - 1e-9 for earlier, later in zip(found.likelihoods, found.likelihoods[1:]))


def test_rounds_are_those_of_plain_sums(planted, fitted):
    centres, _ = fitted
    rounds = 3
    found = mixture.fit(planted, ("a", "b"), centres, iterations=rounds, tolerance=-1.0)
    x = [tuple(r)[1:] for r in planted.orderBy("customer_id").collect()]
    share = [[float(k == min(range(3), key=lambda j: (p[0] - centres[j][0]) ** 2 + (p[1] - centres[j][1]) ** 2)) for k in range(3)] for p in x]
    for turn in range(rounds + 1):
        held = []
        for k in range(3):
            n = sum(s[k] for s in share)
            m = [sum(s[k] * p[d] for s, p in zip(share, x)) / n for d in (0, 1)]
            c = [[sum(s[k] * (p[d] - m[d]) * (p[e] - m[e]) for s, p in zip(share, x)) / n for e in (0, 1)] for d in (0, 1)]
            held.append((n / len(x), m, c))
        if turn == rounds:
            break
        share = []
        for p in x:
            dens = []
            for w, m, c in held:
                det = c[0][0] * c[1][1] - c[0][1] ** 2
                u, v = p[0] - m[0], p[1] - m[1]
                dens.append(w * math.exp(-(c[1][1] * u * u - 2 * c[0][1] * u * v + c[0][0] * v * v) / (2 * det)) / (2 * math.pi * math.sqrt(det)))
            share.append([d / sum(dens) for d in dens])
    assert found.weights == pytest.approx([w for w, _, _ in held], abs=1e-8)
    assert found.means == pytest.approx(np.array([m for _, m, _ in held]), abs=1e-8)
    assert found.covariances == pytest.approx(np.array([c for _, _, c in held]), abs=1e-8)


def test_not_below_the_library_and_independent_of_partitions(planted, fitted):
    centres, found = fitted
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="scaled").transform(planted)
    library = GaussianMixture(k=3, seed=1, maxIter=100, tol=1e-6, featuresCol="scaled").fit(ready)
    assert found.likelihoods[-1] >= library.summary.logLikelihood / planted.count() - 1e-4
    again = mixture.fit(planted.repartition(7), ("a", "b"), centres, tolerance=1e-6)
    assert again.means == pytest.approx(found.means, abs=1e-9)
    model = mixture.model_of(found)
    x = np.array([tuple(r)[1:] for r in planted.orderBy("customer_id").collect()])
    share, _ = mixture.responsibilities(x, found.weights, found.means, found.covariances)
    scored = model.transform(ready).orderBy("customer_id").collect()
    assert np.array([r.shares.toArray() for r in scored]) == pytest.approx(share, abs=1e-8)
    assert [r.mixture for r in scored] == share.argmax(1).tolist()


def test_copies_constants_nulls_and_few_rows(spark, tmp_path):
    rows = [(k, 10, float(1 + k % 2), 5.0) for k in range(20)] + [(90, None, 1.0, 5.0)]
    customers = spark.createDataFrame(rows, "customer_id long, Recency int, Frequency double, Monetary double")
    known = customers.where(F.col("Recency").isNotNull())
    pipeline = segments.fit_mixture(known, 4)
    pipeline.write().save(str(tmp_path / "mixture"))
    found = segments.mixture_segments(PipelineModel.load(str(tmp_path / "mixture")), known).collect()
    assert len({(r.Frequency, r.Cluster_GMM) for r in found}) == 2 and all(r.GMM_Confidence > 0.99 for r in found)
    one = mixture.fit(customers, ("Recency", "Frequency"), np.array([[10.0, 1.0]]))
    assert one.weights.tolist() == [1.0] and one.means[0] == pytest.approx([10, 1.5])
    with pytest.raises(ValueError):
        mixture.fit(customers.limit(0), ("Frequency",), np.zeros((0, 1)))
