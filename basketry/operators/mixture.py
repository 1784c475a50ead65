"""Gaussian mixtures from a K-Means start: expectation-maximisation over mergeable moments, one job per round.

Tasks weigh their Arrow batches with all components at once and return, per component, the sum of responsibilities and first
and second moments around its mean, added as decimals and so independent of order. Only these rows, one per
component, come to the driver. Variances along the axes of a component are at least FLOOR, which is the maximum under that bound,
so the likelihood never falls.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.clustering import GaussianMixtureModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import kmeans

FLOOR = 1e-6


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of the components, and the mean log-likelihood of the rows before every round and at the end."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihoods: list[float]


def responsibilities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x components) shares and the log-likelihood per row; components of weight 0 have none."""
    logs = np.empty((len(x), len(weights)))
    with np.errstate(divide="ignore"):
        shares = np.log(weights)
    for k, (mean, covariance) in enumerate(zip(means, covariances)):
        lower = np.linalg.cholesky(covariance)
        apart = np.linalg.solve(lower, (x - mean).T)
        logs[:, k] = shares[k] - 0.5 * (x.shape[1] * np.log(2 * np.pi) + (apart**2).sum(0)) - np.log(np.diag(lower)).sum()
    most = logs.max(1, keepdims=True)
    total = np.exp(logs - most)
    return total / total.sum(1, keepdims=True), (most[:, 0] + np.log(total.sum(1)))


def _moments(points: DataFrame, n: int, share, means: np.ndarray) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
    """Per component (responsibility, log-likelihood, first and second moments around its mean) by `share(x)`."""
    names = ["n", "loss", *[f"m{d}" for d in range(n)], *[f"s{d}_{e}" for d in range(n) for e in range(d + 1)]]

    def add(batches):
        total = np.zeros((len(means), len(names)))
        for _, x in kmeans._batches(batches, n):
            weight, likelihood = share(x)
            total[0, 1] += likelihood.sum()
            for k, mean in enumerate(means):
                apart = x - mean
                second = (apart * weight[:, [k]]).T @ apart
                total[k, 0] += weight[:, k].sum()
                total[k, 2:] += [*(weight[:, k] @ apart), *(second[d, e] for d in range(n) for e in range(d + 1))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(means), dtype=np.int32)), *map(pa.array, total.T.copy())],
                                         names=["component", *names])

    rows = points.mapInArrow(add, "component int, " + ", ".join(f"{c} double" for c in names)).groupBy("component").agg(
        *[F.sum(F.col(c).cast(kmeans.EXACT)).cast("double").alias(c) for c in names]).collect()
    found = {}
    for r in rows:
        second = np.zeros((n, n))
        for d in range(n):
            for e in range(d + 1):
                second[d, e] = second[e, d] = r[f"s{d}_{e}"]
        found[r.component] = r.n, r.loss, np.array([r[f"m{d}"] for d in range(n)]), second
    return found


def _maximised(moments: dict, means: np.ndarray, covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    weights, means, covariances = np.zeros(len(means)), means.copy(), covariances.copy()
    for k, (count, _, first, second) in moments.items():
        weights[k] = count
        if count <= 0:
            continue  # stays where it is, without weight
        moved = first / count
        values, axes = np.linalg.eigh(second / count - np.outer(moved, moved))
        means[k], covariances[k] = means[k] + moved, (axes * np.maximum(values, FLOOR)) @ axes.T
    return weights / weights.sum(), means, covariances


def fit(rows: DataFrame, features: Sequence[str], centres: np.ndarray, iterations: int = 100, tolerance: float = 1e-3,
        key: str = "customer_id") -> Mixture:
    """The mixture that starts from rows dealt to the nearest of `centres`, until the mean log-likelihood gains less than `tolerance`.

    Rows with a null feature take no part; no rows are an error. Rows are packed into blocks of numbers once,
    which all rounds read.
    """
    if not len(centres):
        raise ValueError("a mixture needs rows")
    points = kmeans.blocks(rows, features, key).persist()
    try:
        return _fitted(points, len(features), centres, iterations, tolerance)
    finally:
        points.unpersist()


def _fitted(points: DataFrame, n: int, centres: np.ndarray, iterations: int, tolerance: float) -> Mixture:
    def nearest(x):
        near = kmeans._squared(x, centres).argmin(1)
        return np.eye(len(centres))[near], np.zeros(len(x))

    state = _maximised(_moments(points, n, nearest, centres), centres, np.tile(np.eye(n), (len(centres), 1, 1)))
    likelihoods = []
    for turn in range(iterations + 1):
        moments = _moments(points, n, lambda x, held=state: responsibilities(x, *held), state[1])
        likelihoods.append(moments[0][1] / sum(m[0] for m in moments.values()))
        if turn == iterations or (turn and likelihoods[-1] - likelihoods[-2] < tolerance):
            break
        state = _maximised(moments, state[1], state[2])
    return Mixture(*state, likelihoods)


def model_of(mixture: Mixture, features_col: str = "scaled", label_col: str = "mixture", share_col: str = "shares") -> GaussianMixtureModel:
    """A saveable Spark model with these components; those without weight are left out."""
    context = SparkContext._active_spark_context
    linalg, gateway = context._jvm.org.apache.spark.ml.linalg, context._gateway
    held = np.flatnonzero(mixture.weights > 0)
    normal = context._jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian
    gaussians = gateway.new_array(normal, len(held))
    for place, k in enumerate(held):
        n = len(mixture.means[k])
        gaussians[place] = normal(linalg.DenseVector(kmeans._doubles(mixture.means[k])),
                                  linalg.DenseMatrix(n, n, kmeans._doubles(mixture.covariances[k].ravel())))
    name = f"GaussianMixture_{abs(hash(mixture.means.tobytes())):x}"
    model = GaussianMixtureModel(context._jvm.org.apache.spark.ml.clustering.GaussianMixtureModel(
        name, kmeans._doubles(mixture.weights[held]), gaussians))
    return model.setFeaturesCol(features_col).setPredictionCol(label_col).setProbabilityCol(share_col)
