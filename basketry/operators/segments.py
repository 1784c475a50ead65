"""Customer segments: K-Means with a searched number of clusters, personas, Gaussian mixtures."""

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.columns import half_even, persona, segment_description, segment_name
from basketry.functions.lookups import lookup
from basketry.operators import mixture
from basketry.operators.cluster_metrics import davies_bouldin, silhouette_squared, silhouettes_exact
from basketry.operators.features import RFM
from basketry.operators.kmeans import fit_all, model_of

SCALED = "_scaled"


def scaler(customers: DataFrame, features: Sequence[str] = RFM, log: bool = True) -> PipelineModel:
    """A saveable pipeline adding scaled feature columns and their vector.

    log1p is optional; z-scores use the population deviation, and a constant feature becomes 0. Only
    one row of means and deviations comes to the driver, as the parameters of the pipeline.
    """
    def source(c):
        return f"log1p({c})" if log else f"CAST({c} AS DOUBLE)"

    stats = customers.agg(*[F.expr(f"avg({source(c)})").alias(f"{c}_mean") for c in features],
                          *[F.expr(f"stddev_pop({source(c)})").alias(f"{c}_dev") for c in features]).first()
    columns = ", ".join(
        f"({source(c)} - {stats[f'{c}_mean']!r}D) / {stats[f'{c}_dev'] or 1.0!r}D AS {c}{SCALED}" for c in features)
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}{SCALED}" for c in features], outputCol="scaled")])


def scaled_names(features: Sequence[str] = RFM) -> list[str]:
    return [f"{c}{SCALED}" for c in features]


def fit_kmeans(scaled: DataFrame, k: int, restarts: int = fixed.RESTARTS, seed: int = fixed.SPLIT_SEED,
               parallelism: int = 4) -> KMeansModel:
    """The cheapest of `restarts` fits with seeds seed, seed + 1, ...; the first of equal ones."""
    def fit(number):
        return KMeans(k=k, seed=seed + number, featuresCol="scaled", predictionCol="cluster").fit(scaled)

    with ThreadPool(min(parallelism, restarts)) as pool:
        fits = pool.map(inheritable_thread_target(scaled.sparkSession)(fit), range(restarts))
    return min(fits, key=lambda model: model.summary.trainingCost)


@dataclass(frozen=True)
class Segmentation:
    """A fitted scaling + clustering pipeline, and one row of scores per tried k."""

    pipeline: PipelineModel
    k: int
    scores: DataFrame


def segment(customers: DataFrame, features: Sequence[str] = RFM, log: bool = True,
            ks: Sequence[int] = fixed.K_RANGE, restarts: int = fixed.RESTARTS, seed: int = fixed.SPLIT_SEED,
            key: str = "customer_id", measure: str = "squared_euclidean") -> Segmentation:
    """Tries every k and keeps the one with the strictly largest silhouette, the first of equal ones.

    All starts of all k are fitted in shared passes. `measure` is the distance of the silhouette: `squared_euclidean` takes one pass
    at every size, `euclidean` the distances to all rows, whose work grows faster than the rows (`silhouettes_exact`). A fit that found one
    cluster only has none, which counts as the lowest.
    """
    if measure not in ("squared_euclidean", "euclidean"):
        raise ValueError(f"unknown measure: {measure}")
    scaling = scaler(customers, features, log)
    scaled = scaling.transform(customers).select(key, "scaled", *scaled_names(features)).persist()
    rows, best, best_k, best_score = [], None, None, None
    try:
        fitted = fit_all(scaled, scaled_names(features), key, ks, restarts, seed)
        models = {k: model_of(fitted[k][0]) for k in ks}
        euclidean = _euclidean(scaled, models, features, key) if measure == "euclidean" else {}
        for k in ks:
            model = models[k]
            labelled = model.transform(scaled)
            quality = euclidean.get(k) or silhouette_squared(labelled, scaled_names(features), "cluster").first()
            index = davies_bouldin(labelled, scaled_names(features), "cluster").first()
            rows.append((k, quality.silhouette, quality.measure, index.davies_bouldin))
            score = float("-inf") if quality.silhouette is None else quality.silhouette
            if best is None or score > best_score:
                best, best_k, best_score = model, k, score
    finally:
        scaled.unpersist()
    k = best_k
    scores = customers.sparkSession.createDataFrame(
        [(*row, row[0] == k) for row in rows],
        "k int, silhouette double, measure string, davies_bouldin double, selected boolean")
    return Segmentation(PipelineModel([*scaling.stages, best]), k, scores)


def _euclidean(scaled: DataFrame, models: dict[int, KMeansModel], features: Sequence[str], key: str) -> dict[int, Row]:
    """The Euclidean silhouette of every model, from one pass over all distances."""
    labelled = scaled
    for k, model in models.items():
        labelled = model.transform(labelled).withColumnRenamed("cluster", f"_cluster_{k}")
    found = silhouettes_exact(labelled, scaled_names(features), [f"_cluster_{k}" for k in models], key).collect()
    return {int(r.label.removeprefix("_cluster_")): r for r in found}


def assign(segmentation: Segmentation, customers: DataFrame) -> DataFrame:
    """Customers with Cluster_KMeans, carried by row and not by position."""
    labelled = segmentation.pipeline.transform(customers)
    return labelled.select(*customers.columns, F.col("cluster").alias("Cluster_KMeans"))


def cluster_profile(segments: DataFrame, label: str = "Cluster_KMeans") -> DataFrame:
    """Mean Recency, Frequency and Monetary (2 digits, ties to even) and Count per cluster."""
    return segments.groupBy(label).agg(
        *[half_even(F.avg(c), 2).alias(c) for c in RFM], F.count("customer_id").alias("Count"))


def with_persona(profile: DataFrame) -> DataFrame:
    """Adds Persona to cluster profiles; rules look at the rounded means and the first that holds wins."""
    return profile.withColumn("Persona", persona())


def customer_personas(segments: DataFrame, label: str = "Cluster_KMeans") -> DataFrame:
    """Every customer with the persona of its cluster."""
    names = with_persona(cluster_profile(segments, label)).select(label, "Persona")
    return lookup(segments, names, [label])


def fit_mixture(customers: DataFrame, k: int, features: Sequence[str] = RFM, log: bool = True,
                seed: int = fixed.SPLIT_SEED, iterations: int = 100, tolerance: float = 1e-3,
                key: str = "customer_id", restarts: int = fixed.RESTARTS) -> PipelineModel:
    """Scaling and a Gaussian mixture of `k` components, of fewer where rows are; it starts from the best of `restarts` K-Means fits."""
    scaling = scaler(customers, features, log)
    names = scaled_names(features)
    scaled = scaling.transform(customers).select(key, *names).persist()
    try:
        centres, _ = fit_all(scaled, names, key, [k], restarts, seed)[k]
        model = mixture.model_of(mixture.fit(scaled, names, centres, iterations, tolerance, key))
    finally:
        scaled.unpersist()
    return PipelineModel([*scaling.stages, model])


def mixture_segments(pipeline: PipelineModel, customers: DataFrame) -> DataFrame:
    """Customers with Cluster_GMM and GMM_Confidence, the probability of that cluster."""
    scored = pipeline.transform(customers)
    return scored.select(*customers.columns, F.col("mixture").alias("Cluster_GMM"),
                         F.array_max(vector_to_array("shares")).alias("GMM_Confidence"))


def borderline_customers(mixture: DataFrame, n: int = 5) -> DataFrame:
    """The `n` customers with the lowest confidence."""
    return mixture.orderBy("GMM_Confidence", "customer_id").limit(n)


def given_centres(features: Sequence[str], centres: Sequence[Sequence[float]]) -> PipelineModel:
    """A saveable pipeline to the nearest of `centres` in plain units; the first of equally near ones."""
    apart = ", ".join(" + ".join(f"pow({c} - {float(x)!r}D, 2)" for c, x in zip(features, centre)) for centre in centres)
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, array({apart}) AS _apart FROM __THIS__"),
        SQLTransformer(statement="SELECT *, CAST(array_position(_apart, array_min(_apart)) - 1 AS INT) AS cluster FROM __THIS__")])


def score_segments(pipeline: PipelineModel, requests: DataFrame, segments=fixed.SEGMENTS) -> DataFrame:
    """Scoring response per request row: segment id, name and description. Serves streams as well.

    Ids outside the name table become Unknown with an empty description.
    """
    scored = pipeline.transform(requests).select(*requests.columns, F.col("cluster").alias("segment_id"))
    return scored.withColumns({
        "segment_name": segment_name(F.col("segment_id"), segments),
        "description": segment_description(F.col("segment_id"), segments)})
