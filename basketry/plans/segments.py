"""Queries over customer segments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.operators import cluster_metrics, density, segments
from basketry.operators.features import RFM, standardised
from basketry.plans.fitted import once
from basketry.plans.lines import churn_table, rfm_table, rounded
from basketry.session import staged
from basketry.sources.retail import crm_export as export_columns
from basketry.sources.star import retail_lines


def _customers(spark, folder) -> DataFrame:
    """The RFM table, written once and read by every pass over it."""
    return once(spark, folder, "rfm", lambda: staged(rfm_table(spark, folder), "rfm"))


def _points(spark, folder) -> DataFrame:
    return once(spark, folder, "points", lambda: staged(standardised(_customers(spark, folder), RFM), "points"))


def _fixed_labels(spark, folder) -> DataFrame:
    """Points with a label that is no model's: 2 bands of spending by 2 of frequency."""
    label = (F.col("Monetary") > 0).cast("int") * 2 + (F.col("Frequency") > 0).cast("int")
    return _points(spark, folder).withColumn("label", label)


def _segmentation(spark, folder):
    return once(spark, folder, "segmentation", lambda: segments.segment(_customers(spark, folder)))


def _segmented(spark, folder) -> DataFrame:
    return segments.assign(_segmentation(spark, folder), _customers(spark, folder))


def silhouette(spark, folder):
    """The Euclidean form, from the distances to all rows at any size; those between far boxes come from grids, see `silhouettes_exact`."""
    score = cluster_metrics.silhouette_exact(_fixed_labels(spark, folder), RFM, "label", "customer_id")
    return rounded(score, 6, "silhouette")


def silhouette_squared(spark, folder):
    score = cluster_metrics.silhouette_squared(_fixed_labels(spark, folder), RFM, "label")
    return rounded(score, 6, "silhouette")


def davies_bouldin(spark, folder):
    return rounded(cluster_metrics.davies_bouldin(_fixed_labels(spark, folder), RFM, "label"), 6, "davies_bouldin")


def kmeans_k_selection(spark, folder):
    return _segmentation(spark, folder).scores


def kmeans_k_selection_euclidean(spark, folder):
    """The choice by the Euclidean silhouette, from the distances to all rows; those between far boxes come from grids, see `silhouettes_exact`."""
    return once(spark, folder, "segmentation-euclidean", lambda: segments.segment(_customers(spark, folder), measure="euclidean")).scores


def kmeans_segments(spark, folder):
    return _segmented(spark, folder)


def cluster_profile(spark, folder):
    return segments.with_persona(segments.cluster_profile(_segmented(spark, folder)))


def _banded(spark, folder) -> DataFrame:
    """Customers in clusters that no model made: bands of recency and frequency."""
    band = F.least(F.floor(F.col("Recency") / 60), F.lit(4)) * 10 + F.least(F.floor(F.col("Frequency") / 3), F.lit(3))
    return _customers(spark, folder).withColumn("Cluster_KMeans", band)


def banded_profile(spark, folder):
    return segments.with_persona(segments.cluster_profile(_banded(spark, folder)))


def banded_personas(spark, folder):
    return rounded(segments.customer_personas(_banded(spark, folder)), 2, "Monetary")


def banded_export(spark, folder):
    return rounded(export_columns(segments.customer_personas(_banded(spark, folder))), 2, "Monetary")


def persona_rules(spark, folder):
    """Persona rules applied to every single customer."""
    return rounded(segments.with_persona(_customers(spark, folder)), 2, "Monetary")


def customer_personas(spark, folder):
    return segments.customer_personas(_segmented(spark, folder))


def crm_export(spark, folder):
    return export_columns(customer_personas(spark, folder))


def eps_neighbours(spark, folder):
    return density.neighbour_counts(_points(spark, folder), RFM)


def dbscan_core_points(spark, folder):
    return density.core_points(_points(spark, folder), RFM)


def dbscan_segments(spark, folder):
    return once(spark, folder, "dbscan", lambda: staged(density.dbscan(_points(spark, folder), RFM), "dbscan"))


def outliers(spark, folder) -> DataFrame:
    """Customers outside of every density cluster, with their features."""
    noise = dbscan_segments(spark, folder).where(F.col("Cluster_DBSCAN") == density.NOISE)
    return _customers(spark, folder).join(noise, "customer_id")


def top_outliers(spark, folder):
    top = outliers(spark, folder).orderBy(F.desc("Monetary"), "customer_id").limit(5)
    return rounded(top, 2, "Monetary")


def _mixture(spark, folder) -> DataFrame:
    pipeline = once(spark, folder, "mixture", lambda: segments.fit_mixture(
        _customers(spark, folder), _segmentation(spark, folder).k))
    return segments.mixture_segments(pipeline, _customers(spark, folder))


def gmm_segments(spark, folder):
    return _mixture(spark, folder)


def borderline_customers(spark, folder):
    return segments.borderline_customers(_mixture(spark, folder))


def borderline_rule(spark, folder):
    """The least confident customers under a confidence that no model made, with many ties."""
    confidence = (F.col("customer_id") * 37 % 101) / 101.0
    return rounded(segments.borderline_customers(_customers(spark, folder).withColumn("GMM_Confidence", confidence)),
                   8, "GMM_Confidence").select("customer_id", "GMM_Confidence")


def fixed_scoring(spark, folder):
    """Segment names of all customers by the nearest of four given centres, which no fit has moved."""
    customers = _customers(spark, folder).select("customer_id", "Recency", "Frequency")
    return segments.score_segments(segments.given_centres(
        ("Recency", "Frequency"), [(10.0, 9.0), (10.0, 2.0), (200.5, 9.0), (200.5, 2.0)]), customers)


SERVICE_FEATURES = ("Frequency", "Monetary", "Tenure")


def segment_scoring(spark, folder):
    """Requests (frequency, monetary value, tenure) of all customers against a saved-form pipeline."""
    customers = churn_table(spark, folder).select("customer_id", *SERVICE_FEATURES)
    requests = once(spark, folder, "segment-requests", lambda: staged(customers, "requests"))
    scoring = once(spark, folder, "segment-scoring", lambda: segments.segment(
        requests, SERVICE_FEATURES, log=False, ks=(len(fixed.SEGMENTS),)).pipeline)
    return segments.score_segments(scoring, requests)


def segment_names(spark, folder):
    """Name and description of a segment id per customer; ids 0..5, of which two have no name."""
    ids = retail_lines(spark, folder, "customer_id").distinct().withColumn(
        "segment_id", (F.col("customer_id") % 6).cast("int"))
    return ids.withColumns({"segment_name": segments.segment_name(F.col("segment_id")),
                            "description": segments.segment_description(F.col("segment_id"))})


QUERIES = {
    "silhouette": silhouette,
    "silhouette_squared": silhouette_squared,
    "davies_bouldin": davies_bouldin,
    "kmeans_k_selection": kmeans_k_selection,
    "kmeans_k_selection_euclidean": kmeans_k_selection_euclidean,
    "kmeans_segments": kmeans_segments,
    "cluster_profile": cluster_profile,
    "banded_profile": banded_profile,
    "banded_personas": banded_personas,
    "banded_export": banded_export,
    "borderline_rule": borderline_rule,
    "fixed_scoring": fixed_scoring,
    "persona_rules": persona_rules,
    "customer_personas": customer_personas,
    "crm_export": crm_export,
    "eps_neighbours": eps_neighbours,
    "dbscan_core_points": dbscan_core_points,
    "dbscan_segments": dbscan_segments,
    "top_outliers": top_outliers,
    "gmm_segments": gmm_segments,
    "borderline_customers": borderline_customers,
    "segment_scoring": segment_scoring,
    "segment_names": segment_names,
}
