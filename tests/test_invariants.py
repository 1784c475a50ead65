"""Queries that no SQL can follow, as their models come from a fit: what has to hold for any fit."""

from collections import Counter

import pytest

from basketry import fixed_values as fixed
from basketry.operators import churn
from basketry.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def rows(spark, folder):
    return lambda name: QUERIES[name](spark, folder).collect()


def unique(found, key="customer_id"):
    keys = [r[key] for r in found]
    assert len(set(keys)) == len(keys) > 0
    return set(keys)


def test_churn_predictions_cover_the_test_part_once(rows):
    found = rows("churn_predictions")
    everyone = unique(rows("churn_scoring"))
    assert unique(found) < everyone
    assert all(0 <= r.score <= 1 and r.prediction == (r.score > 0.5) for r in found)
    quality = rows("churn_quality")[0]
    assert quality.n == len(found) and quality.accuracy == pytest.approx(
        sum(r.prediction == r.Churn for r in found) / len(found)) and 0 <= quality.auc <= 1


def test_scoring_bands_follow_the_probability(rows):
    for r in rows("churn_scoring"):
        assert 0 <= r.churn_probability <= 1
        if abs(r.churn_probability - 0.7) > 0.001 and abs(r.churn_probability - 0.4) > 0.001:
            level = "High" if r.churn_probability > 0.7 else "Medium" if r.churn_probability > 0.4 else "Low"
            assert r.risk_level == f"{level} Risk"


def test_contributions_add_up_to_the_margin(rows):
    found = rows("churn_contributions")
    assert unique(found) == unique(rows("churn_predictions"))
    for r in found:
        assert r.base_value + sum(r[c] for c in churn.ALL_FEATURES) == pytest.approx(r.margin)
    summary = {r.feature: r.mean_contribution for r in rows("contribution_summary")}
    assert set(summary) == set(churn.ALL_FEATURES)
    for name, mean in summary.items():
        assert mean == pytest.approx(sum(abs(r[name]) for r in found) / len(found))
    importance = rows("feature_importance")
    assert sum(r.importance for r in importance) == pytest.approx(1) and len(importance) == len(churn.ALL_FEATURES)


def test_segments_keep_every_customer(rows):
    scores = rows("kmeans_k_selection")
    chosen = [r for r in scores if r.selected]
    assert [r.k for r in scores] == list(fixed.K_RANGE) and len(chosen) == 1
    assert chosen[0].silhouette == max(r.silhouette for r in scores)
    found = rows("kmeans_segments")
    sizes = Counter(r.Cluster_KMeans for r in found)
    assert set(sizes) <= set(range(chosen[0].k))
    profile = {r.Cluster_KMeans: r for r in rows("cluster_profile")}
    assert {c: r.Count for c, r in profile.items()} == dict(sizes)
    named = rows("customer_personas")
    assert unique(named) == unique(found)
    assert all(r.Persona == profile[r.Cluster_KMeans].Persona for r in named)
    assert {(r.customer_id, r.Persona) for r in rows("crm_export")} == {(r.customer_id, r.Persona) for r in named}


def test_mixture_confidence_is_a_share(rows):
    found = rows("gmm_segments")
    assert unique(found) == unique(rows("kmeans_segments"))
    assert all(0 < r.GMM_Confidence <= 1 + 1e-9 for r in found)
    least = sorted((r.GMM_Confidence, r.customer_id) for r in found)[:5]
    assert [(r.GMM_Confidence, r.customer_id) for r in rows("borderline_customers")] == least


def test_scored_segments_have_the_fixed_names(rows):
    names = {number: (name, text) for number, name, text in fixed.SEGMENTS}
    found = rows("segment_scoring")
    unique(found)
    assert all((r.segment_name, r.description) == names[r.segment_id] for r in found)


@pytest.mark.parametrize("name", ["forecast_seasonal_ridge", "forecast_autoregressive", "forecast_one_step"])
def test_forecasts_cover_the_holdout(rows, name):
    sizes = Counter(r.stockcode for r in rows(name))
    assert sizes and set(sizes.values()) == {fixed.HOLDOUT_DAYS}


def test_top_products_have_one_model_each(rows):
    found = rows("top_product_models")
    assert len(unique(found, "stockcode")) <= fixed.TOP_PRODUCTS
    assert all(r.final_mape <= r.seasonal_mape for r in found)
