"""Contributions against the definition of the Shapley value, and against Spark's own scores."""

from itertools import combinations
from math import exp, factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketry.operators import attribution, churn


@pytest.fixture(scope="module")
def fitted(spark):
    customers = spark.range(240).select(
        F.col("id").alias("customer_id"),
        *[((F.xxhash64("id", F.lit(name)) % 100) / 10.0).alias(name) for name in ("a", "b", "c")])
    customers = customers.withColumn("Churn", (F.col("a") + F.col("b") * F.col("c") / 5 > 2).cast("int")).coalesce(1)
    variant = churn.Variant(("a", "b", "c"), 4, 3, 0.3)
    return churn.fit_churn(customers, variant), customers


def definition(trees, row):
    """Shapley values from every subset of features."""
    def value(known):
        total = trees.base
        for leaf, conditions in trees.leaves:
            reached, expected = 1.0, 1.0
            for feature, above, upto, share in conditions:
                reached *= (above < row[feature] <= upto) if feature in known else share
                expected *= share
            total += leaf * (reached - expected)
        return total

    n = len(row)
    result = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        result.append(sum(
            factorial(size) * factorial(n - size - 1) / factorial(n) * (value({*s, i}) - value(set(s)))
            for size in range(n) for s in combinations(others, size)))
    return result


def test_values_follow_the_definition(spark, fitted):
    model, customers = fitted
    trees = attribution.read_trees(model, spark)
    rows = np.array([[r.a, r.b, r.c] for r in customers.limit(12).collect()])
    found = attribution.shapley(trees, rows)
    for row, mine in zip(rows, found):
        assert mine == pytest.approx(definition(trees, row), abs=1e-9)


def test_contributions_add_up_to_the_margin_of_the_model(fitted):
    model, customers = fitted
    scores = {r.customer_id: r.p for r in model.transform(customers).select(
        "customer_id", vector_to_array("probability")[1].alias("p")).collect()}
    explained = attribution.contributions(model, customers).collect()
    assert len(explained) == customers.count()
    for row in explained:
        assert row.base_value + row.a + row.b + row.c == pytest.approx(row.margin, abs=1e-9)
        assert 1 / (1 + exp(-2 * row.margin)) == pytest.approx(scores[row.customer_id], abs=1e-9)


def test_summary_orders_by_mean_size(fitted):
    model, customers = fitted
    explained = attribution.contributions(model, customers)
    summary = attribution.contribution_summary(explained, ("a", "b", "c")).collect()
    sizes = [row.mean_contribution for row in summary]
    assert sizes == sorted(sizes, reverse=True) and {row.feature for row in summary} == {"a", "b", "c"}
