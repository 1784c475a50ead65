"""The leakage check fits its models side by side, with the results of single fits."""

import threading

from basketry.operators import churn, metrics


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    df = spark.range(0, 400).selectExpr("id", "CAST(id % 40 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 40 > 20 OR id % 11 = 0 AS INT) AS Churn")
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    variants = {"both": churn.Variant(("a", "b"), 2, 2, 0.1), "one": churn.Variant(("b",), 2, 2, 0.1)}
    single = [(name, metrics.accuracy(churn.predict(churn.fit_churn(train, v), test), label="Churn").first().accuracy, 80) for name, v in variants.items()]
    met, real = threading.Barrier(2, timeout=30), churn.fit_churn
    monkeypatch.setattr(churn, "fit_churn", lambda *a, **o: (met.wait(), real(*a, **o))[1])
    assert [tuple(r) for r in churn.leakage_check(train, test, variants).collect()] == single
