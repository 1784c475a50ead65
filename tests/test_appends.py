"""Run log and lines that loads are added to; a load that is written again adds nothing."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry import schemas
from basketry.operators import forecast, segments
from basketry.sources import models, retail

RUNS = "run_name string, kind string, key string, value string"


def log(spark, path):
    return sorted(map(tuple, retail.read_runs(spark, path).collect()))


def test_runs_are_added_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = [("Product_a", "param", "product_id", "a"), ("Product_a", "metric", "final_mape", "0.1")]
    retail.append_runs(spark.createDataFrame(first, RUNS), path, "2024-01-01")
    retail.append_runs(spark.createDataFrame([("Product_a", "metric", "final_mape", None)], RUNS), path, "2024-01-02")
    want = sorted([("2024-01-01", n, k, key, v) for n, k, key, v in first] + [("2024-01-02", "Product_a", "metric", "final_mape", None)], key=str)
    assert sorted(log(spark, path), key=str) == want
    retail.append_runs(spark.createDataFrame(first, RUNS), path, "2024-01-01")  # a retry
    retail.append_runs(spark.createDataFrame([], RUNS), path, "2024-01-03")
    assert sorted(log(spark, path), key=str) == want


def test_loads_of_lines_stand_beside_each_other(spark, tmp_path):
    path = str(tmp_path / "lines")

    def lines(day, n):
        at = datetime.datetime(2024, 1 + day, day + 1, 10)
        return spark.createDataFrame(
            [(f"i{day}{k}", "s", "d", k + 1.0, at, 2.5, 7, "x", 2.5 * (k + 1), at.year, at.month, at.day, "Monday") for k in range(n)],
            schemas.CLEAN_LINES)

    parts = [lines(0, 3), lines(1, 2)]
    for k, part in enumerate([*parts, parts[1]]):
        retail.append_lines(part, path, f"load-{min(k, 1)}")
    found = retail.read_clean_lines(spark, path, "parquet")
    assert found.columns == schemas.CLEAN_LINES.names
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, parts[0].unionByName(parts[1]).collect()))


def test_choice_of_k_by_either_distance(spark):
    rows = [(i, 1 + i % 3 + 40 * (i % 2), 1 + i % 2, 10.0 + i % 5 + 900 * (i % 2)) for i in range(60)]
    customers = spark.createDataFrame(rows, "customer_id long, Recency int, Frequency int, Monetary double")
    found = {m: segments.segment(customers, ks=(2, 3), restarts=2, measure=m) for m in ("squared_euclidean", "euclidean")}
    for measure, made in found.items():
        scores = made.scores.collect()
        assert {r.measure for r in scores} == {measure} and made.k == 2 and [r.k for r in scores if r.selected] == [2]
    with pytest.raises(ValueError):
        segments.segment(customers, measure="cosine")


def test_stored_forecasters_equal_the_refit(spark, tmp_path):
    path, start = str(tmp_path / "forecasters"), datetime.date(2023, 1, 1)
    rng = np.random.default_rng(7)
    rows = [(name, start + datetime.timedelta(days=i), float(v)) for name, n in (("a", 300), ("b", 250), ("c", 200), ("d", 20))
            for i, v in enumerate(rng.poisson(20 + 0.1 * np.maximum(np.arange(n) - 150, 0)))]
    dense = spark.createDataFrame(rows, "stockcode string, date date, quantity double")
    selected = spark.createDataFrame([("a", "seasonal"), ("b", "autoregressive"), ("c", "ensemble"), ("d", "ensemble")],
                                     "stockcode string, model_type string")
    requests = spark.createDataFrame([("a", 5), ("b", None), ("c", 7), ("c", 2), ("d", 3), ("nobody", 4)], "product_id string, days int")
    early, late = (F.lit(start + datetime.timedelta(days=d)) for d in (180, 299))
    for as_of, run in ((early, "2023-07-01"), (late, "2023-10-28"), (late, "2023-10-28")):
        models.append_forecasters(forecast.fit_forecasters(dense, selected, as_of), path, run)

    def answers(df):
        return sorted(map(str, df.collect()))

    refit = forecast.predict_demand(requests, dense, selected, late)
    assert models.read_forecasters(spark, path).count() == 4
    stored = forecast.predict_stored(requests, models.read_forecasters(spark, path))
    assert answers(stored) == answers(refit) and stored.where("status = 'ok'").count() == 5 + 30 + 7 + 2
    assert {r.product_id: r.status for r in stored.where("status <> 'ok'").collect()} == {"d": "no_history", "nobody": "no_model"}
    old = forecast.predict_stored(requests, models.read_forecasters(spark, path, "2023-07-01"))
    assert answers(old) == answers(forecast.predict_demand(requests, dense, selected, early))
    assert spark.read.parquet(path).count() == 8  # the repeated run added no row
