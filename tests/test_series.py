import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import forecast, metrics, series

START = dt.date(2020, 1, 1)


def daily(spark, **values):
    """Daily rows per product from lists; None leaves the day out."""
    rows = [(code, START + dt.timedelta(days=i), float(v)) for code, vs in values.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "stockcode string, date date, quantity double")


def test_days_are_summed_and_missing_keys_left_out(spark):
    lines = spark.createDataFrame(
        [("a", dt.datetime(2020, 1, 1, 3), 2), ("a", dt.datetime(2020, 1, 1, 23), 3), ("b", dt.datetime(2020, 1, 2), None), (None, dt.datetime(2020, 1, 2), 1)],
        "stockcode string, invoicedate timestamp_ntz, quantity int")
    found = {(r.stockcode, r.date): r.quantity for r in series.daily_sales(lines).collect()}
    assert found == {("a", START): 5.0, ("b", START + dt.timedelta(days=1)): 0.0}


def test_gaps_become_zero(spark):
    dense = series.dense_daily_sales(daily(spark, one=[4], two=[1, None, None, 2, None, 3])).orderBy("stockcode", "date").collect()
    assert [r.quantity for r in dense if r.stockcode == "two"] == [1, 0, 0, 2, 0, 3]
    assert [r.quantity for r in dense if r.stockcode == "one"] == [4]
    assert [r.date for r in dense if r.stockcode == "two"] == [START + dt.timedelta(days=i) for i in range(6)]


def test_top_products_break_ties_by_code(spark):
    df = daily(spark, b=[5], a=[5], c=[9])
    assert [r.stockcode for r in series.top_products(df, 2).collect()] == ["c", "a"]
    assert {r.stockcode for r in series.only_products(df, series.top_products(df, 2)).collect()} == {"a", "c"}


@pytest.mark.parametrize("days,windows,test_rows,status", [
    (29, 0, 0, "too_short"), (30, 0, 0, "too_short"), (31, 1, 30, "too_short"), (60, 30, 30, "too_short"),
    (89, 59, 30, "too_short"), (90, 60, 30, "ok")])
def test_lengths_at_the_guards(spark, days, windows, test_rows, status):
    df = daily(spark, a=list(range(1, days + 1)))
    assert series.lag_windows(df).count() == windows
    assert series.holdout_split(df).where("split = 'test'").count() == test_rows
    assert series.forecastable_products(df).first().status == status
    assert series.with_status(df).first().status == status


def test_lag_window_holds_the_values_before_the_target(spark):
    rows = series.lag_windows(daily(spark, a=[1, 2, 3, 4]), 2).orderBy("date").collect()
    assert [(list(r.lags), r.target) for r in rows] == [([1, 2], 3), ([2, 3], 4)]


def test_min_max_and_back(spark):
    scaled = series.min_max_scaled(daily(spark, a=[2, 4, 6], b=[7, 7])).withColumn("back", series.unscaled(F.col("scaled")))
    rows = scaled.orderBy("stockcode", "date").collect()
    assert [r.scaled for r in rows] == [0, 0.5, 1, 0, 0] and [r.back for r in rows] == [2, 4, 6, 7, 7]
    fitted = series.min_max_scaled(daily(spark, a=[2, 4, 8]), F.col("quantity") < 8).orderBy("date").collect()
    assert [r.scaled for r in fitted] == [0, 1, 3]


def test_calendar_reaches_into_the_future(spark):
    rows = series.forecast_calendar(daily(spark, a=[1, None, 1]), 2).orderBy("date").collect()
    assert [r.is_future for r in rows] == [False, False, False, True, True]


def test_error_leaves_out_zero_actuals(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 4.0, 5.0), ("b", 0.0, 3.0)], "stockcode string, quantity double, forecast double")
    assert {r.stockcode: r.mape for r in metrics.mape(df).collect()} == {"a": 0.25, "b": 0.0}


def test_choice_among_equal_errors(spark):
    df = spark.createDataFrame(
        [("all", 0.5, 0.5, 0.5), ("two", 0.5, 0.4, 0.45), ("tie", 0.5, 0.5, 0.6), ("good", 0.1, 0.0, 0.0), ("alone", 0.5, None, None)],
        "stockcode string, seasonal_mape double, autoregressive_mape double, ensemble_mape double")
    found = {r.stockcode: (r.model_type, r.final_mape) for r in forecast.choose_model(df).collect()}
    assert found == {"all": ("ensemble", 0.5), "two": ("autoregressive", 0.4), "tie": ("autoregressive", 0.5),
                     "good": ("seasonal", 0.1), "alone": ("seasonal", 0.5)}


def weekly(n=200):
    pattern = np.array([10, 12, 15, 20, 30, 5, 8], float)
    return [pattern[i % 7] + 0.05 * i for i in range(n)]


@pytest.mark.parametrize("model", [
    forecast.seasonal_forecast, forecast.autoregressive_forecast, forecast.trend_weekday_forecast,
    lambda df: forecast.autoregressive_forecast(df, mode="one_step")])
def test_a_weekly_pattern_is_found(spark, model):
    forecasts = model(daily(spark, a=weekly()))
    assert forecasts.count() == 30
    assert metrics.mape(forecasts).first().mape < 0.15


def test_selection_and_horizon(spark):
    dense = daily(spark, good=weekly(), short=[1.0] * 40, odd=[float((i * i * 31) % 17 + 1) for i in range(120)])
    selected = forecast.select_models(dense)
    found = {r.stockcode: r for r in selected.collect()}
    assert set(found) == {"good", "odd"}
    assert found["odd"].final_mape == min(v for v in (found["odd"].seasonal_mape, found["odd"].autoregressive_mape, found["odd"].ensemble_mape) if v is not None)
    requests = spark.createDataFrame([("good", 5), ("odd", None), ("nobody", 3)], "product_id string, days int")
    last = START + dt.timedelta(days=199)
    rows = forecast.predict_demand(requests, dense, selected, F.lit(last)).collect()
    good = sorted(r.date for r in rows if r.product_id == "good")
    assert good == [(last + dt.timedelta(days=i)).isoformat() for i in range(1, 6)]
    assert sum(r.product_id == "odd" for r in rows) == 30
    assert [(r.status, r.date) for r in rows if r.product_id == "nobody"] == [("no_model", None)]
    assert all(r.forecasted_quantity >= 0 and round(r.forecasted_quantity, 2) == r.forecasted_quantity for r in rows if r.date)
    early = START + dt.timedelta(days=150)
    twice = spark.createDataFrame([("good", 2), ("good", 4), ("good", 0), ("odd", -1)], "product_id string, days int")
    rows = forecast.predict_demand(twice, dense, selected, F.lit(early)).collect()
    assert sorted((r.product_id, r.days, r.date) for r in rows) == [
        ("good", n, (early + dt.timedelta(days=i)).isoformat()) for n in (2, 4) for i in range(1, n + 1)]
    before = forecast.predict_demand(twice, dense, selected, F.lit(START - dt.timedelta(days=1))).collect()
    assert sorted((r.days, r.status) for r in before) == [(2, "no_history"), (4, "no_history")]
    long = forecast.run_metrics(selected).where("run_name = 'Product_good'").collect()
    assert {r.key for r in long} >= {"product_id", "seasonal_mape", "selected_model", "final_mape"}
