"""Queries that forecast demand."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators import forecast, metrics, series
from basketry.plans.fitted import once
from basketry.plans.lines import brand_series, rounded, top_product_series, type_series
from basketry.session import staged


def _series(spark, folder):
    """Daily series by product type, written once for the models that read it more than once."""
    return once(spark, folder, "type-series", lambda: staged(type_series(spark, folder), "series"))


def _selected(spark, folder):
    return once(spark, folder, "selected-models",
                lambda: staged(forecast.select_models(_series(spark, folder)), "selected"))


def forecast_trend_weekday(spark, folder):
    return rounded(forecast.trend_weekday_forecast(brand_series(spark, folder)), 4, "forecast")


def forecast_seasonal_ridge(spark, folder):
    return forecast.seasonal_forecast(forecast.long_enough(_series(spark, folder)))


def trend_breaks(spark, folder):
    """Days at which the trend of a product type bends."""
    return forecast.trend_breaks(forecast.long_enough(_series(spark, folder)))


def forecast_autoregressive(spark, folder):
    return forecast.autoregressive_forecast(forecast.long_enough(_series(spark, folder)))


def forecast_one_step(spark, folder):
    return forecast.autoregressive_forecast(forecast.long_enough(_series(spark, folder)), mode="one_step")


def mape_by_product(spark, folder):
    """Error of the value a week earlier as forecast, over the last 30 days of every brand."""
    week_ago = F.lag("quantity", 7).over(Window.partitionBy("stockcode").orderBy("date"))
    naive = series.holdout_split(brand_series(spark, folder).withColumn("forecast", week_ago))
    return rounded(metrics.mape(naive.where(F.col("split") == "test")), 8, "mape")


def model_choice(spark, folder):
    """The choice among forecasts that SQL can follow: a week ago, four weeks ago, and their mean."""
    ordered = Window.partitionBy("stockcode").orderBy("date")
    lagged = brand_series(spark, folder).withColumns({
        "week": F.lag("quantity", 7).over(ordered), "month": F.lag("quantity", 28).over(ordered)})
    test = series.holdout_split(lagged).where(F.col("split") == "test")
    chosen = forecast.compare_models(
        test.select("stockcode", "date", "quantity", F.col("week").alias("forecast")),
        test.select("stockcode", "date", "quantity", F.col("month").alias("forecast")))
    return rounded(chosen, 8, "seasonal_mape", "autoregressive_mape", "ensemble_mape", "final_mape")


def ensemble_select(spark, folder):
    return _selected(spark, folder)


def top_product_models(spark, folder):
    """The same choice for the five parts with the largest quantity, picked before gaps are filled."""
    return forecast.select_models(staged(top_product_series(spark, folder), "series"))


def run_metrics(spark, folder):
    return forecast.run_metrics(_selected(spark, folder))


def run_metrics_of_choice(spark, folder):
    """The same rows for the choice that SQL can follow."""
    return forecast.run_metrics(model_choice(spark, folder))


def demand_horizon(spark, folder):
    """Thirty days ahead of the last day on record, for every product type."""
    dense = _series(spark, folder)
    requests = dense.select(F.col("stockcode").alias("product_id")).distinct().withColumn("days", F.lit(30))
    as_of = dense.agg(F.max("date").alias("last")).scalar()
    return forecast.predict_demand(requests, dense, _selected(spark, folder), as_of)


QUERIES = {
    "forecast_trend_weekday": forecast_trend_weekday,
    "forecast_seasonal_ridge": forecast_seasonal_ridge,
    "trend_breaks": trend_breaks,
    "forecast_autoregressive": forecast_autoregressive,
    "forecast_one_step": forecast_one_step,
    "mape_by_product": mape_by_product,
    "model_choice": model_choice,
    "ensemble_select": ensemble_select,
    "top_product_models": top_product_models,
    "run_metrics": run_metrics,
    "run_metrics_of_choice": run_metrics_of_choice,
    "demand_horizon": demand_horizon,
}
