"""Demand forecasts: all products at once, one group per product.

A group is one product's daily series, at most one row per calendar day, whatever the number of
lines behind it. Restrict the products (`series.only_products`) before filling gaps when only some
are of interest.
"""

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.columns import at_least_zero, day_text, half_even
from basketry.functions.lookups import lookup
from basketry.operators import metrics, series, trend
from basketry.session import staged

FORECAST_SCHEMA = "stockcode string, date date, quantity double, forecast double"
SEASONAL, AUTOREGRESSIVE, ENSEMBLE = "seasonal", "autoregressive", "ensemble"


# --- small per-series helpers ----------------------------------------------------

def _ridge(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least squares with a penalty of `weights` on the coefficients."""
    return np.linalg.solve(x.T @ x + np.diag(weights), x.T @ y)


def _weights(n: int, penalty: float) -> np.ndarray:
    """`penalty` for all coefficients but the first (the level)."""
    return np.array([1e-9] + [penalty] * (n - 1))


def _season_terms(days: np.ndarray, first: float, span: float) -> np.ndarray:
    """Level, trend, weekly and yearly waves for days counted from a common origin."""
    waves = [(order, period) for period, top in ((7.0, fixed.WEEKLY_ORDER), (365.25, fixed.YEARLY_ORDER))
             for order in range(1, top + 1)]
    angles = [2 * np.pi * order * days / period for order, period in waves]
    return np.column_stack([np.ones(len(days)), (days - first) / max(span, 1.0),
                            *[np.sin(a) for a in angles], *[np.cos(a) for a in angles]])


def seasonal_fit(days: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> dict:
    """Origin, length, breaks of the trend and coefficients of trend + week + year fitted to (days, y)."""
    first, span = float(days[0]), float(days[-1] - days[0])
    terms = _season_terms(days, first, span)
    weights = _weights(terms.shape[1], penalty)
    free = weights.copy()
    free[1] = trend.FREE  # else a break at the start would stand in for the penalised slope
    places = trend.breaks(days, y, terms, free)
    if len(places):
        weights = free
    full = np.column_stack([terms, trend.hinges(days, places, span)])
    coefficients = _ridge(full, y, np.concatenate([weights, np.full(len(places), trend.FREE)]))
    return {"first": first, "span": span, "breaks": places, "coefficients": coefficients}


def seasonal_values(fit: Mapping, days: np.ndarray) -> np.ndarray:
    """What a seasonal fit says for `days`; the last slope of the trend goes on."""
    first, span = fit["first"], fit["span"]
    return np.column_stack([_season_terms(days, first, span), trend.hinges(days, fit["breaks"], span)]) @ fit["coefficients"]


def seasonal_model(days: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """Additive trend with breaks + week + year fitted to (days, y); returns a function of days."""
    fit = seasonal_fit(days, y, penalty)
    return lambda ahead: seasonal_values(fit, ahead)


def autoregressive_fit(y: np.ndarray, lags: int = fixed.LAGS, penalty: float = 0.1) -> dict:
    """Scale and coefficients of the next value from the `lags` values before it, on values scaled to [0, 1]."""
    low, width = float(y.min()), float(y.max() - y.min()) or 1.0
    windows = np.lib.stride_tricks.sliding_window_view((y - low) / width, lags + 1)
    x = np.column_stack([np.ones(len(windows)), windows[:, :-1]])
    return {"low": low, "width": width, "lag_weights": _ridge(x, windows[:, -1], _weights(lags + 1, penalty))}


def autoregressive_values(fit: Mapping, last: np.ndarray, n: int) -> np.ndarray:
    """The `n` values after `last`, each from those before it and its own predictions."""
    low, width, weights = fit["low"], fit["width"], np.asarray(fit["lag_weights"])
    lags = len(weights) - 1
    known = list((np.asarray(last)[-lags:] - low) / width)
    for _ in range(n):
        known.append(weights[0] + float(np.dot(weights[1:], known[-lags:])))
    return np.array(known[lags:]) * width + low


def autoregressive_model(y: np.ndarray, lags: int = fixed.LAGS, penalty: float = 0.1):
    """Returns (one_step, recursive): one_step(windows) predicts one value per row of actual lags,
    recursive(last, n) predicts n values from its own predictions.
    """
    fit = autoregressive_fit(y, lags, penalty)
    low, width, weights = fit["low"], fit["width"], fit["lag_weights"]

    def one_step(rows: np.ndarray) -> np.ndarray:
        rows = (rows - low) / width
        return (weights[0] + rows @ weights[1:]) * width + low

    return one_step, lambda last, n: autoregressive_values(fit, last, n)


def _day_numbers(dates: pd.Series) -> np.ndarray:
    return (pd.to_datetime(dates).to_numpy().astype("datetime64[D]").astype("int64")).astype(float)


# --- holdout forecasts ------------------------------------------------------------

def long_enough(dense: DataFrame, min_days: int = fixed.MIN_HISTORY_DAYS) -> DataFrame:
    """Series with enough days; the others are reported by `series.forecastable_products`."""
    return series.with_status(dense, min_days).where(F.col("status") == "ok").drop("days", "status")


def seasonal_forecast(dense: DataFrame, test_days: int = fixed.HOLDOUT_DAYS) -> DataFrame:
    """Rows (stockcode, date, quantity, forecast) for the last `test_days` days of every product,
    from a trend (with breaks) + week + year model of the days before. Products without train days give no row."""

    def forecast(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        if len(group) <= test_days:
            return group.iloc[:0].assign(forecast=[])
        days, y = _day_numbers(group["date"]), group["quantity"].to_numpy(float)
        ahead = seasonal_model(days[:-test_days], y[:-test_days])
        return group.tail(test_days).assign(forecast=ahead(days[-test_days:]))

    return _per_product(dense, forecast)


def trend_breaks(dense: DataFrame) -> DataFrame:
    """Rows (stockcode, date, slope_change): the days at which a product's trend bends, and by how much a day."""

    def bends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        fit = seasonal_fit(_day_numbers(group["date"]), group["quantity"].to_numpy(float))
        places = fit["breaks"]
        return pd.DataFrame({"stockcode": group["stockcode"].iloc[0],
                             "date": places.astype("int64").astype("datetime64[D]").astype(object),
                             "slope_change": fit["coefficients"][len(fit["coefficients"]) - len(places):] / max(fit["span"], 1.0)})

    return dense.select("stockcode", "date", "quantity").groupBy("stockcode").applyInPandas(
        bends, "stockcode string, date date, slope_change double")


def autoregressive_forecast(dense: DataFrame, test_days: int = fixed.HOLDOUT_DAYS, lags: int = fixed.LAGS,
                            mode: str = "recursive") -> DataFrame:
    """The same rows from the `lags` previous days.

    `recursive` knows nothing of the test days, like the seasonal model; `one_step` sees the actual
    values up to the day before. The range for scaling comes from train days only.
    """
    if mode not in ("recursive", "one_step"):
        raise ValueError("mode is recursive or one_step")

    def forecast(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        if len(group) <= test_days + lags:
            return group.iloc[:0].assign(forecast=[])
        y = group["quantity"].to_numpy(float)
        one_step, recursive = autoregressive_model(y[:-test_days], lags)
        if mode == "recursive":
            ahead = recursive(y[:-test_days], test_days)
        else:
            windows = np.lib.stride_tricks.sliding_window_view(y[-(test_days + lags):], lags)[:test_days]
            ahead = one_step(windows)
        return group.tail(test_days).assign(forecast=ahead)

    return _per_product(dense, forecast)


def _per_product(dense: DataFrame, forecast) -> DataFrame:
    return dense.select("stockcode", "date", "quantity").groupBy("stockcode").applyInPandas(forecast, FORECAST_SCHEMA)


def trend_weekday_forecast(dense: DataFrame, test_days: int = fixed.HOLDOUT_DAYS) -> DataFrame:
    """The same rows from a straight trend plus the mean deviation of each weekday, without Python."""
    whole = Window.partitionBy("stockcode")
    day = F.datediff("date", F.min("date").over(whole)).cast("double")
    split = series.holdout_split(dense.withColumn("day", day), test_days)
    train = F.col("split") == "train"
    y, x = F.when(train, F.col("quantity")), F.when(train, F.col("day"))
    fitted = split.withColumns({
        "slope": F.coalesce(F.regr_slope(y, x).over(whole), F.lit(0.0)),
        "level": F.coalesce(F.regr_intercept(y, x).over(whole), F.avg(y).over(whole)),
        "weekday": F.dayofweek("date")})
    line = F.col("level") + F.col("slope") * F.col("day")
    by_weekday = Window.partitionBy("stockcode", "weekday")
    deviation = F.coalesce(F.avg(F.when(train, F.col("quantity") - line)).over(by_weekday), F.lit(0.0))
    return fitted.withColumn("forecast", line + deviation).where(F.col("split") == "test").select(
        "stockcode", "date", "quantity", "forecast")


# --- choice of a model ---------------------------------------------------------------

def compare_models(seasonal: DataFrame, challenger: DataFrame, threshold: float = fixed.CHALLENGE_ABOVE) -> DataFrame:
    """One row per product: errors of the models and of their average, and the chosen model.

    The challenger counts only where the seasonal error is above `threshold`. Among equal errors
    the average wins over the challenger and the challenger over the seasonal model.
    """
    both = seasonal.withColumnRenamed("forecast", "s").join(
        challenger.select("stockcode", "date", F.col("forecast").alias("a")), ["stockcode", "date"], "left")
    error = {name: metrics.share_error(F.col("quantity"), value) for name, value in
             (("seasonal", F.col("s")), ("autoregressive", F.col("a")), ("ensemble", (F.col("s") + F.col("a")) / 2))}
    known = F.count("a") > 0
    scored = both.groupBy("stockcode").agg(
        F.coalesce(F.avg(error["seasonal"]), F.lit(0.0)).alias("seasonal_mape"),
        *[F.when(known, F.coalesce(F.avg(error[m]), F.lit(0.0))).alias(f"{m}_mape")
          for m in ("autoregressive", "ensemble")])
    return choose_model(scored, threshold)


def choose_model(scored: DataFrame, threshold: float = fixed.CHALLENGE_ABOVE) -> DataFrame:
    """Adds model_type and final_mape to rows with seasonal_mape, autoregressive_mape, ensemble_mape."""
    challenged = (F.col("seasonal_mape") > threshold) & F.col("ensemble_mape").isNotNull()
    shown = scored.withColumns({
        m: F.when(challenged, F.col(m)) for m in ("autoregressive_mape", "ensemble_mape")})
    best = F.least("seasonal_mape", "autoregressive_mape", "ensemble_mape")  # nulls are skipped
    return shown.withColumn("final_mape", best).withColumn(
        "model_type", F.when(F.col("final_mape") == F.col("ensemble_mape"), ENSEMBLE)
        .when(F.col("final_mape") == F.col("autoregressive_mape"), AUTOREGRESSIVE).otherwise(SEASONAL))


def select_models(dense: DataFrame, test_days: int = fixed.HOLDOUT_DAYS, threshold: float = fixed.CHALLENGE_ABOVE,
                  mode: str = "recursive") -> DataFrame:
    """Forecast, challenge where needed, compare and choose, for all products with enough history.

    The challenger is fitted only for products whose seasonal error is above the threshold.
    """
    ready = long_enough(dense)
    seasonal = staged(seasonal_forecast(ready, test_days), "seasonal")
    weak = metrics.mape(seasonal).where(F.col("mape") > threshold).select("stockcode")
    challenger = autoregressive_forecast(ready.join(weak, "stockcode", "left_semi"), test_days, mode=mode)
    return compare_models(seasonal, challenger, threshold)


def run_metrics(selected: DataFrame) -> DataFrame:
    """Parameters and metrics of every product's run as rows (run_name, kind, key, value)."""
    def entry(kind, key, value):
        return F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("string").alias("value"))

    rows = F.array(entry("param", "product_id", F.col("stockcode")),
                   *[entry("metric", m, F.col(m)) for m in ("seasonal_mape", "autoregressive_mape", "ensemble_mape")],
                   entry("param", "selected_model", F.col("model_type")),
                   entry("metric", "final_mape", F.col("final_mape")))
    long = selected.select(F.concat(F.lit("Product_"), "stockcode").alias("run_name"), F.inline(rows))
    return long.where(F.col("value").isNotNull())


# --- the days ahead ----------------------------------------------------------------------

FORECASTER_SCHEMA = """stockcode string, model_type string, as_of date, first double, span double, breaks array<double>,
    coefficients array<double>, low double, width double, lag_weights array<double>, last array<double>, last_day double"""


def fit_forecasters(dense: DataFrame, selected: DataFrame, as_of: Column) -> DataFrame:
    """One row per product with a chosen model: what its model needs to predict the days after `as_of`.

    Fitted on the history up to `as_of`; a product without history by then gives no row, one with too
    little for its lags a row without coefficients. `sources.models` stores the rows.
    """
    chosen = selected.select("stockcode", "model_type").where(F.col("model_type").isNotNull()).withColumn("as_of", as_of)
    history = lookup(dense.select("stockcode", "date", "quantity"), staged(chosen, "chosen"), ["stockcode"], "inner").where("date <= as_of")
    return history.groupBy("stockcode").applyInPandas(_forecaster, FORECASTER_SCHEMA)


def _forecaster(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("date")
    days, y = _day_numbers(group["date"]), group["quantity"].to_numpy(float)
    row = {name.split()[0]: None for name in FORECASTER_SCHEMA.split(",")}
    row |= {"stockcode": group["stockcode"].iloc[0], "model_type": group["model_type"].iloc[0], "as_of": group["as_of"].iloc[0],
            "last_day": days[-1]}
    if row["model_type"] == SEASONAL or len(y) > fixed.LAGS:
        if row["model_type"] in (SEASONAL, ENSEMBLE):
            row |= seasonal_fit(days, y)
        if row["model_type"] in (AUTOREGRESSIVE, ENSEMBLE):
            row |= autoregressive_fit(y) | {"last": y[-fixed.LAGS:]}
    return pd.DataFrame([row])


def _predicted(batches):
    for batch in batches:
        parts = []
        for row in batch.to_dict("records"):
            wanted = _day_numbers(pd.Series([row["as_of"]]))[0] + np.arange(1, row["days"] + 1)
            values = []
            if row["coefficients"] is not None:
                values.append(seasonal_values(row, wanted))
            if row["lag_weights"] is not None:
                values.append(autoregressive_values(row, row["last"], int(wanted[-1] - row["last_day"]))[-len(wanted):])
            if values:
                parts.append(pd.DataFrame({
                    "stockcode": row["stockcode"], "step": np.arange(1, len(wanted) + 1),
                    "date": wanted.astype("int64").astype("datetime64[D]").astype(object), "forecasted_quantity": np.mean(values, axis=0)}))
        if parts:
            yield pd.concat(parts)


def predict_stored(requests: DataFrame, forecasters: DataFrame) -> DataFrame:
    """Rows (product_id, days, date, forecasted_quantity, status) for `days` days after the forecasters' last day.

    `requests` has product_id and days (30 where null); each (product_id, days) is answered by itself,
    requests for no day by no row. No history is read. Quantities are not negative and have 2 digits. A product
    without a stored model gives one row with status no_model, one with too little history a row with status no_history.
    """
    return _answered(_asked(requests), forecasters, forecasters.select(F.col("stockcode").alias("product_id"), "model_type"))


def _asked(requests: DataFrame) -> DataFrame:
    asked = requests.select("product_id", F.coalesce("days", F.lit(fixed.HORIZON_DAYS)).cast("int").alias("days"))
    return staged(asked.where("days > 0").distinct(), "asked")


def _answered(asked: DataFrame, forecasters: DataFrame, chosen: DataFrame) -> DataFrame:
    longest = asked.groupBy(F.col("product_id").alias("stockcode")).agg(F.max("days").alias("days"))
    ahead = forecasters.join(longest, "stockcode").mapInPandas(
        _predicted, "stockcode string, step int, date date, forecasted_quantity double")
    plan = asked.join(chosen, "product_id", "left")
    answered = plan.join(ahead, (F.col("product_id") == F.col("stockcode")) & (F.col("step") <= F.col("days")), "left")
    status = F.when(F.col("model_type").isNull(), "no_model").when(F.col("date").isNull(), "no_history").otherwise("ok")
    return answered.select("product_id", "days", day_text("date").alias("date"),
                           half_even(F.when(F.col("date").isNotNull(), at_least_zero(F.col("forecasted_quantity"))), 2)
                           .alias("forecasted_quantity"), status.alias("status"))


def predict_demand(requests: DataFrame, dense: DataFrame, selected: DataFrame, as_of: Column) -> DataFrame:
    """The same rows for days after `as_of`, from models fitted on the history up to it, for the products asked for only."""
    asked = _asked(requests)
    wanted = selected.join(asked.select(F.col("product_id").alias("stockcode")), "stockcode", "left_semi")
    return _answered(asked, fit_forecasters(dense, wanted, as_of), selected.select(F.col("stockcode").alias("product_id"), "model_type"))
