"""Breaks of the trend against planted ones, and the L1 path against its conditions."""

import datetime as dt

import numpy as np
import pytest

from basketry.operators import forecast, metrics, trend

START = dt.date(2020, 1, 1)


def planted(seed, n=700, bends=(), slope=0.02, noise=2.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n, dtype=float)
    y = 60 + slope * t + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(0, noise, n)
    for place, change in bends:
        y += change * np.maximum(t - place, 0)
    return t + 18_000, y


def straight(days, y):
    """The model without breaks."""
    terms = forecast._season_terms(days, days[0], days[-1] - days[0])
    weights = forecast._ridge(terms, y, forecast._weights(terms.shape[1], 1.0))
    return lambda ahead: forecast._season_terms(ahead, days[0], days[-1] - days[0]) @ weights


@pytest.mark.parametrize("place", [120, 333, 500])
def test_planted_break_is_found_and_the_holdout_error_falls(place):
    for seed in range(3):
        days, y = planted(seed, bends=[(place, 0.3)])
        fit = forecast.seasonal_fit(days[:-60], y[:-60])
        assert min(abs(fit["breaks"] - 18_000 - place)) <= 12
        mine = np.abs(forecast.seasonal_values(fit, days[-60:]) - y[-60:]).mean()
        assert mine < np.abs(straight(days[:-60], y[:-60])(days[-60:]) - y[-60:]).mean()


# waves of the year bend as well, so the days of two breaks are known less closely than that of one
def test_two_breaks_of_different_sign():
    days, y = planted(1, 900, bends=[(200, 0.4), (550, -0.6)])
    found = forecast.seasonal_fit(days, y)["breaks"] - 18_000
    assert all(min(abs(found - place)) <= 30 for place in (200, 550))


def test_one_straight_trend_without_a_break():
    fits = [forecast.seasonal_fit(*planted(seed)) for seed in range(10)]
    assert sum(len(f["breaks"]) for f in fits) == 0
    days, y = planted(3)
    assert forecast.seasonal_values(forecast.seasonal_fit(days, y), days) == pytest.approx(straight(days, y)(days))


@pytest.mark.parametrize("y", [np.zeros(100), np.full(100, 7.0), np.array([1.0]), np.array([1.0, 5.0]), np.arange(80.0)])
def test_odd_series(y):
    fit = forecast.seasonal_fit(np.arange(len(y), dtype=float), y)
    assert np.isfinite(forecast.seasonal_values(fit, np.arange(len(y) + 30.0))).all()


def test_path_meets_its_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 12))
    gram, right = x.T @ x, x.T @ (x[:, 0] * 3 - x[:, 5] + rng.normal(size=60))
    d = np.zeros(12)
    for penalty in np.abs(right).max() * 0.7 ** np.arange(8):
        d = trend.l1_step(gram, right, penalty, d)
        slope = right - gram @ d
        assert (np.abs(slope) <= penalty * 1.01).all()
        assert slope[d != 0] == pytest.approx(penalty * np.sign(d[d != 0]), rel=0.01)


def test_breaks_of_all_products(spark):
    rows = [(name, START + dt.timedelta(days=i), float(v)) for name, bends in (("bent", [(300, 0.5)]), ("even", []))
            for i, v in enumerate(planted(4, 600, bends)[1])]
    dense = spark.createDataFrame(rows, "stockcode string, date date, quantity double")
    found = forecast.trend_breaks(dense).collect()
    assert {r.stockcode for r in found} == {"bent"}
    near = min(found, key=lambda r: abs((r.date - START).days - 300))
    assert abs((near.date - START).days - 300) <= 12 and near.slope_change == pytest.approx(0.5, abs=0.15)
    assert metrics.mape(forecast.seasonal_forecast(dense)).count() == 2
    assert forecast.trend_breaks(dense.where("false")).count() == 0
