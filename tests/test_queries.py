"""Every registered query with SQL agrees with it; the others keep their invariants."""

import importlib.util
from pathlib import Path

import pytest

from oracle import connect, difference

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
SPEC = importlib.util.spec_from_file_location("spark_entry", ENTRY)
entry = importlib.util.module_from_spec(SPEC)
SPEC.loader.exec_module(entry)
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, con, name):
    assert difference(QUERIES[name](spark, folder), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_forecast_queries(spark, folder):
    assert {r.split for r in QUERIES["stratified_split"](spark, folder).select("split").distinct().collect()} == {"test", "train"}
    horizon = QUERIES["demand_horizon"](spark, folder).collect()
    assert len(horizon) % 30 == 0 and all(r.forecasted_quantity >= 0 for r in horizon)
    selected = QUERIES["ensemble_select"](spark, folder).collect()
    assert {r.model_type for r in selected} <= {"seasonal", "autoregressive", "ensemble"}
    assert QUERIES["run_metrics"](spark, folder).count() >= 3 * len(selected)
