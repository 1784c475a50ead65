"""SQL counterparts of the demand queries that do not depend on a fitted model."""

from basketry.plans.line_sql import dense

SPLIT = dense("p_brand") + """,
counted AS (
  SELECT *, date - min(date) OVER (PARTITION BY stockcode) AS day, dayofweek(date) AS weekday,
         row_number() OVER (PARTITION BY stockcode ORDER BY date DESC) AS from_end,
         lag(quantity, 7) OVER (PARTITION BY stockcode ORDER BY date) AS week,
         lag(quantity, 28) OVER (PARTITION BY stockcode ORDER BY date) AS month
  FROM dense)"""

CHOICE = SPLIT + """, errors AS (
  SELECT stockcode, coalesce(avg(abs(quantity - week) / quantity), 0) AS s,
         coalesce(avg(abs(quantity - month) / quantity), 0) AS a,
         coalesce(avg(abs(quantity - (week + month) / 2) / quantity), 0) AS e
  FROM counted WHERE from_end <= 30 AND quantity <> 0 GROUP BY stockcode), gated AS (
  SELECT stockcode, s, CASE WHEN s > 0.1 THEN a END AS a, CASE WHEN s > 0.1 THEN e END AS e FROM errors), chosen AS (
  SELECT stockcode, round(s, 8) AS seasonal_mape, round(a, 8) AS autoregressive_mape, round(e, 8) AS ensemble_mape,
         round(least(s, a, e), 8) AS final_mape,
         CASE WHEN e = least(s, a, e) THEN 'ensemble' WHEN a = least(s, a, e) THEN 'autoregressive' ELSE 'seasonal' END AS model_type
  FROM gated)"""

SQL = {
    "forecast_trend_weekday": f"""WITH {SPLIT}, train AS (SELECT * FROM counted WHERE from_end > 30), trend AS (
  SELECT stockcode, coalesce(regr_slope(quantity, day), 0) AS slope,
         coalesce(regr_intercept(quantity, day), avg(quantity)) AS level FROM train GROUP BY stockcode), shift AS (
  SELECT stockcode, weekday, avg(quantity - (level + slope * day)) AS deviation
  FROM train JOIN trend USING (stockcode) GROUP BY ALL)
SELECT stockcode, date, quantity, round(level + slope * day + coalesce(deviation, 0), 4) AS forecast
FROM counted JOIN trend USING (stockcode) LEFT JOIN shift USING (stockcode, weekday) WHERE from_end <= 30""",
    "mape_by_product": f"""WITH {SPLIT}
SELECT stockcode, round(coalesce(avg(CASE WHEN quantity <> 0 THEN abs(quantity - week) / abs(quantity) END), 0), 8) AS mape
FROM counted WHERE from_end <= 30 GROUP BY stockcode""",
    "model_choice": f"WITH {CHOICE} SELECT * FROM chosen",
    "run_metrics_of_choice": f"""WITH {CHOICE}, entries AS (
  SELECT stockcode, 'param' AS kind, 'product_id' AS key, stockcode AS value FROM chosen
  UNION ALL SELECT stockcode, 'param', 'selected_model', model_type FROM chosen
  UNION ALL SELECT stockcode, 'metric', 'seasonal_mape', CAST(seasonal_mape AS VARCHAR) FROM chosen
  UNION ALL SELECT stockcode, 'metric', 'autoregressive_mape', CAST(autoregressive_mape AS VARCHAR) FROM chosen
  UNION ALL SELECT stockcode, 'metric', 'ensemble_mape', CAST(ensemble_mape AS VARCHAR) FROM chosen
  UNION ALL SELECT stockcode, 'metric', 'final_mape', CAST(final_mape AS VARCHAR) FROM chosen)
SELECT 'Product_' || stockcode AS run_name, kind, key, value FROM entries WHERE value IS NOT NULL""",
}
