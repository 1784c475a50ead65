"""SQL counterparts of the queries over lines, customers and daily series."""

RETAIL = """
retail AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stockcode, p_brand, p_type,
         p_name AS description, CAST(l_quantity AS INTEGER) AS quantity, o_orderdate AS invoicedate,
         p_retailprice AS price, o_custkey AS customer_id, n_name AS country,
         CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(12, 2)) AS total_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

DIRTY = """
once AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stockcode,
         CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE p_name END AS description,
         CASE WHEN l_orderkey % 19 = 0 THEN NULL
              WHEN l_returnflag = 'R' AND l_linenumber % 5 = 0 THEN -CAST(l_quantity AS INT)
              ELSE CAST(l_quantity AS INT) * (CASE WHEN l_partkey % 97 = 0 THEN 40 ELSE 1 END) END AS quantity,
         o_orderdate AS invoicedate,
         CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE p_retailprice END AS price,
         CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_custkey END AS customer_id,
         CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE n_name END AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
dirty AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE CAST(invoice AS INT) % 31 = 0)"""

DATED = "* REPLACE (CAST(invoicedate AS DATE) AS invoicedate)"

CLEANED = DIRTY + """,
uniq AS (SELECT DISTINCT * FROM dirty),
kept AS (SELECT * FROM uniq WHERE customer_id IS NOT NULL),
fills AS (SELECT median(price) AS m_price, median(quantity) AS m_quantity FROM kept),
common AS (SELECT country FROM kept WHERE country IS NOT NULL GROUP BY country ORDER BY count(*) DESC, country LIMIT 1),
filled AS (
  SELECT invoice, stockcode, coalesce(description, 'Unknown Product') AS description,
         coalesce(CAST(quantity AS DOUBLE), m_quantity) AS quantity, invoicedate,
         coalesce(price, m_price) AS price, customer_id,
         coalesce(country, (SELECT country FROM common)) AS country
  FROM kept CROSS JOIN fills),
positive AS (SELECT * FROM filled WHERE quantity > 0 AND price > 0),
quartiles AS (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM positive),
inside AS (SELECT positive.* FROM positive CROSS JOIN quartiles
           WHERE quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""

REFERENCE = RETAIL + """,
ref AS (SELECT max(invoicedate) + INTERVAL 1 DAY AS day FROM retail)"""


def days(start: str, end: str) -> str:
    return f"CAST(floor((epoch({end}) - epoch({start})) / 86400) AS INTEGER)"


RFM = REFERENCE + f""",
rfm AS (
  SELECT customer_id, {days('max(invoicedate)', '(SELECT day FROM ref)')} AS "Recency",
         count(DISTINCT invoice) AS "Frequency", CAST(sum(total_amount) AS DOUBLE) AS "Monetary"
  FROM retail GROUP BY customer_id)"""

FEATURES = REFERENCE + f""",
base AS (
  SELECT customer_id, {days('max(invoicedate)', '(SELECT day FROM ref)')} AS "Recency",
         count(DISTINCT invoice) AS "Frequency", CAST(sum(total_amount) AS DOUBLE) AS "Monetary",
         CAST(sum(quantity) AS DOUBLE) AS "TotalQuantity", count(DISTINCT stockcode) AS "UniqueProducts",
         {days('min(invoicedate)', 'max(invoicedate)')} AS "Tenure"
  FROM retail GROUP BY customer_id),
features AS (
  SELECT *, CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn",
         "Monetary" / "Frequency" AS "AvgOrderValue",
         "Tenure" / "Frequency" AS "AvgDaysBetweenPurchases"
  FROM base)"""

FEATURE_ROWS = """
SELECT customer_id, "Recency", "Frequency", round("Monetary", 6) AS "Monetary", "Churn",
       round("AvgOrderValue", 6) AS "AvgOrderValue", "TotalQuantity", "UniqueProducts", "Tenure",
       round("AvgDaysBetweenPurchases", 6) AS "AvgDaysBetweenPurchases"
FROM features"""


def dense(product: str) -> str:
    """CTEs up to `dense`, one row per product and day."""
    return RETAIL + f""",
daily AS (SELECT CAST(invoicedate AS DATE) AS date, {product} AS stockcode, CAST(sum(quantity) AS DOUBLE) AS quantity
          FROM retail GROUP BY ALL),
spine AS (SELECT stockcode, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
          FROM daily GROUP BY stockcode),
dense AS (SELECT s.stockcode, s.date, coalesce(d.quantity, 0.0) AS quantity
          FROM spine s LEFT JOIN daily d ON s.stockcode = d.stockcode AND s.date = d.date)"""


SQL = {
    "scan_retail": f"""WITH {RETAIL}
SELECT invoice, stockcode, description, CAST(quantity AS DOUBLE) AS quantity,
       strftime(invoicedate, '%Y-%m-%d %H:%M:%S') AS invoicedate, price, customer_id, country,
       CAST(total_amount AS DOUBLE) AS total_amount, CAST(year(invoicedate) AS INTEGER) AS year,
       CAST(month(invoicedate) AS INTEGER) AS month, CAST(day(invoicedate) AS INTEGER) AS day,
       dayname(invoicedate) AS day_of_week FROM retail""",
    "scan_raw": f"""WITH {DIRTY}
SELECT * REPLACE (strftime(invoicedate, '%Y-%m-%d %H:%M:%S') AS invoicedate) FROM dirty""",
    "dedup_lines": f"WITH {DIRTY} SELECT {DATED} FROM (SELECT DISTINCT * FROM dirty)",
    "drop_null_customer": f"WITH {DIRTY} SELECT {DATED} FROM dirty WHERE customer_id IS NOT NULL",
    "fill_description": f"""WITH {DIRTY}
SELECT invoice, stockcode, coalesce(description, 'Unknown Product') AS description FROM dirty""",
    "impute_median": f"""WITH {DIRTY}, fills AS (SELECT median(price) AS p, median(quantity) AS q FROM dirty)
SELECT invoice, stockcode, coalesce(price, p) AS price, coalesce(CAST(quantity AS DOUBLE), q) AS quantity
FROM dirty CROSS JOIN fills""",
    "impute_mode": f"""WITH {DIRTY}, common AS (
  SELECT country FROM (SELECT country, row_number() OVER (ORDER BY count(*) DESC, country) AS place
                       FROM dirty WHERE country IS NOT NULL GROUP BY country) WHERE place = 1)
SELECT invoice, stockcode, coalesce(country, (SELECT country FROM common)) AS country FROM dirty""",
    "positive_lines": f"""WITH {DIRTY}
SELECT invoice, stockcode, quantity, price FROM dirty WHERE quantity > 0 AND price > 0""",
    "line_totals": f"""WITH {RETAIL}
SELECT invoice, stockcode, quantity, price, CAST(total_amount AS DOUBLE) AS total_amount FROM retail""",
    "calendar_parts": f"""WITH {RETAIL}
SELECT invoice, stockcode, CAST(invoicedate AS DATE) AS invoicedate, CAST(year(invoicedate) AS INTEGER) AS year,
       CAST(month(invoicedate) AS INTEGER) AS month, CAST(day(invoicedate) AS INTEGER) AS day,
       dayname(invoicedate) AS day_of_week FROM retail""",
    "iqr_bounds": f"""WITH {DIRTY}, q AS (
  SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3
  FROM dirty WHERE quantity > 0 AND price > 0)
SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q""",
    "iqr_filter": f"""WITH {DIRTY}, pos AS (SELECT * FROM dirty WHERE quantity > 0 AND price > 0), q AS (
  SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM pos)
SELECT invoice, stockcode, quantity FROM pos CROSS JOIN q
WHERE quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "null_profile": f"""WITH {DIRTY}, uniq AS (SELECT DISTINCT * FROM dirty)
""" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM uniq"
        for c in ("invoice", "stockcode", "description", "quantity", "invoicedate", "price", "customer_id", "country")),
    "stage_counts": f"""WITH {CLEANED}
SELECT 'loaded' AS stage, count(*) AS "rows", 8 AS columns FROM dirty
UNION ALL SELECT 'deduplicated', count(*), 8 FROM uniq
UNION ALL SELECT 'with_customer', count(*), 8 FROM kept
UNION ALL SELECT 'positive', count(*), 13 FROM positive
UNION ALL SELECT 'within_fences', count(*), 13 FROM inside""",
    "clean_retail": f"""WITH {CLEANED}
SELECT invoice, stockcode, description, quantity, CAST(invoicedate AS DATE) AS invoicedate, price, customer_id, country,
       round(quantity * price, 2) AS total_amount, CAST(year(invoicedate) AS INTEGER) AS year,
       CAST(month(invoicedate) AS INTEGER) AS month, CAST(day(invoicedate) AS INTEGER) AS day,
       dayname(invoicedate) AS day_of_week FROM inside""",
    "customer_summary": f"""WITH {RETAIL}
SELECT customer_id, count(DISTINCT invoice) AS "Frequency", CAST(sum(total_amount) AS DOUBLE) AS "Monetary"
FROM retail GROUP BY customer_id""",
    "rfm_reference_date": f"""WITH {RFM} SELECT * FROM rfm WHERE "Monetary" > 0""",
    "rfm_labelled": f"""WITH {RFM}
SELECT *, CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn" FROM rfm""",
    "labelled_lines": f"""WITH {RFM}
SELECT invoice, stockcode, CAST(invoicedate AS DATE) AS invoicedate, customer_id, "Recency",
       CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn" FROM retail JOIN rfm USING (customer_id)""",
    "churn_label": f"""WITH {RFM}
SELECT customer_id, "Recency", CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn" FROM rfm""",
    "churn_class_counts": f"""WITH {RFM}
SELECT CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn", count(*) AS customers FROM rfm GROUP BY 1""",
    "recency_by_churn": f"""WITH {RFM}
SELECT CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn", count("Recency") AS count,
       round(avg("Recency"), 6) AS mean, round(stddev_samp("Recency"), 6) AS std, min("Recency") AS min,
       round(quantile_cont("Recency", 0.25), 6) AS q25, round(quantile_cont("Recency", 0.5), 6) AS q50,
       round(quantile_cont("Recency", 0.75), 6) AS q75, max("Recency") AS max
FROM rfm GROUP BY 1""",
    "purchase_span": f"""WITH {RETAIL}
SELECT customer_id, CAST(min(invoicedate) AS DATE) AS first_purchase, CAST(max(invoicedate) AS DATE) AS last_purchase,
       {days('min(invoicedate)', 'max(invoicedate)')} AS "Tenure" FROM retail GROUP BY customer_id""",
    "customer_features": f"WITH {FEATURES} {FEATURE_ROWS}",
    "customer_features_before": "WITH " + FEATURES.replace(
        "max(invoicedate) + INTERVAL 1 DAY AS day FROM retail", "max(invoicedate) - INTERVAL 90 DAY AS day FROM retail"
    ).replace("FROM retail GROUP BY customer_id)", "FROM retail WHERE invoicedate < (SELECT day FROM ref) GROUP BY customer_id)"
    ).replace("""CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn\"""",
              """CASE WHEN customer_id IN (SELECT customer_id FROM retail WHERE invoicedate >= (SELECT day FROM ref)
           AND invoicedate < (SELECT day FROM ref) + INTERVAL 90 DAY) THEN 0 ELSE 1 END AS "Churn\"""") + FEATURE_ROWS,
    "rfm_log_scaled": f"""WITH {RFM}, logs AS (
  SELECT customer_id, ln(1 + "Recency") AS r, ln(1 + "Frequency") AS f, ln(1 + "Monetary") AS m
  FROM rfm WHERE "Monetary" > 0)
SELECT customer_id, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS "Recency",
       round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 6) AS "Frequency",
       round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS "Monetary" FROM logs""",
    "daily_sales": f"""WITH {RETAIL}
SELECT CAST(invoicedate AS DATE) AS date, stockcode, CAST(sum(quantity) AS DOUBLE) AS quantity FROM retail GROUP BY ALL""",
    "top_products": f"""WITH {RETAIL}
SELECT stockcode, CAST(sum(quantity) AS DOUBLE) AS total_quantity FROM retail GROUP BY stockcode
ORDER BY total_quantity DESC, stockcode LIMIT 5""",
    "dense_daily_sales": f"WITH {dense('p_brand')} SELECT stockcode, date, quantity FROM dense",
    "top_product_series": f"""WITH {dense('stockcode')}
SELECT stockcode, date, quantity FROM dense WHERE stockcode IN (
  SELECT stockcode FROM daily GROUP BY stockcode ORDER BY sum(quantity) DESC, stockcode LIMIT 5)""",
    "forecastable_products": f"""WITH {RETAIL}, ends AS (
  SELECT stockcode, CAST(min(invoicedate) AS DATE) AS first_day, CAST(max(invoicedate) AS DATE) AS last_day
  FROM retail GROUP BY stockcode)
SELECT *, CAST(last_day - first_day + 1 AS INTEGER) AS days,
       CASE WHEN last_day - first_day + 1 >= 90 THEN 'ok' ELSE 'too_short' END AS status FROM ends""",
    "lag_windows": f"""WITH {dense('p_type')}, w AS (
  SELECT stockcode, date, list(CAST(quantity AS BIGINT)) OVER (
           PARTITION BY stockcode ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS lags,
         quantity AS target FROM dense)
SELECT stockcode, date, array_to_string(lags, ',') AS lags, target FROM w WHERE len(lags) = 30""",
    "holdout_split": f"""WITH {dense('p_brand')}
SELECT stockcode, date, quantity, CASE WHEN count(*) OVER (PARTITION BY stockcode) <= 30 THEN 'too_short'
  WHEN row_number() OVER (PARTITION BY stockcode ORDER BY date DESC) <= 30 THEN 'test' ELSE 'train' END AS split
FROM dense""",
    "minmax_scaled": f"""WITH {dense('p_brand')}, ranged AS (
  SELECT *, min(quantity) OVER (PARTITION BY stockcode) AS low, max(quantity) OVER (PARTITION BY stockcode) AS high
  FROM dense)
SELECT stockcode, date, quantity, low, round(CASE WHEN high = low THEN 0 ELSE (quantity - low) / (high - low) END, 8) AS scaled,
       quantity AS restored FROM ranged""",
    "forecast_calendar": f"""WITH {dense('p_brand')}, ends AS (
  SELECT stockcode, min(date) AS first_day, max(date) AS last_day FROM daily GROUP BY stockcode), days AS (
  SELECT stockcode, last_day,
         CAST(unnest(generate_series(first_day, last_day + 30, INTERVAL 1 DAY)) AS DATE) AS date FROM ends)
SELECT stockcode, date, date > last_day AS is_future FROM days""",
}
