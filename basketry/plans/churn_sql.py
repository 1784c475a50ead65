"""SQL counterparts of the churn queries that do not depend on a fitted model."""

from basketry.plans.line_sql import RFM

LABEL = RFM + """,
labelled AS (SELECT customer_id, "Recency", CASE WHEN "Recency" >= 90 THEN 1 ELSE 0 END AS "Churn" FROM rfm)"""

SHUFFLED = LABEL + """,
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY "Churn" ORDER BY md5(customer_id || ':42'), customer_id) AS place FROM labelled)"""

SCORED = LABEL + """,
scored AS (
  SELECT customer_id, "Churn" AS label, (customer_id * 37 % 101) / 100.0 AS score,
         CASE WHEN (customer_id * 37 % 101) / 100.0 > 0.5 THEN 1 ELSE 0 END AS prediction FROM labelled)"""

SQL = {
    "stratified_split": f"""WITH {SHUFFLED}, classes AS (
  SELECT "Churn", count(*) AS n, sum(count(*)) OVER () AS everything FROM labelled GROUP BY "Churn"), ideal AS (
  SELECT "Churn", n * ceil(round(everything * 0.2, 6)) / everything AS share, ceil(round(everything * 0.2, 6)) AS wanted
  FROM classes), quotas AS (
  SELECT "Churn", floor(share) + CASE WHEN
    row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, "Churn") <= wanted - sum(floor(share)) OVER ()
    THEN 1 ELSE 0 END AS quota FROM ideal)
SELECT customer_id, "Recency", "Churn", CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
FROM shuffled JOIN quotas USING ("Churn")""",
    "cv_folds": f"""WITH {SHUFFLED}
SELECT customer_id, "Recency", "Churn", CAST((place - 1) % 5 AS INTEGER) AS fold FROM shuffled""",
    "classification_metrics": f"""WITH {SCORED}
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 8) AS accuracy, count(*) AS n FROM scored""",
    "classification_report": f"""WITH {SCORED}, classes AS (SELECT unnest([0, 1]) AS class), per AS (
  SELECT class, (SELECT count(*) FROM scored WHERE label = class) AS support,
         (SELECT count(*) FROM scored WHERE prediction = class) AS claimed,
         (SELECT count(*) FROM scored WHERE label = class AND prediction = class) AS hits FROM classes), ratios AS (
  SELECT CAST(class AS VARCHAR) AS class, hits / claimed AS precision, hits / support AS recall,
         2 * hits / (claimed + support) AS f1, support, hits FROM per), everything AS (
  SELECT class, precision, recall, f1, support FROM ratios
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM ratios
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM ratios
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM ratios)
SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1,
       CAST(support AS BIGINT) AS support FROM everything""",
    "confusion_matrix": f"""WITH {SCORED}
SELECT a.c AS actual, p.c AS predicted, count(label) AS n
FROM (SELECT unnest([0, 1]) AS c) a CROSS JOIN (SELECT unnest([0, 1]) AS c) p
LEFT JOIN scored ON label = a.c AND prediction = p.c GROUP BY ALL""",
    "roc_auc": f"""WITH {SCORED}, ranked AS (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM scored)
SELECT round((sum(CASE WHEN label = 1 THEN place ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
             / (sum(label) * (count(*) - sum(label))), 8) AS auc FROM ranked""",
    "risk_bands": f"""WITH {SCORED}
SELECT *, CASE WHEN score > 0.7 THEN 'High Risk' WHEN score > 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level,
  CASE WHEN score > 0.7 THEN 'Contact customer immediately with a retention offer'
       WHEN score > 0.4 THEN 'Send re-engagement email campaign' ELSE 'Maintain regular communication' END AS recommended_action
FROM scored""",
}
