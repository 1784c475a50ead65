"""SQL counterparts of the segment queries that do not depend on a fitted model."""

from basketry.plans.line_sql import RETAIL, RFM

PERSONA = """CASE WHEN "Recency" < 30 AND "Frequency" > 5 AND "Monetary" > 2000 THEN 'Champions'
  WHEN "Recency" > 180 AND "Frequency" <= 2 THEN 'Lost / Hibernating'
  WHEN "Recency" > 90 AND "Frequency" > 5 THEN 'At Risk (Loyal but inactive)'
  WHEN "Recency" < 60 AND "Frequency" <= 2 THEN 'Recent Customers'
  ELSE 'Average Customers' END"""

POINTS = RFM + """,
logs AS (SELECT customer_id, ln(1 + "Recency") AS r, ln(1 + "Frequency") AS f, ln(1 + "Monetary") AS m
         FROM rfm WHERE "Monetary" > 0),
points AS MATERIALIZED (
  SELECT customer_id, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS x,
         (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS y,
         (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS z FROM logs)"""

APART = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"

LABELLED = POINTS + """,
labelled AS MATERIALIZED (
  SELECT *, CASE WHEN z > 0 THEN 2 ELSE 0 END + CASE WHEN y > 0 THEN 1 ELSE 0 END AS label FROM points),
sizes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)"""


def silhouette(distance: str, measure: str) -> str:
    return f"""WITH {LABELLED}, reach AS (
  SELECT a.customer_id, a.label AS own, b.label AS other, sum({distance}) AS total
  FROM labelled a, labelled b GROUP BY ALL), means AS (
  SELECT customer_id,
         max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS inside,
         min(CASE WHEN own <> other THEN total / n END) AS nearest
  FROM reach JOIN sizes ON other = label GROUP BY customer_id)
SELECT round(avg(coalesce((nearest - inside) / greatest(nearest, inside), 0)), 6) AS silhouette,
       '{measure}' AS measure, count(*) AS n FROM means"""


BANDED = RFM + f""",
banded AS (
  SELECT *, least("Recency" // 60, 4) * 10 + least("Frequency" // 3, 3) AS band FROM rfm WHERE "Monetary" > 0), profile AS (
  SELECT band AS "Cluster_KMeans", round_even(avg("Recency"), 2) AS "Recency", round_even(avg("Frequency"), 2) AS "Frequency",
         round_even(avg("Monetary"), 2) AS "Monetary", count(*) AS "Count" FROM banded GROUP BY band), personas AS (
  SELECT *, {PERSONA} AS "Persona" FROM profile), named AS (
  SELECT customer_id, b."Recency", b."Frequency", round(b."Monetary", 2) AS "Monetary", band AS "Cluster_KMeans", "Persona"
  FROM banded b JOIN personas ON band = "Cluster_KMeans")"""

# --- fixed values: the wording of segments ---
SEGMENT_NAME = """CASE segment_id WHEN 0 THEN 'Loyal Customers' WHEN 1 THEN 'VIP Customers' WHEN 2 THEN 'At Risk Customers'
    WHEN 3 THEN 'High Value Customers' ELSE 'Unknown' END AS segment_name,
  CASE segment_id WHEN 0 THEN 'Regular buyers with long history' WHEN 1 THEN 'Highest spend and frequency'
    WHEN 2 THEN 'Low activity, needs attention' WHEN 3 THEN 'High spend, frequent buyers' ELSE '' END AS description"""

DENSITY = POINTS + f""",
near AS MATERIALIZED (SELECT a.customer_id AS u, b.customer_id AS v FROM points a, points b WHERE {APART} <= 0.5),
core AS MATERIALIZED (SELECT u AS id FROM near GROUP BY u HAVING count(*) >= 10),
links AS MATERIALIZED (SELECT u, v FROM near WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core))"""

CLUSTERED = DENSITY + """,
reached(root, id) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION
  SELECT min(r.root), l.v FROM reached r JOIN links l ON r.id = l.u JOIN recurring.reached k ON k.id = l.v
  WHERE r.root < k.root GROUP BY l.v),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM reached),
clustered AS (
  SELECT customer_id, CAST(coalesce(own.cluster, min(other.cluster), -1) AS INTEGER) AS cluster
  FROM points LEFT JOIN numbered own ON own.id = customer_id
  LEFT JOIN near ON near.u = customer_id LEFT JOIN numbered other ON other.id = near.v
  GROUP BY customer_id, own.cluster)"""

SQL = {
    "silhouette": silhouette(APART, "euclidean"),
    "silhouette_squared": silhouette(f"{APART} * {APART}", "squared_euclidean"),
    "davies_bouldin": f"""WITH {LABELLED}, centres AS (
  SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM labelled GROUP BY label), spread AS (
  SELECT a.label, avg({APART}) AS s FROM labelled a JOIN centres b USING (label) GROUP BY a.label), pairs AS (
  SELECT a.label, (sa.s + sb.s) / {APART} AS ratio FROM centres a JOIN centres b ON a.label <> b.label
  JOIN spread sa ON sa.label = a.label JOIN spread sb ON sb.label = b.label)
SELECT round(avg(worst), 6) AS davies_bouldin FROM (SELECT max(ratio) AS worst FROM pairs GROUP BY label)""",
    "banded_profile": f"WITH {BANDED} SELECT * FROM personas",
    "banded_personas": f"WITH {BANDED} SELECT * FROM named",
    "banded_export": f"""WITH {BANDED} SELECT customer_id, "Recency", "Frequency", "Monetary", "Persona" FROM named""",
    "borderline_rule": f"""WITH {RFM}
SELECT customer_id, round(customer_id * 37 % 101 / 101.0, 8) AS "GMM_Confidence" FROM rfm WHERE "Monetary" > 0
ORDER BY customer_id * 37 % 101, customer_id LIMIT 5""",
    "fixed_scoring": f"""WITH {RFM}, near AS (
  SELECT customer_id, "Recency", "Frequency", CASE WHEN "Recency" < 105.25 THEN 0 ELSE 2 END
         + CASE WHEN "Frequency" > 5.5 THEN 0 ELSE 1 END AS segment_id FROM rfm WHERE "Monetary" > 0)
SELECT *, {SEGMENT_NAME} FROM near""",
    "persona_rules": f"""WITH {RFM} SELECT *, {PERSONA} AS "Persona" FROM rfm WHERE "Monetary" > 0""",
    "eps_neighbours": f"""WITH {DENSITY}
SELECT u AS customer_id, count(*) AS neighbours FROM near GROUP BY u""",
    "dbscan_core_points": f"""WITH {DENSITY}
SELECT u AS customer_id, count(*) >= 10 AS is_core FROM near GROUP BY u""",
    "dbscan_segments": f"""WITH RECURSIVE {CLUSTERED}
SELECT customer_id, cluster AS "Cluster_DBSCAN" FROM clustered""",
    "top_outliers": f"""WITH RECURSIVE {CLUSTERED}
SELECT rfm.*, cluster AS "Cluster_DBSCAN" FROM rfm JOIN clustered USING (customer_id) WHERE cluster = -1
ORDER BY "Monetary" DESC, customer_id LIMIT 5""",
    "segment_names": f"""WITH {RETAIL}, ids AS (SELECT DISTINCT customer_id, CAST(customer_id % 6 AS INTEGER) AS segment_id FROM retail)
SELECT *, {SEGMENT_NAME}
FROM ids""",
}
