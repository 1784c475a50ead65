"""Wording, thresholds and parameters that results must agree on."""

# --- fixed values: cleaning -------------------------------------------------
UNKNOWN_PRODUCT = "Unknown Product"
IQR_FACTOR = 1.5

# --- fixed values: churn ----------------------------------------------------
INACTIVE_DAYS = 90
POSITIVE_WEIGHT = 2.0
SPLIT_SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5
RISK_BANDS = (
    # probability strictly above, level, action
    (0.7, "High Risk", "Contact customer immediately with a retention offer"),
    (0.4, "Medium Risk", "Send re-engagement email campaign"),
    (None, "Low Risk", "Maintain regular communication"),
)

# --- fixed values: segmentation ----------------------------------------------
K_RANGE = (6, 7, 8, 9, 10)
RESTARTS = 10
EPS = 0.5
MIN_SAMPLES = 10
PERSONAS = (
    # condition over the rounded cluster means, label; the first that holds wins
    ("Recency < 30 AND Frequency > 5 AND Monetary > 2000", "Champions"),
    ("Recency > 180 AND Frequency <= 2", "Lost / Hibernating"),
    ("Recency > 90 AND Frequency > 5", "At Risk (Loyal but inactive)"),
    ("Recency < 60 AND Frequency <= 2", "Recent Customers"),
)
OTHER_PERSONA = "Average Customers"
SEGMENTS = (
    # id, name, description
    (0, "Loyal Customers", "Regular buyers with long history"),
    (1, "VIP Customers", "Highest spend and frequency"),
    (2, "At Risk Customers", "Low activity, needs attention"),
    (3, "High Value Customers", "High spend, frequent buyers"),
)
UNKNOWN_SEGMENT = "Unknown"

# --- fixed values: demand ----------------------------------------------------
HOLDOUT_DAYS = 30
LAGS = 30
MIN_HISTORY_DAYS = 90
CHALLENGE_ABOVE = 0.10
HORIZON_DAYS = 30
TOP_PRODUCTS = 5
WEEKLY_ORDER = 3
YEARLY_ORDER = 10
