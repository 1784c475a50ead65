"""Customer features. Every operator takes lines (or customers) and returns one row per customer.

Distinct invoices and distinct products are counted in two aggregations joined on the customer.
Both sides are already partitioned by customer, so that join moves nothing, while two distinct
counts in one aggregation would make Spark shuffle three copies of every line. A customer with a
third of all lines is spread by (customer, invoice) and (customer, product) and combined before
the final step.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.columns import exact_sum, whole_days
from basketry.functions.lookups import lookup


def _known(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("customer_id").isNotNull())


def reference_date(lines: DataFrame) -> Column:
    """One day after the last line of the whole table."""
    last = lines.agg(F.max("invoicedate").alias("last")).scalar()
    return last + F.expr("INTERVAL 1 DAY")


def customer_summary(lines: DataFrame) -> DataFrame:
    return _known(lines).groupBy("customer_id").agg(
        F.count_distinct("invoice").alias("Frequency"),
        exact_sum(F.col("total_amount")).alias("Monetary"))


def churn_label(lines: DataFrame, inactive_days: int = fixed.INACTIVE_DAYS,
                reference: Column | None = None) -> DataFrame:
    """Recency in whole days, and Churn = 1 for customers inactive for `inactive_days` or more."""
    reference = reference_date(lines) if reference is None else reference
    last = _known(lines).groupBy("customer_id").agg(F.max("invoicedate").alias("last_purchase"))
    return _labelled(last, reference, inactive_days).select("customer_id", "Recency", "Churn")


def _labelled(customers: DataFrame, reference: Column, inactive_days: int) -> DataFrame:
    return (customers.withColumn("Recency", whole_days("last_purchase", reference))
            .withColumn("Churn", (F.col("Recency") >= inactive_days).cast("int")))


def label_lines(lines: DataFrame, inactive_days: int = fixed.INACTIVE_DAYS,
                reference: Column | None = None) -> DataFrame:
    """Every line with the Recency and Churn of its customer."""
    return lookup(_known(lines), churn_label(lines, inactive_days, reference), ["customer_id"])


def rfm_labelled(lines: DataFrame, inactive_days: int = fixed.INACTIVE_DAYS,
                 reference: Column | None = None) -> DataFrame:
    """Recency, Frequency, Monetary and Churn per customer, straight from unlabelled lines."""
    reference = reference_date(lines) if reference is None else reference
    grouped = _known(lines).groupBy("customer_id").agg(
        F.max("invoicedate").alias("last_purchase"),
        F.count_distinct("invoice").alias("Frequency"),
        exact_sum(F.col("total_amount")).alias("Monetary"))
    return _labelled(grouped, reference, inactive_days).select(
        "customer_id", "Recency", "Frequency", "Monetary", "Churn")


def rfm_from_labelled_lines(labelled: DataFrame) -> DataFrame:
    """The same table from lines that already carry Recency and Churn."""
    return _known(labelled).groupBy("customer_id").agg(
        F.min("Recency").alias("Recency"),
        F.count_distinct("invoice").alias("Frequency"),
        exact_sum(F.col("total_amount")).alias("Monetary"),
        F.max("Churn").alias("Churn"))


def rfm(lines: DataFrame, reference: Column | None = None) -> DataFrame:
    """Recency, Frequency and Monetary against the reference date; only customers who spent."""
    scored = rfm_labelled(lines, reference=reference).drop("Churn")
    return scored.where(F.col("Monetary") > 0)


def purchase_span(lines: DataFrame) -> DataFrame:
    """First and last purchase, and Tenure = whole elapsed days between them."""
    span = _known(lines).groupBy("customer_id").agg(
        F.min("invoicedate").alias("first_purchase"), F.max("invoicedate").alias("last_purchase"))
    return span.withColumn("Tenure", whole_days("first_purchase", "last_purchase"))


def customer_features(lines: DataFrame, inactive_days: int = fixed.INACTIVE_DAYS,
                      reference: Column | None = None) -> DataFrame:
    """All churn features and the label, one row per customer; ratios are null without any invoice."""
    reference = reference_date(lines) if reference is None else reference
    lines = _known(lines)
    spending = lines.groupBy("customer_id").agg(
        F.count_distinct("invoice").alias("Frequency"),
        exact_sum(F.col("total_amount")).alias("Monetary"),
        exact_sum(F.col("quantity")).alias("TotalQuantity"),
        F.min("invoicedate").alias("first_purchase"),
        F.max("invoicedate").alias("last_purchase"))
    variety = lines.groupBy("customer_id").agg(F.count_distinct("stockcode").alias("UniqueProducts"))
    joined = spending.join(variety, "customer_id", "left")
    tenure = whole_days("first_purchase", "last_purchase")
    return _labelled(joined, reference, inactive_days).select(
        "customer_id", "Recency", "Frequency", "Monetary", "Churn",
        F.try_divide("Monetary", "Frequency").alias("AvgOrderValue"),
        "TotalQuantity", "UniqueProducts",
        tenure.alias("Tenure"),
        F.try_divide(tenure.cast("double"), F.col("Frequency")).alias("AvgDaysBetweenPurchases"))


def customer_features_before(lines: DataFrame, cutoff: Column,
                             inactive_days: int = fixed.INACTIVE_DAYS) -> DataFrame:
    """Features from lines before `cutoff`; Churn = 1 if none follows within `inactive_days` of it.

    Label and features share no period, so Tenure cannot give the label away.
    """
    early = customer_features(lines.where(F.col("invoicedate") < cutoff), inactive_days, cutoff).drop("Churn")
    until = cutoff + F.make_interval(days=F.lit(inactive_days))
    active = (lines.where((F.col("invoicedate") >= cutoff) & (F.col("invoicedate") < until))
              .select("customer_id").distinct().withColumn("_active", F.lit(1)))
    return (early.join(active, "customer_id", "left")
            .withColumn("Churn", F.when(F.col("_active").isNull(), 1).otherwise(0)).drop("_active"))


def churn_class_counts(customers: DataFrame) -> DataFrame:
    """Customers per class, the larger class first."""
    return (customers.where(F.col("Churn").isNotNull()).groupBy("Churn")
            .agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "Churn"))


def describe_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of `column` per group.

    Meant for columns with few distinct values (whole days); `percentile` keeps one counter per
    distinct value, so its memory does not grow with the rows.
    """
    value = F.col(column)
    return df.groupBy(group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.percentile(value, F.lit(0.25)).alias("q25"),
        F.percentile(value, F.lit(0.5)).alias("q50"), F.percentile(value, F.lit(0.75)).alias("q75"),
        F.max(value).alias("max"))


RFM = ("Recency", "Frequency", "Monetary")


def standardised(df: DataFrame, columns, log: bool = True, suffix: str = "") -> DataFrame:
    """log1p (optional) and z-scores with the population deviation; a constant column becomes 0.

    Means and deviations are one row, used as a scalar subquery.
    """
    source = {c: F.log1p(c) if log else F.col(c).cast("double") for c in columns}
    stats = df.agg(F.struct(
        *[F.avg(v).alias(f"{c}_mean") for c, v in source.items()],
        *[F.stddev_pop(v).alias(f"{c}_dev") for c, v in source.items()]).alias("stats"))
    one = stats.scalar()

    def z(c, v):
        dev = one.getField(f"{c}_dev")
        return (v - one.getField(f"{c}_mean")) / F.when(dev == 0, 1.0).otherwise(dev)

    return df.withColumns({f"{c}{suffix}": z(c, v) for c, v in source.items()})
