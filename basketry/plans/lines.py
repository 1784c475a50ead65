"""Queries over transaction lines, customers and daily series."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import schemas
from basketry.operators import cleaning, features, series
from basketry.session import fresh_path, staged
from basketry.sources import retail
from basketry.sources.star import raw_lines, retail_lines

SPENDING = ("invoice", "invoicedate", "customer_id", "quantity", "total_amount")
SALES = ("invoicedate", "stockcode", "quantity")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources and cleaning ------------------------------------------------------

def scan_retail(spark: SparkSession, folder: str) -> DataFrame:
    """Clean lines written as CSV with a header and read back with the declared schema."""
    path = fresh_path(spark, "clean-csv")
    retail.write_lines(cleaning.add_calendar(retail_lines(spark, folder)).select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.CLEAN_LINES]), path, "csv")
    read = retail.read_clean_lines(spark, path)
    return rounded(read.withColumn("invoicedate", F.date_format("invoicedate", "yyyy-MM-dd HH:mm:ss")), 2, "total_amount")


def scan_raw(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "raw-csv")
    retail.write_lines(raw_lines(spark, folder), path, "csv")
    read = retail.read_lines(spark, path)
    return read.withColumn("invoicedate", F.date_format("invoicedate", "yyyy-MM-dd HH:mm:ss"))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("invoicedate", F.to_date("invoicedate"))


def dedup_lines(spark, folder):
    return _dated(cleaning.drop_copies(raw_lines(spark, folder)))


def drop_null_customer(spark, folder):
    return _dated(cleaning.drop_missing_customers(raw_lines(spark, folder)))


def fill_description(spark, folder):
    return cleaning.fill_description(raw_lines(spark, folder)).select("invoice", "stockcode", "description")


def impute_median(spark, folder):
    return cleaning.fill_median(raw_lines(spark, folder)).select("invoice", "stockcode", "price", "quantity")


def impute_mode(spark, folder):
    return cleaning.fill_country(raw_lines(spark, folder)).select("invoice", "stockcode", "country")


def positive_lines(spark, folder):
    return cleaning.positive_lines(raw_lines(spark, folder)).select("invoice", "stockcode", "quantity", "price")


def line_totals(spark, folder):
    totals = cleaning.add_total(retail_lines(spark, folder, "invoice", "stockcode", "quantity", "price"))
    return rounded(totals, 2, "total_amount")


def calendar_parts(spark, folder):
    return _dated(cleaning.add_calendar(retail_lines(spark, folder, "invoice", "stockcode", "invoicedate")))


def iqr_bounds(spark, folder):
    return cleaning.iqr_bounds(cleaning.positive_lines(raw_lines(spark, folder)))


def iqr_filter(spark, folder):
    lines = cleaning.positive_lines(raw_lines(spark, folder)).select("invoice", "stockcode", "quantity")
    return cleaning.drop_outliers(lines)


def null_profile(spark, folder):
    return cleaning.null_profile(cleaning.drop_copies(raw_lines(spark, folder)))


def stage_counts(spark, folder):
    return cleaning.stage_counts(raw_lines(spark, folder))


def clean_retail(spark, folder):
    return rounded(_dated(cleaning.clean_lines(raw_lines(spark, folder))), 2, "total_amount")


# --- customers -----------------------------------------------------------------

def _reference(spark, folder):
    """The reference date from the order dates of lines alone, without prices or products."""
    return features.reference_date(retail_lines(spark, folder, "invoicedate"))


def customer_summary(spark, folder):
    lines = retail_lines(spark, folder, "invoice", "customer_id", "total_amount")
    return rounded(features.customer_summary(lines), 2, "Monetary")


def rfm_reference_date(spark, folder):
    return rounded(rfm_table(spark, folder), 2, "Monetary")


def rfm_labelled(spark, folder):
    labelled = features.rfm_labelled(retail_lines(spark, folder, *SPENDING), reference=_reference(spark, folder))
    return rounded(labelled, 2, "Monetary")


def labelled_lines(spark, folder):
    lines = retail_lines(spark, folder, "invoice", "stockcode", "invoicedate", "customer_id")
    return _dated(features.label_lines(lines, reference=_reference(spark, folder)))


def churn_label(spark, folder):
    return features.churn_label(retail_lines(spark, folder, "invoicedate", "customer_id"))


def churn_class_counts(spark, folder):
    return features.churn_class_counts(churn_label(spark, folder))


def recency_by_churn(spark, folder):
    described = features.describe_by(churn_label(spark, folder), "Churn", "Recency")
    return rounded(described, 6, "mean", "std", "q25", "q50", "q75")


def purchase_span(spark, folder):
    span = features.purchase_span(retail_lines(spark, folder, "invoicedate", "customer_id"))
    return span.withColumns({c: F.to_date(c) for c in ("first_purchase", "last_purchase")})


def churn_table(spark, folder):
    """All churn features, unrounded. They need several passes, so the joined lines are written once."""
    return features.customer_features(staged(retail_lines(spark, folder, "stockcode", *SPENDING), "lines"))


def customer_features(spark, folder):
    return rounded(churn_table(spark, folder), 6, "Monetary", "AvgOrderValue", "AvgDaysBetweenPurchases")


def customer_features_before(spark, folder):
    lines = staged(retail_lines(spark, folder, "stockcode", *SPENDING), "lines")
    cutoff = features.reference_date(lines) - F.expr("INTERVAL 91 DAY")
    table = features.customer_features_before(lines, cutoff)
    return rounded(table, 6, "Monetary", "AvgOrderValue", "AvgDaysBetweenPurchases")


def rfm_table(spark, folder):
    return features.rfm(retail_lines(spark, folder, *SPENDING), _reference(spark, folder))


def rfm_log_scaled(spark, folder):
    customers = staged(rfm_table(spark, folder), "rfm")
    return rounded(features.standardised(customers, features.RFM), 6, *features.RFM)


# --- daily series ----------------------------------------------------------------

def daily_sales(spark, folder):
    return series.daily_sales(retail_lines(spark, folder, *SALES))


def top_products(spark, folder):
    return series.top_products(retail_lines(spark, folder, "stockcode", "quantity"))


def brand_series(spark, folder):
    return series.dense_daily_sales(series.daily_sales(retail_lines(spark, folder, *SALES, product="p_brand")))


def type_series(spark, folder):
    return series.dense_daily_sales(series.daily_sales(retail_lines(spark, folder, *SALES, product="p_type")))


def dense_daily_sales(spark, folder):
    return brand_series(spark, folder)


def top_product_series(spark, folder):
    """Gap-filled series of the products with the largest quantity, chosen before filling."""
    daily = series.daily_sales(retail_lines(spark, folder, *SALES))
    return series.dense_daily_sales(series.only_products(daily, series.top_products(daily)))


def forecastable_products(spark, folder):
    return series.forecastable_products(daily_sales(spark, folder))


def lag_windows(spark, folder):
    """Lag windows with the values written as text, so that both engines print them alike."""
    windows = series.lag_windows(type_series(spark, folder))
    text = F.array_join(F.transform("lags", lambda v: v.cast("bigint").cast("string")), ",")
    return windows.select("stockcode", "date", text.alias("lags"), "target")


def holdout_split(spark, folder):
    return series.holdout_split(brand_series(spark, folder))


def min_max_scaled(spark, folder):
    scaled = series.min_max_scaled(brand_series(spark, folder))
    restored = scaled.withColumn("restored", series.unscaled(F.col("scaled")))
    return rounded(restored, 8, "scaled").withColumn("restored", F.round("restored", 4)).drop("range")


def forecast_calendar(spark, folder):
    daily = series.daily_sales(retail_lines(spark, folder, *SALES, product="p_brand"))
    return series.forecast_calendar(daily)


QUERIES = {
    "scan_retail": scan_retail,
    "scan_raw": scan_raw,
    "dedup_lines": dedup_lines,
    "drop_null_customer": drop_null_customer,
    "fill_description": fill_description,
    "impute_median": impute_median,
    "impute_mode": impute_mode,
    "positive_lines": positive_lines,
    "line_totals": line_totals,
    "calendar_parts": calendar_parts,
    "iqr_bounds": iqr_bounds,
    "iqr_filter": iqr_filter,
    "null_profile": null_profile,
    "stage_counts": stage_counts,
    "clean_retail": clean_retail,
    "customer_summary": customer_summary,
    "rfm_reference_date": rfm_reference_date,
    "rfm_labelled": rfm_labelled,
    "labelled_lines": labelled_lines,
    "churn_label": churn_label,
    "churn_class_counts": churn_class_counts,
    "recency_by_churn": recency_by_churn,
    "purchase_span": purchase_span,
    "customer_features": customer_features,
    "customer_features_before": customer_features_before,
    "rfm_log_scaled": rfm_log_scaled,
    "daily_sales": daily_sales,
    "top_products": top_products,
    "dense_daily_sales": dense_daily_sales,
    "top_product_series": top_product_series,
    "forecastable_products": forecastable_products,
    "lag_windows": lag_windows,
    "holdout_split": holdout_split,
    "minmax_scaled": min_max_scaled,
    "forecast_calendar": forecast_calendar,
}
