"""Declared schemas; nothing in the package infers one."""

from pyspark.sql import types as T

RAW_LINES = T.StructType([
    T.StructField("invoice", T.StringType()),
    T.StructField("stockcode", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("invoicedate", T.TimestampNTZType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("country", T.StringType()),
])

# Filling gaps with a median can give half units, so clean quantities are doubles.
CLEAN_LINES = T.StructType([
    T.StructField("quantity", T.DoubleType()) if field.name == "quantity" else field
    for field in RAW_LINES.fields
] + [
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("day_of_week", T.StringType()),
])

CHURN_REQUEST = T.StructType([T.StructField(name, T.DoubleType()) for name in (
    "Frequency", "Monetary", "AvgOrderValue", "TotalQuantity",
    "UniqueProducts", "Tenure", "AvgDaysBetweenPurchases")])

SEGMENT_REQUEST = T.StructType([T.StructField(name, T.DoubleType()) for name in (
    "Frequency", "Monetary", "Tenure")])

DEMAND_REQUEST = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("days", T.IntegerType()),
])
