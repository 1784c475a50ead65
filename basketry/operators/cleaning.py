"""Cleaning of raw transaction lines."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.columns import second_of
from basketry.functions.ordering import quantiles
from basketry.session import staged


def drop_copies(df: DataFrame) -> DataFrame:
    """One row per group of exact copies; copies collapse before the shuffle."""
    return df.dropDuplicates()


def drop_missing_customers(df: DataFrame) -> DataFrame:
    return df.where(F.col("customer_id").isNotNull()).withColumn("customer_id", F.col("customer_id").cast("long"))


def fill_description(df: DataFrame, text: str = fixed.UNKNOWN_PRODUCT) -> DataFrame:
    return df.na.fill({"description": text})


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (name, median): exact medians of several numeric columns in one pass over `df`."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("pair")).select("pair.name", "pair.value")
    return quantiles(long, "value", {"median": 0.5}, by=["name"])


def fill_median(df: DataFrame, columns: Sequence[str] = ("price", "quantity")) -> DataFrame:
    """Gaps become the median of the column; filled columns are doubles (a median may be a half)."""
    found = staged(medians(df, columns), "medians")
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"),
                      found.where(F.col("name") == c).select("median").scalar())
        for c in columns})


def fill_country(df: DataFrame) -> DataFrame:
    """Gaps become the most frequent country, the alphabetically first among equals."""
    most = (df.where(F.col("country").isNotNull()).groupBy("country").count()
            .orderBy(F.desc("count"), "country").limit(1))
    return df.withColumn("country", F.coalesce("country", most.select("country").scalar()))


def positive_lines(df: DataFrame) -> DataFrame:
    return df.where((F.col("quantity") > 0) & (F.col("price") > 0))


def add_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total_amount", F.col("quantity") * F.col("price"))


def add_calendar(df: DataFrame, timestamp: str = "invoicedate") -> DataFrame:
    """Year, month, day and English day name; the timestamp loses its fraction of a second."""
    return df.withColumn(timestamp, second_of(timestamp)).withColumns({
        "year": F.year(timestamp),
        "month": F.month(timestamp),
        "day": F.dayofmonth(timestamp),
        "day_of_week": F.date_format(timestamp, "EEEE"),
    })


def iqr_bounds(df: DataFrame, column: str = "quantity", factor: float = fixed.IQR_FACTOR) -> DataFrame:
    """One row: quartiles, their distance and the fences `factor` distances outside of them."""
    spread = quantiles(df, column, {"q1": 0.25, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    return spread.withColumns({
        "lower": F.col("q1") - factor * F.col("iqr"),
        "upper": F.col("q3") + factor * F.col("iqr"),
    })


def drop_outliers(df: DataFrame, column: str = "quantity", factor: float = fixed.IQR_FACTOR,
                  enabled: bool = True) -> DataFrame:
    """Rows between the fences. `enabled=False` keeps all rows, as a filter that never bites."""
    if not enabled:
        return df
    fences = staged(iqr_bounds(df, column, factor), "fences")
    return df.where(F.col(column).between(fences.select("lower").scalar(), fences.select("upper").scalar()))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows (column, nulls), counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls")


def fill_gaps(kept: DataFrame) -> DataFrame:
    """All gap fillings, on lines that have a customer."""
    return fill_country(fill_median(fill_description(kept)))


def clean_lines(raw: DataFrame, outliers: bool = True) -> DataFrame:
    """Raw lines cleaned: copies and lines without customer out, gaps filled, returns out, totals
    and calendar columns added, outlying quantities out.

    Medians and the mode come from lines that still include returns, the quartiles from lines that
    no longer do. Order by date is left to the writer. The deduplicated lines are written once, so
    the statistics read two or three of their columns instead of repeating the full-row shuffle.
    """
    kept = staged(drop_missing_customers(drop_copies(raw)), "kept")
    shaped = add_calendar(add_total(positive_lines(fill_gaps(kept))))
    return drop_outliers(shaped, enabled=outliers)


def stage_counts(raw: DataFrame) -> DataFrame:
    """Rows (stage, rows, columns) after each cleaning stage, from one staged table."""
    unique = staged(raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies")), "unique")
    totals = unique.agg(F.sum("_copies").alias("loaded"), F.count(F.lit(1)).alias("deduplicated"))
    shaped = positive_lines(fill_gaps(drop_missing_customers(unique.drop("_copies"))))
    fences = staged(iqr_bounds(shaped), "fences")
    inside = F.col("quantity").between(fences.select("lower").scalar(), fences.select("upper").scalar())
    later = shaped.agg(F.count(F.lit(1)).alias("positive"), F.count_if(inside).alias("within_fences"))
    with_customer = unique.agg(F.count("customer_id").alias("with_customer"))
    width = len(raw.columns)
    stages = [("loaded", totals, width), ("deduplicated", totals, width),
              ("with_customer", with_customer, width), ("positive", later, width + 5),
              ("within_fences", later, width + 5)]
    rows = F.array(*[
        F.struct(F.lit(name).alias("stage"), source.select(name).scalar().alias("rows"),
                 F.lit(columns).alias("columns")) for name, source, columns in stages])
    return (raw.sparkSession.range(1).select(F.explode(rows).alias("_row"))
            .select("_row.stage", "_row.rows", "_row.columns"))
