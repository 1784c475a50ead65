"""Daily product series.

Lines are summed to one row per product and day before anything is windowed, so no product has
more rows than there are calendar days, however many lines it has.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry import fixed_values as fixed


def whole_series():
    return Window.partitionBy("stockcode")


def by_date():
    return whole_series().orderBy("date")


def daily_sales(lines: DataFrame) -> DataFrame:
    """Quantity per product and day."""
    return (lines.where(F.col("stockcode").isNotNull() & F.col("invoicedate").isNotNull())
            .groupBy(F.to_date("invoicedate").alias("date"), "stockcode")
            .agg(F.coalesce(F.sum(F.col("quantity").cast("double")), F.lit(0.0)).alias("quantity")))


def top_products(sales: DataFrame, n: int = fixed.TOP_PRODUCTS) -> DataFrame:
    """The `n` products with the largest quantity; the smaller code first among equals."""
    return (sales.where(F.col("stockcode").isNotNull()).groupBy("stockcode")
            .agg(F.sum(F.col("quantity").cast("double")).alias("total_quantity"))
            .orderBy(F.desc("total_quantity"), "stockcode").limit(n))


def only_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sales of the listed products only; apply it before filling gaps."""
    return sales.join(products.select("stockcode"), "stockcode", "left_semi")


def dense_daily_sales(daily: DataFrame) -> DataFrame:
    """One row per product and calendar day from its first to its last sale; gaps are 0.

    Each sale day is expanded up to the day before the next one, which needs one shuffle by product
    and no join with a calendar.
    """
    next_day = F.lead("date").over(by_date())
    until = F.coalesce(F.date_sub(next_day, 1), F.col("date"))
    runs = daily.select("stockcode", "date", "quantity", until.alias("_until"))
    days = runs.select("stockcode", F.col("date").alias("_sold_on"), "quantity",
                       F.explode(F.sequence("date", "_until")).alias("date"))
    return days.select("stockcode", "date",
                       F.when(F.col("date") == F.col("_sold_on"), F.col("quantity")).otherwise(0.0).alias("quantity"))


def with_status(dense: DataFrame, min_days: int = fixed.MIN_HISTORY_DAYS) -> DataFrame:
    """Adds `days` (length of the product's series) and `status` ok / too_short."""
    days = F.count(F.lit(1)).over(whole_series())
    return dense.withColumn("days", days).withColumn(
        "status", F.when(F.col("days") >= min_days, "ok").otherwise("too_short"))


def forecastable_products(daily: DataFrame, min_days: int = fixed.MIN_HISTORY_DAYS) -> DataFrame:
    """One row per product: days from first to last sale and whether that suffices for a forecast.

    The length follows from the two end dates, so the series need not be filled for this.
    """
    ends = daily.groupBy("stockcode").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return ends.withColumn("days", F.datediff("last_day", "first_day") + 1).withColumn(
        "status", F.when(F.col("days") >= min_days, "ok").otherwise("too_short"))


def lag_windows(dense: DataFrame, length: int = fixed.LAGS, column: str = "quantity") -> DataFrame:
    """Rows (stockcode, date, lags, target): the `length` previous values and the value that followed."""
    before = by_date().rowsBetween(-length, -1)
    windowed = dense.select("stockcode", "date", F.collect_list(column).over(before).alias("lags"),
                            F.col(column).alias("target"))
    return windowed.where(F.size("lags") == length)


def holdout_split(dense: DataFrame, test_days: int = fixed.HOLDOUT_DAYS) -> DataFrame:
    """Adds `split`: the last `test_days` rows of a product are test, the others train.

    A product without any train row is marked too_short instead.
    """
    from_end = F.row_number().over(whole_series().orderBy(F.desc("date")))
    rows = F.count(F.lit(1)).over(whole_series())
    return dense.withColumn("split", F.when(rows <= test_days, "too_short")
                            .when(from_end <= test_days, "test").otherwise("train"))


def min_max_scaled(dense: DataFrame, fit_on: Column | None = None, column: str = "quantity") -> DataFrame:
    """Adds `scaled`, [0, 1] over the fitted rows of a product, and `low` and `range` to undo it.

    A constant series becomes 0. `fit_on` restricts the rows the range is taken from, for example
    to train rows; other rows may then fall outside [0, 1].
    """
    value = F.col(column) if fit_on is None else F.when(fit_on, F.col(column))
    low, high = F.min(value).over(whole_series()), F.max(value).over(whole_series())
    ranged = dense.withColumns({"low": low, "range": high - low})
    return ranged.withColumn("scaled", (F.col(column) - F.col("low")) / _divisor())


def _divisor() -> Column:
    return F.when(F.col("range") == 0, 1.0).otherwise(F.col("range"))


def unscaled(scaled: Column) -> Column:
    """Inverse of the scaling, from the columns `low` and `range`."""
    return scaled * _divisor() + F.col("low")


def forecast_calendar(daily: DataFrame, horizon: int = fixed.HOLDOUT_DAYS) -> DataFrame:
    """All days of a product's history and `horizon` more, with `is_future`."""
    ends = daily.groupBy("stockcode").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    days = ends.select("stockcode", "last_day",
                       F.explode(F.sequence("first_day", F.date_add("last_day", horizon))).alias("date"))
    return days.select("stockcode", "date", (F.col("date") > F.col("last_day")).alias("is_future"))
