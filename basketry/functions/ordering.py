"""Ranks, running totals and exact quantiles without sorting a group in one task.

A window over a whole table, or over a class that holds a third of it, is one task. Here rows are
first put into order-preserving buckets; each (group, bucket) is windowed by itself and the small
table of bucket totals tells where every bucket starts.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from basketry.session import staged


def running_total(df: DataFrame, bucket: str, order: Sequence, amount: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Adds `upto` (total of `amount` up to and with the row) and `total` (of the whole group).

    `bucket` must never decrease along `order`, and the columns `by` hold no nulls. Bucket totals
    are at most buckets x groups rows.
    """
    by = list(by)
    sums = df.groupBy(*by, bucket).agg(F.sum(amount).alias("_held"))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(c).alias(f"_s_{c}") for c in [*by, bucket]],
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_held").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = (Window.partitionBy(*by, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matches = [F.col(c) == F.col(f"_s_{c}") for c in [*by, bucket]]
    return (
        df.withColumn("_inside", F.sum(amount).over(inside))
        .join(starts, matches)
        .withColumn("upto", F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before", *[f"_s_{c}" for c in [*by, bucket]])
    )


def numbered(df: DataFrame, bucket: str, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Adds `row` (1, 2, ... along `order` in each group) and `rows` (size of the group)."""
    counted = running_total(df.withColumn("_one", F.lit(1)), bucket, order, "_one", by)
    return counted.withColumnsRenamed({"upto": "row", "total": "rows"}).drop("_one")


def value_buckets(df: DataFrame, column: str) -> DataFrame:
    """Adds `_bucket`, non-decreasing in `column` (of any orderable type; nulls first, NaN last).

    Buckets are the ranges that Spark deals out by value, as many as the bytes need; they are written
    once, so that every later read sees the same ones.
    """
    ranged = df.repartitionByRange(F.col(column))
    return staged(ranged.withColumn("_bucket", F.spark_partition_id()), "value-buckets")


def histogram(df: DataFrame, column: str, by: Sequence[str] = (), **measures) -> DataFrame:
    """One staged row per distinct value (and group), without nulls and NaN; copies collapse before the shuffle."""
    measures = measures or {"n": F.count(F.lit(1))}
    known = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        known = known & ~F.isnan(column)
    counted = df.where(known).groupBy(*by, column).agg(
        *[measure.alias(name) for name, measure in measures.items()])
    return staged(counted, "histogram")


def quantiles(df: DataFrame, column: str, wanted: Mapping[str, float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, one column per name."""
    placed = running_total(value_buckets(histogram(df, column, by), column), "_bucket", [column], "n", by)
    value = F.col(column).cast("double")

    def at(rank):
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), value))

    result = []
    for name, share in wanted.items():
        position = (F.col("total") - 1) * F.lit(float(share))
        low, high = at(F.floor(position)), at(F.ceil(position))
        part = F.max(position - F.floor(position))
        result.append((low + part * (high - low)).alias(name))
    return placed.groupBy(*by).agg(*result)
