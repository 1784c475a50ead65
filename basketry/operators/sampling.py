"""Stratified split and folds. Rows are ordered by a hash of their key, exactly and repeatably."""

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.lookups import lookup
from basketry.functions.ordering import numbered

PREFIX = 3  # hex digits of the hash that make a bucket: 4096 buckets per class


def _shuffled(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds `row` and `rows`: the place of a row in its class by hash, and the size of the class."""
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, PREFIX))
    return numbered(bucketed, "_bucket", ["_hash", key], [label]).drop("_hash", "_bucket")


def stratified_split(df: DataFrame, key: str = "customer_id", label: str = "Churn",
                     test_fraction: float = fixed.TEST_FRACTION, seed: int = fixed.SPLIT_SEED) -> DataFrame:
    """Adds `split` test / train. The test set has ceil(fraction x rows) rows, shared among the
    classes in proportion; rows left over by rounding go to the largest remainders.

    Rows without a label are left out, as they cannot be stratified.
    """
    labelled = df.where(F.col(label).isNotNull())
    classes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    everything = Window.partitionBy()  # one row per class
    wanted = F.ceil(F.sum("_rows").over(everything) * F.lit(Decimal(str(test_fraction)))).cast("long")
    ideal = F.col("_rows") * wanted / F.sum("_rows").over(everything)
    quotas = (classes.withColumns({"_base": F.floor(ideal), "_part": ideal - F.floor(ideal), "_wanted": wanted})
              .withColumn("_place", F.row_number().over(everything.orderBy(F.desc(F.round("_part", 9)), label)))
              .withColumn("_spare", F.col("_wanted") - F.sum("_base").over(everything))
              .select(label, (F.col("_base") + F.when(F.col("_place") <= F.col("_spare"), 1).otherwise(0)).alias("_quota")))
    placed = lookup(_shuffled(labelled, key, label, seed), quotas, [label])
    return placed.withColumn("split", F.when(F.col("row") <= F.col("_quota"), "test").otherwise("train")).drop(
        "row", "rows", "_quota")


def with_folds(df: DataFrame, key: str = "customer_id", label: str = "Churn", folds: int = fixed.FOLDS,
               seed: int = fixed.SPLIT_SEED) -> DataFrame:
    """Adds `fold` 0..folds-1, of equal size (to one row) within every class."""
    placed = _shuffled(df.where(F.col(label).isNotNull()), key, label, seed)
    return placed.withColumn("fold", ((F.col("row") - 1) % folds).cast("int")).drop("row", "rows")
