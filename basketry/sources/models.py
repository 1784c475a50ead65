"""Fitted pipelines and forecasters on storage."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.forecast import FORECASTER_SCHEMA


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_forecasters(forecasters: DataFrame, path: str, run_id: str) -> None:
    """Adds the forecasters of one run to the store under `path`, which is partitioned by run.

    A run appears when its write is committed; written again, as after a failure, it replaces its own rows only.
    """
    (forecasters.withColumn("run_id", F.lit(run_id)).hint("rebalance", "run_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def read_forecasters(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The forecasters of one run; without `run_id` those of the run whose id is the largest text."""
    stored = spark.read.schema(f"{FORECASTER_SCHEMA}, run_id string").parquet(path)
    wanted = F.lit(run_id) if run_id is not None else stored.agg(F.max("run_id")).scalar()
    return stored.where(F.col("run_id") == wanted).drop("run_id")
