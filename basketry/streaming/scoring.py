"""The row-wise scoring transforms on a stream of requests.

Scoring keeps no state, so it needs no watermark; the checkpoint only records which files were read.
"""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from basketry.operators.churn import score_requests
from basketry.operators.segments import score_segments


def request_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet",
                   files_per_batch: int | None = None) -> DataFrame:
    """Requests that arrive as files under `path`, with a declared schema."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.format(format).load(path)


def run_available(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                  format: str = "parquet") -> StreamingQuery:
    """Starts scoring of everything that has arrived and stops after it; files appear exactly once."""
    return (score(stream).writeStream.format(format).outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def churn_scores(stream: DataFrame, model: PipelineModel, path: str, checkpoint: str) -> StreamingQuery:
    return run_available(stream, lambda requests: score_requests(model, requests), path, checkpoint)


def segment_scores(stream: DataFrame, pipeline: PipelineModel, path: str, checkpoint: str) -> StreamingQuery:
    return run_available(stream, lambda requests: score_segments(pipeline, requests), path, checkpoint)
