"""Transaction-line files in and out."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry import schemas
from basketry.functions.columns import tidy_name

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
CSV = {"header": True, "escape": '"'}  # quotes inside a field are doubled


def read_lines(spark: SparkSession, path: str | list[str], format: str = "csv",
               schema: T.StructType = schemas.RAW_LINES, bad_fields: str = "fail") -> DataFrame:
    """Lines from all files under `path` with a declared schema.

    CSV files carry a header row, the same in all files (checked by Spark). Its names are tidied and
    columns taken by name, in any order. Whole numbers may be written as 13085.0. A field that does not
    fit its type fails the read, or becomes null with `bad_fields="null"`; see `count_bad_fields`.
    """
    if bad_fields not in ("fail", "null"):
        raise ValueError("bad_fields is fail or null")
    if format != "csv":
        return spark.read.schema(schema).format(format).load(path).select(*schema.names)

    def read(field: T.StructField) -> Column:
        value = _parsed(field)
        if bad_fields == "fail" and not isinstance(field.dataType, T.StringType):
            message = F.concat(F.lit(f"column {field.name} cannot hold "), F.col(field.name))
            text = F.col(field.name)  # looked at only where no value was found
            value = F.coalesce(value, F.when(F.trim(text) != "", F.raise_error(message).cast(field.dataType)))
        return value.alias(field.name)

    return _csv_text(spark, path, schema).select(*[read(f) for f in schema.fields])


def count_bad_fields(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.RAW_LINES) -> DataFrame:
    """One row with, per column of `schema`, the fields of the CSV files that do not fit their type."""
    return _csv_text(spark, path, schema).agg(*[F.count_if(_bad(f)).alias(f.name) for f in schema.fields])


def _csv_text(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The columns of `schema` as text."""
    found = tidy_headers(spark.read.options(**CSV, enforceSchema=False, inferSchema=False).csv(path))
    missing = [name for name in schema.names if name not in found.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header")
    return found.select(*schema.names)


def _parsed(field: T.StructField) -> Column:
    """The text column as the field's type; null where it does not fit."""
    text = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return text
    if isinstance(field.dataType, T.IntegralType):
        number = F.trim(text).try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast("long"))
        return F.coalesce(F.trim(text).try_cast(field.dataType), whole.try_cast(field.dataType))
    return F.trim(text).try_cast(field.dataType)


def _bad(field: T.StructField) -> Column:
    return F.coalesce(F.trim(F.col(field.name)) != "", F.lit(False)) & _parsed(field).isNull()


def read_clean_lines(spark: SparkSession, path: str | list[str], format: str = "csv") -> DataFrame:
    return read_lines(spark, path, format, schemas.CLEAN_LINES)


def tidy_headers(df: DataFrame) -> DataFrame:
    """Column names trimmed, in lower case and with underscores for blanks."""
    return df.toDF(*[tidy_name(name) for name in df.columns])


def write_lines(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Writes lines ordered by invoice date within files; Parquet is partitioned by year and month.

    Lines are rebalanced by month: adaptive execution splits a large month over as many tasks as its
    size needs and puts small months together.
    """
    if format == "csv":
        (df.sortWithinPartitions("invoicedate").write.mode("overwrite")
         .options(**_written("csv")).csv(path))
        return
    (df.hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "invoicedate")
     .write.mode("overwrite").partitionBy("year", "month").format(format).save(path))


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Customer features, segments, run metrics and other tables without partition columns."""
    df.write.mode("overwrite").options(**_written(format)).format(format).save(path)


RUN_KEYS = ("run_id", "run_name", "kind", "key")


def append_runs(entries: DataFrame, path: str, run_id: str) -> None:
    """Adds the rows (run_name, kind, key, value) of one run to the run log under `path`.

    The log is partitioned by run. A run that is written again, as after a failure, replaces its own rows and no others;
    an empty run leaves the log as it is.
    """
    (entries.select("run_name", "kind", "key", "value").withColumn("run_id", F.lit(run_id)).hint("rebalance", "run_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log: rows (run_id, run_name, kind, key, value) of all runs."""
    return spark.read.schema("run_name string, kind string, key string, value string, run_id string").parquet(path).select(*RUN_KEYS, "value")


def append_lines(df: DataFrame, path: str, load_id: str) -> None:
    """Adds the lines of one load to the Parquet lines under `path`, beside those of other loads.

    Lines lie by load, year and month; a load that is written again replaces its own lines only. `read_lines` reads all loads.
    """
    (df.withColumn("load_id", F.lit(load_id)).hint("rebalance", "load_id", "year", "month").sortWithinPartitions("year", "month", "invoicedate")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id", "year", "month").parquet(path))


def _written(format: str) -> dict:
    if format != "csv":
        return {}
    return CSV | {"timestampNTZFormat": TIMESTAMP_FORMAT, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


CRM_COLUMNS = ("customer_id", "Recency", "Frequency", "Monetary", "Persona")


def crm_export(segments: DataFrame) -> DataFrame:
    """The columns handed to the customer-relations system."""
    return segments.select(*CRM_COLUMNS)
