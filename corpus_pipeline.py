"""Documents to training sequences: quality rules, line dedup, near-duplicates, secrets, packing.

Each stage reads the written rows of the one before it; all but the last return the columns of the
documents. Columns beyond those of `documents` pass through the filtering stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import jaccard_join, line_dedup, packing, quality_rules, secret_scan
from basketry.llm.common import table
from basketry.llm.queries import vocabulary
from basketry.session import staged


def _measured(docs: DataFrame) -> DataFrame:
    """`n_chars` again the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_dedup.drop_shared_lines(docs)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secret_scan.redact(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"))
    digested = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(staged(digested, "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("packed", packed)]

#: Token ids and adaptive thresholds are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
