"""The queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (alignment, byte_bpe, hard_negatives, html_text, jaccard_join, license_scan, line_dedup, lm_score, packing,
                          quality_rules, secret_scan, vector_join, warc)
from basketry.llm.common import table
from basketry.llm.sql import ORACLE_SQL
from basketry.session import staged


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    digested = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(staged(digested, "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    records = warc.read(warc.write(pages))
    return records.select(F.nullif("record", F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op5_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    linked = vector_join.link_vectors(table(spark, folder, "embeddings"))
    return linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_shared_lines(table(spark, folder, "documents").select("doc_id", "text"), prefix="")
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_context_tree_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    features = staged(quality_rules.quality_features(table(spark, folder, "documents")), "features")
    return quality_rules.adaptive_verdicts(features).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern()
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), ranks, pattern), ranks, pattern)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licensed_documents(table(spark, folder, "documents"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = alignment.aligned_documents(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), split_pattern(),
                                          vocabulary("piece_bpe_32k.model"))
    return rows


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_secret_scan, op2_best_fit_packing, op3_warc_bundles, op4_html_text, op5_vector_join, op6_jaccard_join,
             op7_line_dedup, op8_context_tree_score, op9_quality_rules, op10_byte_bpe, op11_license_scan,
             op12_token_alignment, op13_hard_negatives, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
