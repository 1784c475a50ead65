"""Drops lines that many documents share.

Lines are exploded as 128-bit hashes of their normalised text, never as text. Documents are counted
per hash after partial aggregation, so a line that every document has is one row per map task. The
verdicts go back to the lines by a join that adaptive execution can split, since both of its
sides are plain tables, and each document is put together again by the places that stay.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACES
from basketry.session import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def _marked(line: Column, least_length: int) -> Column:
    """The hash of a line's key, null for lines too short to be dropped."""
    key = _key(line)
    return F.when(F.length(key) >= least_length, F.unhex(F.md5(key.cast("binary"))))


def marked_lines(docs: DataFrame, least_length: int = 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, row, place, line): id, hash of the whole text, number and key's hash of every line that may be dropped.

    Rows that repeat an id with another text differ in `row`; those of the same text have the same lines.
    """
    hashed = docs.where(F.col(id).isNotNull()).select(  # once per text: what stands beside an explode is computed per line
        F.col(id).alias("doc"), _row(text).alias("row"), F.transform(_lines(text), lambda x: _marked(x, least_length)).alias("lines"))
    return (hashed.select("doc", "row", F.posexplode("lines").alias("place", "line"))
            .where(F.col("line").isNotNull()))


def _row(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def shared_lines(marked: DataFrame, least_documents: int = 3) -> DataFrame:
    """Rows (line, keeper) of `marked_lines`: hashes found in `least_documents` ids or more, and the largest id with it."""
    return (marked.select("line", "doc").distinct().groupBy("line")
            .agg(F.count("doc").alias("documents"), F.max("doc").alias("keeper"))
            .where(F.col("documents") >= least_documents).select("line", "keeper"))


def drop_shared_lines(docs: DataFrame, least_length: int = 20, least_documents: int = 3, id: str = "doc_id",
                      text: str = "text", prefix: str = "line_dedup_") -> DataFrame:
    """`docs` with `text` shortened, and {prefix}n_lines and {prefix}n_dropped.

    A line's key is its text without white space at the ends and with A-Z in lower case. Lines whose
    key has `least_length` code points and is found in `least_documents` distinct ids go, but for those
    of the largest id. Null and empty texts are one empty line; a null text stays null. Rows without
    an id count for no line and lose none. Rows that repeat an id are one document when counted, and
    each of them loses the same keys. Other columns pass through unchanged. Lines are hashed once, and work
    is linear in the lines of a text: the places that stay are a difference of two sets of numbers.
    """
    marked = staged(marked_lines(docs, least_length, id, text), "marked-lines")
    shared = staged(shared_lines(marked, least_documents), "shared-lines")
    lost = marked.join(shared, "line").where(F.col("doc") < F.col("keeper"))
    per_row = lost.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("place").alias("_lost"))
    lines = _lines(text)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_lost")
    # the inner function's argument holds the split text, which would else be split anew for every place
    kept = F.transform(F.array(F.struct(lines.alias("lines"), places.alias("places"))), lambda x: F.array_join(
        F.transform(x["places"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    joined = docs.join(per_row, (F.col(id) == F.col("_doc")) & (_row(text) == F.col("_row")), "left")
    counted = joined.withColumns({
        f"{prefix}n_lines": F.size(lines).cast("long"),
        f"{prefix}n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long")})
    return counted.withColumn(text, F.when(F.col("_lost").isNull(), F.col(text)).otherwise(kept)).drop("_doc", "_row", "_lost")
