"""Connected components of links, with joins that adaptive execution can split at hubs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import staged


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """Rows (node, root) of all nodes of `links` (u, v): root is the smallest node that links lead to; steps are written to `files` files.

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes. Minima are combined
    before they are shuffled and written before they are joined, so both sides of a join are plain.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        return staged(df if files is None else df.coalesce(files), name)

    down = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = kept(down.distinct(), "links")
    before = _summary(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "least")
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("least"))).select(
            F.col("v").alias("u"), F.col("least").alias("v"))
        large = kept(large.distinct(), "links")
        lowest = kept(large.groupBy("u").agg(F.min("v").alias("least")), "least")
        moved = large.join(lowest, "u").where(F.col("v") != F.col("least")).select(
            F.col("v").alias("u"), F.col("least").alias("v"))
        current = kept(moved.unionByName(lowest.select("u", F.col("least").alias("v"))).distinct(), "links")
        after = _summary(current)
        if after == before:
            break
        before = after
    children = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return kept(children.unionByName(roots), "roots")
