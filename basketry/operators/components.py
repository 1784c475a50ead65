"""Connected components of a graph given as links, in a logarithmic number of rounds.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
MapReduce and Beyond" (2014): every round rewires links towards the smallest known neighbour until
all links point at the smallest node of their component. Minima are combined before they are
shuffled, each round ends in a written table, and the links of a hub are split among tasks by
adaptive execution once they make a partition uneven.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.lookups import lookup
from basketry.session import staged


def _fingerprint(links: DataFrame):
    return links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    rewired = both.join(least, "u").where(F.col("v") > F.col("u"))
    return rewired.where(F.col("v") != F.col("least")).select(
        F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    rewired = down.join(least, "u").where(F.col("v") != F.col("least"))
    moved = rewired.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def connected(nodes: DataFrame, links: DataFrame, node: str = "id") -> DataFrame:
    """Rows (node, root): the smallest node of the component. Links are rows (u, v)."""
    current = staged(links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _fingerprint(current)
    while True:
        current = staged(_small_star(_large_star(current)), "links")
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    roots = current.groupBy(F.col("u").alias(node)).agg(F.min("v").alias("root"))
    return nodes.select(node).join(roots, node, "left").select(node, F.coalesce("root", node).alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id, root) after `links` (rows u, v of ids) join further components to each other.

    Only links between different components are followed, as links of their roots.
    """
    between = staged(
        links.join(roots.select(F.col("id").alias("u"), F.col("root").alias("from")), "u")
        .join(roots.select(F.col("id").alias("v"), F.col("root").alias("to")), "v")
        .where(F.col("from") != F.col("to"))
        .select(F.col("from").alias("u"), F.col("to").alias("v")).distinct(), "links")
    if between.isEmpty():
        return roots
    touched = between.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    moved = connected(touched, between).select(F.col("id").alias("root"), F.col("root").alias("_moved"))
    return staged(lookup(roots, moved, ["root"]).select(
        "id", F.coalesce("_moved", "root").alias("root")), "roots")
