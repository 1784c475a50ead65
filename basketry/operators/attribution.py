"""Contribution of every feature to every churn score.

The Shapley value of a feature is taken over the trees of the model, where an unknown feature
follows both branches in proportion to the training rows they hold. A leaf pays its value only if
all its path conditions hold, so for one leaf the game is a product over the path's features and
its Shapley values have a closed form in the elementary symmetric sums of the other features.
Scores are margins: the base value plus all contributions of a row equal its margin.
"""

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import fresh_path

Leaf = tuple[float, list[tuple[int, float, float, float]]]  # value, [(feature, above, up to, share)]


@dataclass(frozen=True)
class TreeSum:
    """Leaves of all trees, bounded by the size of the model."""

    features: tuple[str, ...]
    leaves: list[Leaf]
    base: float


def _leaves(nodes: dict, weight: float) -> tuple[list[Leaf], float]:
    """Leaves of one tree with a merged condition per feature, and the tree's mean value."""
    leaves, mean = [], 0.0
    pending = [(0, {}, 1.0)]
    while pending:
        number, path, reach = pending.pop()
        node = nodes[number]
        if node.leftChild < 0:
            value = weight * node.prediction
            leaves.append((value, [(f, *condition) for f, condition in path.items()]))
            mean += value * reach
            continue
        feature, threshold = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        above, upto, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, low, high in ((node.leftChild, above, min(upto, threshold)),
                                 (node.rightChild, max(above, threshold), upto)):
            part = nodes[child].rawCount / node.rawCount
            pending.append((child, {**path, feature: (low, high, share * part)}, reach * part))
    return leaves, mean


def read_trees(model: PipelineModel, spark) -> TreeSum:
    """The trees of a fitted pipeline, through its saved node table (rows as many as tree nodes)."""
    assembler, trees = model.stages
    path = fresh_path(spark, "trees")
    trees.save(path)
    weights = trees.treeWeights
    by_tree = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        by_tree.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    leaves, base = [], 0.0
    for tree, nodes in by_tree.items():
        found, mean = _leaves(nodes, weights[tree])
        leaves += [leaf for leaf in found if leaf[1]]
        base += mean
    return TreeSum(tuple(assembler.getInputCols()), leaves, base)


def shapley(trees: TreeSum, values: np.ndarray) -> np.ndarray:
    """Contributions, rows x features, for a block of feature rows."""
    result = np.zeros_like(values)
    for value, conditions in trees.leaves:
        size = len(conditions)
        holds = [((values[:, f] > above) & (values[:, f] <= upto)).astype(float) for f, above, upto, _ in conditions]
        for i, (feature, _, _, share) in enumerate(conditions):
            # sums[s]: over subsets of s known other features, the product of known and unknown parts
            sums = [np.ones(len(values))]
            for j, (_, _, _, other_share) in enumerate(conditions):
                if j != i:
                    grown = [s * other_share for s in sums] + [np.zeros(len(values))]
                    for s, known in enumerate(sums):
                        grown[s + 1] = grown[s + 1] + known * holds[j]
                    sums = grown
            mean = sum(s * (factorial(k) * factorial(size - k - 1) / factorial(size)) for k, s in enumerate(sums))
            result[:, feature] += value * (holds[i] - share) * mean
    return result


def contributions(model: PipelineModel, customers: DataFrame, keys=("customer_id",)) -> DataFrame:
    """Rows (keys, base_value, margin, one column per feature) for every customer."""
    trees = read_trees(model, customers.sparkSession)
    keys, names = list(keys), list(trees.features)
    wanted = customers.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    types = [f"{field.name} {field.dataType.simpleString()}" for field in wanted.schema if field.name in keys]
    schema = ", ".join([*types, "base_value double", "margin double", *[f"{c} double" for c in names]])

    def explain(batches):
        for batch in batches:
            parts = shapley(trees, batch[names].to_numpy(float))
            out = batch[keys].copy()
            out["base_value"] = trees.base
            out["margin"] = trees.base + parts.sum(axis=1)
            yield pd.concat([out, pd.DataFrame(parts, columns=names, index=out.index)], axis=1)

    return wanted.mapInPandas(explain, schema)


def contribution_summary(contributed: DataFrame, features) -> DataFrame:
    """Rows (feature, mean_contribution): mean absolute contribution, the largest first."""
    means = contributed.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in features])
    return means.unpivot([], list(features), "feature", "mean_contribution").orderBy(
        F.desc("mean_contribution"), "feature")
