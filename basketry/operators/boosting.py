"""Gradient-boosted trees on binned features; many boostings grow together, one job per level for all of them.

Features are binned once. Each level of all trees is one job: tasks add the first and second derivatives of the logistic
loss per (boosting, node, feature, bin), histograms of equal nodes meet in one shuffle, and one row per node, its best
split, comes to the driver. Derivatives are whole multiples of 1 / SCALE, so sums do not depend on their order and a
boosting grows the same trees alone or beside others, also after a lost task. Rows are kept as chunks of arrays; a tree's
margins are added once, by the first job after it, and written every few trees.

Where a task can hold all binned rows and there are boostings for all cores, one job grows every boosting in a task of its own
instead: rows stay sorted by node, and of two children only the smaller one is summed, the other is the rest of their parent. As
sums are whole numbers, both ways give the same trees.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.ordering import histogram, running_total, value_buckets
from basketry.operators.sampling import with_folds
from basketry.session import discard, fresh_path, shared_folder, staged

BINS = 32
SCALE = float(1 << 24)
#: Ridge penalty of leaf values, and least second derivative on either side of a split.
PENALTY, LEAST = 1.0, 1.0
#: Trees between two writes of the margins, which cut the lineage; those between are kept in executors and can be computed again.
WRITTEN = 10
#: Rows times boostings of a chunk.
BATCH_VALUES = 1 << 18
#: Rows times boostings of a task: fewer only until every core has one.
FEW, MANY = 100_000, 1 << 24
#: Bytes of rows that a task may hold to grow a boosting alone, and its rows that are summed at once.
WHOLE, SLICE = 400 << 20, 1 << 16
NODE_SCHEMA = "tree int, node int, feature string, threshold double, value double"


@dataclass(frozen=True)
class Boosting:
    """One boosting: `fold` is left out of it (-1: none); of every tree at most `leaves` stay, by gain."""

    trees: int
    depth: int
    rate: float
    fold: int = -1
    leaves: int | None = None


@dataclass(frozen=True)
class Ensemble:
    """Trees as arrays (tree x node, children of n at 2n + 1 and 2n + 2); feature -1 marks leaves, values up to a threshold go left."""

    features: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def first(self, n: int) -> "Ensemble":
        return Ensemble(self.features, self.feature[:n], self.threshold[:n], self.value[:n])

    def margins(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                right = ~(x[rows, np.maximum(feature[at], 0)] <= threshold[at])
                at = np.where(inner, 2 * at + 1 + right, at)
            total += value[at]
        return total

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node that holds rows: inner ones with feature and threshold, leaves with their value."""
        found = []
        for t, feature in enumerate(self.feature):
            stack = [0]
            while stack:
                n = stack.pop()
                if feature[n] >= 0:
                    found.append((t, n, self.features[feature[n]], float(self.threshold[t, n]), None))
                    stack += [2 * n + 2, 2 * n + 1]
                else:
                    found.append((t, n, None, None, float(self.value[t, n])))
        return spark.createDataFrame(found, NODE_SCHEMA)


def save(ensemble: Ensemble, spark: SparkSession, path: str) -> None:
    ensemble.nodes(spark).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str, features: Sequence[str]) -> Ensemble:
    """The ensemble that `save` wrote; as many rows as it has nodes come to the driver."""
    rows = spark.read.schema(NODE_SCHEMA).parquet(path).collect()
    shape = (1 + max((r.tree for r in rows), default=-1), 1 + max((r.node for r in rows), default=0))
    feature, threshold, value = np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape)
    for r in rows:
        if r.feature is None:
            value[r.tree, r.node] = r.value
        else:
            feature[r.tree, r.node], threshold[r.tree, r.node] = list(features).index(r.feature), r.threshold
    return Ensemble(tuple(features), feature, threshold, value)


def _number(column: str):
    """Nulls lie below all numbers; NaN goes with the greatest ones."""
    return F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))


def predict(ensemble: Ensemble, customers: DataFrame) -> DataFrame:
    """Adds `prediction` (cut at 0.5) and `score`, the probability of label 1; row-wise, for batch and stream."""

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-ensemble.margins(x.to_numpy(np.float64)))))

    scored = customers.withColumn("score", score(F.struct(*[_number(c).alias(f"x{d}") for d, c in enumerate(ensemble.features)])))
    return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature at most `bins` - 1 rising cuts, the first of them between null and numbers, from mergeable quantile
    summaries of all rows in one pass."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{d}") for d, c in enumerate(known)]).first()
    return [np.unique([-np.inf, *(q or [])]) for q in found]


def _binned(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """Columns bins, label, weight, fold; rows without a label, weight or fold are left out."""

    def binned(batches):
        for batch in batches:
            x = np.stack([np.searchsorted(c, batch.column(d).to_numpy(zero_copy_only=False)) for d, c in enumerate(cuts)], 1)
            packed = pa.array([r.tobytes() for r in x.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[len(cuts):]], names=["bins", "label", "weight", "fold"])

    ready = rows.select(*[_number(c).alias(f"x{d}") for d, c in enumerate(features)], F.col("label").cast("double"),
                        F.col("weight").cast("double"), F.col("fold").cast("int")).na.drop(subset=["label", "weight", "fold"])
    return ready.mapInArrow(binned, "bins binary, label double, weight double, fold int")


PACKED = "bins binary, label binary, weight binary, fold binary"


def _packed(table: DataFrame, most: int) -> DataFrame:
    """One row per chunk of at most `most` rows, in the partitions of `table`."""
    def packed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                bins, *rest = (part.column(c) for c in ("bins", "label", "weight", "fold"))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (
                    b"".join(bins.to_pylist()), *(c.to_numpy().tobytes() for c in rest))], names=["bins", "label", "weight", "fold"])

    return table.mapInArrow(packed, PACKED)


def _chunks(table: DataFrame, boostings: int) -> RDD:
    """The rows as chunks of arrays (bins, margins of zero, label, weight, fold), in the partitions of `table`."""
    def unpacked(row):
        label = np.frombuffer(row.label, np.float64)
        return (np.frombuffer(row.bins, np.uint8).reshape(len(label), -1), np.zeros((len(label), boostings)), label,
                np.frombuffer(row.weight, np.float64), np.frombuffer(row.fold, np.int32))

    return _packed(table, min(max(BATCH_VALUES // boostings, 1_024), 1 << 16)).rdd.map(unpacked)


def _descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row (rows x boostings) in one tree of each boosting, given as boostings x nodes."""
    first = np.arange(len(feature)) * feature.shape[1]
    feature, cut, rows = feature.ravel(), cut.ravel(), np.arange(len(x))[:, None]
    at = np.zeros((len(x), len(first)), np.int64)
    for _ in range(levels):
        asked = feature[first + at]
        right = x[rows, np.maximum(asked, 0)] > cut[first + at]
        at = np.where(asked >= 0, 2 * at + 1 + right, at)
    return at


def _with_margins(chunks: RDD, tree: tuple, levels: int) -> RDD:
    feature, cut, value = tree

    def added(chunk):
        x, margins, *rest = chunk
        return (x, margins + value[np.arange(len(value)), _descend(x, feature, cut, levels)], *rest)

    return chunks.map(added)


def _best(sums: np.ndarray) -> list[list]:
    """Best split of each of some nodes, from their sums (nodes x features x 2 x bins): lists of feature (-1: none), cut, gain,
    derivatives on both sides and of all."""
    bins, sums = sums.shape[-1], sums / SCALE
    whole = sums[:, :1].sum(-1)
    left = sums.cumsum(-1)[..., :-1]
    right = whole[..., None] - left
    gain = sum(side[:, :, 0] ** 2 / (side[:, :, 1] + PENALTY) for side in (left, right)) - (whole[..., 0] ** 2 / (whole[..., 1] + PENALTY))[..., None]
    gain[(left[:, :, 1] < LEAST) | (right[:, :, 1] < LEAST)] = -np.inf
    best = gain.reshape(len(gain), -1).argmax(1)
    each, d, c = np.arange(len(gain)), best // (bins - 1), best % (bins - 1)
    gained = gain[each, d, c]
    sides = [side[each, d, k, c].tolist() for side in (left, right) for k in (0, 1)]
    return [np.where(gained > 1e-9, d, -1).tolist(), c.tolist(), gained.tolist(), *sides, whole[:, 0, 0].tolist(), whole[:, 0, 1].tolist()]


def _splits(chunks: RDD, grown: tuple, level: int, open_: np.ndarray, folds: np.ndarray, n_features: int, bins: int, alone: bool) -> list[tuple]:
    """Best split per (boosting, node) of a level: (fit, node, feature (-1: none), cut, gain, derivatives on both sides and of all)."""
    boostings, base, nodes = len(folds), 2**level - 1, 2**level
    feature, cut = grown
    reducers = 1 if alone else max(1, min(chunks.getNumPartitions(), boostings * nodes // 32))

    def add(held):
        total = np.zeros((n_features, 2, boostings * nodes * bins), np.int64)
        for x, margins, label, weight, fold in held:
            at = _descend(x, feature, cut, level) - base
            row, fit = np.nonzero((at >= 0) & open_[np.arange(boostings), np.maximum(at, 0)] & (fold[:, None] != folds))
            chance = 1 / (1 + np.exp(-margins[row, fit]))
            slopes = [np.rint(SCALE * weight[row] * (chance - label[row])), np.rint(SCALE * weight[row] * chance * (1 - chance))]
            place = (fit * nodes + at[row, fit]) * bins
            for d in range(n_features):
                here = place + x[row, d]
                for k, slope in enumerate(slopes):
                    total[d, k] += np.bincount(here, slope, total.shape[2]).astype(np.int64)
        total = total.reshape(n_features, 2, boostings, nodes, bins)
        fits, at = np.nonzero(total[0, 1].any(axis=-1))
        for r in range(reducers):
            mine = (fits * nodes + at) % reducers == r
            if mine.any():
                yield r, (fits[mine], at[mine], total[:, :, fits[mine], at[mine]].transpose(2, 0, 1, 3).copy())

    def choose(parts):
        held = {}
        for _, (fits, at, sums) in parts:
            for fit, node, one in zip(fits.tolist(), at.tolist(), sums):
                if (fit, node) in held:
                    held[fit, node] += one
                else:
                    held[fit, node] = one.copy()
        if not held:
            return
        fits, at = zip(*held)
        yield from zip(fits, at, *_best(np.stack(list(held.values()))))

    sums = chunks.mapPartitions(add)
    return (sums if alone else sums.partitionBy(reducers, int)).mapPartitions(choose).collect()  # one task holds whole sums already


def _best_first(feature: np.ndarray, gain: np.ndarray, leaves: int) -> None:
    """Keeps the splits that a tree grown by the greatest gain first has once it holds `leaves` leaves.

    The gain of a node depends on its rows only, so the order can be settled after the levels are known.
    """
    kept, heap = set(), []
    if feature[0] >= 0:
        heappush(heap, (-gain[0], 0))
    while heap and len(kept) + 1 < leaves:
        n = heappop(heap)[1]
        kept.add(n)
        for child in (2 * n + 1, 2 * n + 2):
            if child < len(feature) and feature[child] >= 0:
                heappush(heap, (-gain[child], child))
    feature[[n for n in range(len(feature)) if n not in kept]] = -1


class _Rows:
    """All binned rows as arrays, sorted by fold: bins feature by feature, and the places of two features at a time in a table of both."""

    def __init__(self, chunks: Sequence[tuple[bytes, ...]], n_features: int, bins: int):
        label, weight, fold = (np.concatenate([np.frombuffer(chunk[k], kind) for chunk in chunks] or [np.empty(0, kind)])
                               for k, kind in ((1, np.float64), (2, np.float64), (3, np.int32)))
        x = np.concatenate([np.frombuffer(chunk[0], np.uint8).reshape(-1, n_features).T for chunk in chunks]
                           or [np.empty((n_features, 0), np.uint8)], 1)
        order = np.argsort(fold, kind="stable")
        self.label, self.weight, self.fold, self.bins = label[order], weight[order], fold[order], bins
        self.x = x[:, order]
        self.both = [self.x[d].astype(np.uint16) * np.uint16(bins) + (self.x[d + 1] if d + 1 < n_features else np.uint16(0))
                     for d in range(0, n_features, 2)]

    @staticmethod
    def held_bytes(n_features: int) -> int:
        """Bytes per row of all arrays, with margins, derivatives and the places of rows sorted by node."""
        return n_features + 2 * -(-n_features // 2) + 2 * 8 + 4 + 3 * 8 + 2 * 8

    def sums(self, places: Sequence, slopes: Sequence[np.ndarray]) -> np.ndarray:
        """Sums of derivatives (features x 2 x bins) of the rows at `places`, given as slices or arrays of at most SLICE rows."""
        total = np.zeros((2 * len(self.both), 2, self.bins), np.int64)
        for place in places:
            mine = [slope[place] for slope in slopes]
            for p, both in enumerate(self.both):
                here = both[place].astype(np.intp)
                for k, slope in enumerate(mine):
                    table = np.bincount(here, slope, self.bins**2).astype(np.int64).reshape(self.bins, self.bins)
                    total[2 * p, k] += table.sum(1)
                    total[2 * p + 1, k] += table.sum(0)
        return total[:len(self.x)]

    def parted(self, at: np.ndarray, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        right = self.x[feature].take(at) > cut
        return at[~right], at[right]

    def grow(self, b: Boosting, size: int, report: Sequence[int]):
        """The trees of one boosting as arrays (tree x node), and (trees, margins, labels) of the rows it leaves out per number of trees."""
        feature, cut = np.full((b.trees, size), -1, np.int16), np.zeros((b.trees, size), np.uint8)
        value, held = np.zeros((b.trees, size)), []
        first, end = np.searchsorted(self.fold, [b.fold, b.fold + 1]).tolist()
        slices = [slice(start, min(start + SLICE, stop)) for begin, stop in ((0, first), (end, len(self.fold))) for start in range(begin, stop, SLICE)]
        everyone, out = np.concatenate([np.r_[s] for s in slices] or [np.empty(0, np.intp)]), np.arange(first, end)
        margins, slopes = np.zeros(len(self.fold)), np.empty((2, len(self.fold)))
        for t in range(b.trees):
            for s in slices:
                chance = 1 / (1 + np.exp(-margins[s]))
                slopes[0, s] = np.rint(SCALE * self.weight[s] * (chance - self.label[s]))
                slopes[1, s] = np.rint(SCALE * self.weight[s] * chance * (1 - chance))
            for node, at in self.tree(b, everyone, self.sums(slices, slopes), slopes, feature[t], cut[t], value[t]):
                margins[at] += value[t, node]
            stack = [(0, out)]
            while stack:
                node, at = stack.pop()
                if feature[t, node] < 0:
                    margins[at] += value[t, node]
                elif len(at):
                    left, right = self.parted(at, feature[t, node], cut[t, node])
                    stack += [(2 * node + 1, left), (2 * node + 2, right)]
            if t + 1 in report:
                held.append((t + 1, margins[first:end].copy(), self.label[first:end]))
        held += [(r, margins[first:end], self.label[first:end]) for r in report if r > b.trees]
        return (feature, cut, value), held

    def tree(self, b: Boosting, everyone: np.ndarray, sums: np.ndarray, slopes: np.ndarray, feature, cut, value) -> list[tuple]:
        """Fills the nodes of one tree, level by level; its leaves with the places of their rows."""
        level, leaves, gain = {0: (everyone, sums)} if b.depth and sums[0, 1].any() else {}, [], np.zeros(len(value))
        while level:
            following = {}
            found = zip(level.items(), *_best(np.stack([sums for _, sums in level.values()])))
            for (n, (at, sums)), d, c, gained, gl, hl, gr, hr, g, h in found:
                value[n] = -b.rate * g / (h + PENALTY)
                if d < 0:
                    leaves.append((n, at))
                    continue
                feature[n], cut[n], gain[n] = d, c, gained
                value[2 * n + 1], value[2 * n + 2] = -b.rate * gl / (hl + PENALTY), -b.rate * gr / (hr + PENALTY)
                sides = self.parted(at, d, c)
                if n + 1 >= 2 ** (b.depth - 1):  # the children are on the last level
                    leaves += [(2 * n + 1, sides[0]), (2 * n + 2, sides[1])]
                    continue
                fewer = int(len(sides[1]) < len(sides[0]))
                few = self.sums([sides[fewer][k:k + SLICE] for k in range(0, len(sides[fewer]), SLICE)], slopes)
                for side in (0, 1):
                    following[2 * n + 1 + side] = sides[side], few if side == fewer else sums - few
            level = following
        if b.leaves:
            _best_first(feature, gain, b.leaves)
            leaves = [(_top(feature, n), at) for n, at in leaves]
        return leaves


def _top(feature: np.ndarray, node: int) -> int:
    """The node of a pruned tree that holds the rows of `node`."""
    top = node
    while node:
        node = (node - 1) // 2
        if feature[node] < 0:
            top = node
    return top


GROWN = "trees int, fit int, margin double, label double, feature binary, cut binary, value binary"


def _each_alone(table: DataFrame, boostings: Sequence[Boosting], n_features: int, bins: int, size: int, report: Sequence[int]) -> DataFrame:
    """Every boosting grown in a task of its own, written: a row with the nodes of all its trees, and one per row it leaves out and number of trees."""
    spark = table.sparkSession
    kinds = pa.schema([("trees", pa.int32()), ("fit", pa.int32()), ("margin", pa.float64()), ("label", pa.float64()),
                       ("feature", pa.binary()), ("cut", pa.binary()), ("value", pa.binary())])
    ordered = sorted(range(len(boostings)), key=lambda f: -boostings[f].depth * boostings[f].trees)  # the longest begin first

    def grown(batches):
        chunks, places = [], []
        for batch in batches:
            places += batch.column(0).to_pylist()
            chunks += [row for row in zip(*(c.to_pylist() for c in batch.columns[1:])) if row[0] is not None]
        if not places:
            return
        fit = ordered[places[0]]
        held_rows = _Rows(chunks, n_features, bins)
        chunks.clear()
        trees, held = held_rows.grow(boostings[fit], size, report)
        yield pa.RecordBatch.from_pydict({"trees": [boostings[fit].trees], "fit": [fit], "margin": [None], "label": [None],
                                          **{name: [array.tobytes()] for name, array in zip(("feature", "cut", "value"), trees)}}, kinds)
        for number, margins, labels in held:
            for k in range(0, len(margins), SLICE):
                n = len(margins[k:k + SLICE])
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, fit, np.int32)),
                                                  pa.array(margins[k:k + SLICE]), pa.array(labels[k:k + SLICE]), nothing, nothing, nothing], schema=kinds)

    path = fresh_path(spark, "packed")
    _packed(table, SLICE).write.parquet(path)
    chunks = spark.read.schema(PACKED).parquet(path).coalesce(1)
    none = spark.range(0, 1, 1, 1).select(*[F.lit(None).cast("binary").alias(c) for c in chunks.columns])  # a task without rows still has a boosting
    held = chunks.unionByName(none).coalesce(1)
    pairs = spark.range(0, len(boostings), 1, len(boostings)).crossJoin(held.hint("shuffle_replicate_nl"))
    done = staged(pairs.mapInArrow(grown, GROWN), "grown")
    discard(spark, path)
    return done


def fit_all(rows: DataFrame, features: Sequence[str], boostings: Sequence[Boosting], bins: int = BINS,
            report: Sequence[int] = ()) -> tuple[list[Ensemble], DataFrame | None]:
    """Ensembles of all boostings over columns `label` (0 or 1), `weight`, `fold` and the features.

    For each number of trees in `report`, the second result has a row (trees, fit, margin, label) per row and boosting
    that left its fold out. Null features lie below all numbers, NaN with the greatest; rows without label, weight or fold take no part; without
    rows every tree is a leaf of value zero.
    """
    spark, n, count = rows.sparkSession, len(features), len(boostings)
    most, depth = max(b.trees for b in boostings), max(b.depth for b in boostings)
    size, folds = 2 ** (depth + 1) - 1, np.array([b.fold for b in boostings])
    cuts = edges(rows, features, bins)

    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    path = fresh_path(spark, "binned")
    binned = _binned(rows, features, cuts)
    binned.write.parquet(path)
    table = spark.read.schema(binned.schema).parquet(path)
    n_rows, cores = table.count(), spark.sparkContext.defaultParallelism
    work = n_rows * count
    if n_rows * _Rows.held_bytes(n) <= WHOLE and min(count, cores) >= min(work // FEW, cores):
        done = _each_alone(table, boostings, n, bins, size, [r for r in report if r <= most])
        discard(spark, path)
        arrays = {r.fit: [np.frombuffer(b, kind).reshape(-1, size) for b, kind in zip(r[1:], (np.int16, np.uint8, np.float64))]
                  for r in done.where(F.col("feature").isNotNull()).select("fit", "feature", "cut", "value").collect()}
        scored = done.where(F.col("margin").isNotNull()).select("fit", "margin", "label", "trees") if report else None
        return [_ensemble(features, cuts, bins, *arrays[f]) for f in range(count)], scored
    parts = max(1, work // MANY, min(work // FEW, cores))
    state = _chunks(table.repartition(parts), count).persist(StorageLevel.MEMORY_AND_DISK)
    older, checkpoints = [], []
    grown, held = [], []
    for t in range(most):
        feature, cut = np.full((count, size), -1, np.int64), np.zeros((count, size), np.int64)
        value, gain = np.zeros((count, size)), np.zeros((count, size))
        open_ = np.array([[t < b.trees] for b in boostings])
        for level in range(depth):
            if not open_.any():
                break
            base, following = 2**level - 1, np.zeros((count, 2 ** (level + 1)), bool)
            for f, node, d, c, gained, gl, hl, gr, hr, g, h in _splits(state, (feature, cut), level, open_, folds, n, bins, parts == 1):
                rate, at = boostings[f].rate, base + node
                value[f, at] = -rate * g / (h + PENALTY)
                if d < 0:
                    continue
                feature[f, at], cut[f, at], gain[f, at] = d, c, gained
                value[f, 2 * at + 1], value[f, 2 * at + 2] = -rate * gl / (hl + PENALTY), -rate * gr / (hr + PENALTY)
                following[f, 2 * node: 2 * node + 2] = level + 1 < boostings[f].depth
            open_ = following
            while older:  # the first job of a tree has put its margins in place
                older.pop().unpersist()
        for f, b in enumerate(boostings):
            if b.leaves:
                _best_first(feature[f], gain[f], b.leaves)
        grown.append((feature, cut, value))
        if t + 1 == most and t + 1 not in report:
            break
        older.append(state)
        state = _with_margins(state, (feature, cut, value), depth).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % WRITTEN == 0 or t + 1 in report:
            state.checkpoint()
            state.count()
            checkpoints.append(state.getCheckpointFile())
            if t + 1 in report:
                held.append(_held(state, folds, spark).withColumn("trees", F.lit(t + 1)))
            for place in checkpoints[:-1]:
                discard(spark, place)
            del checkpoints[:-1]
    for rdd in (state, *older):
        rdd.unpersist()
    for place in (path, *checkpoints):
        discard(spark, place)
    ensembles = [_ensemble(features, cuts, bins, *(np.stack([tree[k][f] for tree in grown[: b.trees]]) for k in range(3)))
                 for f, b in enumerate(boostings)]
    scored = held[0] if held else None
    for more in held[1:]:
        scored = scored.unionByName(more)
    return ensembles, scored


def _ensemble(features: Sequence[str], cuts: list[np.ndarray], bins: int, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> Ensemble:
    limits = np.full((len(cuts), bins), np.inf)
    for d, c in enumerate(cuts):
        limits[d, : len(c)] = c
    feature = feature.astype(np.int64)
    return Ensemble(tuple(features), feature, limits[np.maximum(feature, 0), cut], value)


def _held(chunks: RDD, folds: np.ndarray, spark: SparkSession) -> DataFrame:
    """Rows (fit, margin, label) of the boostings that left a row's fold out, written."""
    def packed(chunk):
        _, margins, label, _, fold = chunk
        row, fit = np.nonzero(fold[:, None] == folds)
        return fit.astype(np.int32).tobytes(), margins[row, fit].tobytes(), label[row].tobytes()

    def out(batches):
        for batch in batches:
            for columns in zip(*batch.columns):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c.as_buffer(), kind)) for c, kind in zip(
                    columns, (np.int32, np.float64, np.float64))], names=["fit", "margin", "label"])

    whole = spark.createDataFrame(chunks.map(packed), "fit binary, margin binary, label binary", verifySchema=False)
    return staged(whole.mapInArrow(out, "fit int, margin double, label double"), "held")


def areas(scored: DataFrame, by: Sequence[str], score: str = "margin") -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null where a class is absent."""
    counted = histogram(scored, score, by, positive=F.sum("label"), negative=F.sum(1 - F.col("label")))
    placed = running_total(value_buckets(counted, score), "_bucket", [score], "negative", by)
    pairs = F.sum("positive") * F.sum("negative")
    return placed.groupBy(*by).agg((F.sum(F.col("positive") * (F.col("upto") - F.col("negative") / 2)) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


@dataclass(frozen=True)
class Search:
    """The chosen parameters, their model on all rows, and one row per combination."""

    best: Boosting
    model: Ensemble
    table: DataFrame


def search(train: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence], folds: int = fixed.FOLDS,
           seed: int = fixed.SPLIT_SEED) -> Search:
    """Every combination of trees, depth and rate on stratified folds by area under the ROC curve, in shared jobs.

    `train` has `label`, `weight` and the features. All folds and the fits on all rows grow together, so the jobs are as
    many as for one boosting of the most trees and greatest depth; fewer trees are the first ones of more. The first of
    equal combinations is selected; a fold in which a class is absent does not count.
    """
    spark = train.sparkSession
    folded = with_folds(train, folds=folds, seed=seed)
    pairs = [(depth, float(rate)) for depth in grid["depth"] for rate in grid["rate"]]
    most = max(grid["trees"])
    boostings = [Boosting(most, depth, rate, fold) for depth, rate in pairs for fold in (*range(folds), -1)]
    ensembles, scored = fit_all(folded, features, boostings, report=grid["trees"])
    found = {(r.trees, r.fit): r.auc for r in areas(scored, ["trees", "fit"]).collect()}
    rows = []
    for trees in grid["trees"]:
        for k, (depth, rate) in enumerate(pairs):
            known = [a for f in range(folds) if (a := found.get((trees, k * (folds + 1) + f))) is not None]
            rows.append((trees, depth, rate, sum(known) / len(known) if known else None))
    best = max(rows, key=lambda row: -1.0 if row[3] is None else row[3])
    model = ensembles[pairs.index(best[1:3]) * (folds + 1) + folds].first(best[0])
    table = spark.createDataFrame([(*row, row is best) for row in rows],
                                  "trees int, depth int, rate double, mean_auc double, selected boolean")
    return Search(Boosting(*best[:3]), model, table)
