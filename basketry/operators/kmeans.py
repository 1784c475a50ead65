"""K-Means for many numbers of clusters and many starts in shared passes over the rows.

Every pass is one job for all fits: a task multiplies its Arrow batches with all centres at once and returns
partial sums per (fit, cluster), which are added as decimals and so independent of order. Only centres
and such sums, a few rows per fit, come to the driver; no pass depends on what a task kept before.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of the seeding, and rows that each draws by squared distance: what stands for all rows until centres rest there.
ROUNDS, DRAWN = 3, 800
ITERATIONS = 300
#: A fit rests once its centres move by less than this share of the mean variance of a feature, squared moves added.
TOLERANCE = 1e-4
#: Rows of a block, which meet all centres at once; centres of a fit, a power of two, up to which scores hold their numbers; products at a time.
BATCH_ROWS, FEW, PRODUCTS = 2_048, 64, 1 << 18
EXACT = "decimal(38,12)"


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and salt only (the finaliser of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature, without cancellation."""
    total = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        total += (x[:, [d]] - centres[None, :, d]) ** 2
    return total


def blocks(rows: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """The rows without a null feature as blocks of numbers (keys, x), dealt evenly: what every pass reads. Persist it before the passes."""
    n = len(features)
    points = rows.select(F.xxhash64(key).alias("key"), *[F.col(c).cast("double").alias(f"x{d}") for d, c in enumerate(features)]).na.drop()

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                x = np.stack([part.column(1 + d).to_numpy(zero_copy_only=False) for d in range(n)], 1)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                                                 names=["keys", "x"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return points.repartition(tasks, "key", *[f"x{d}" for d in range(n)]).mapInArrow(pack, "keys binary, x binary")


def _batches(batches, n_features: int):
    for batch in batches:
        for keys, x in zip(*batch.columns):
            yield np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), np.float64).reshape(-1, n_features)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """(fits x rows) the nearest of every `k` centres to a row, by products of numbers taken from the middle of the centres.

    The number of a centre stands in the last bits of its score, some 1e-14 of it, so that the least score names it.
    """
    middle = centres.mean(0)
    c = centres - middle
    weights = np.concatenate([-c, 0.5 * (c * c).sum(1, keepdims=True)], 1).reshape(-1, k, x.shape[1] + 1)
    held = np.concatenate([x - middle, np.ones((len(x), 1))], 1)
    if k > FEW:
        step = max(1, PRODUCTS // k)
        return np.stack([np.concatenate([(held[at:at + step] @ w.T).argmin(1) for at in range(0, len(x), step)]) for w in weights])
    weights, held = weights.transpose(1, 0, 2).copy(), held.T.copy()
    best = None
    for j, w in enumerate(weights):
        score = w @ held
        bits = score.view(np.int64)
        bits &= -FEW
        bits |= j
        best = score if best is None else np.minimum(best, score, out=best)
    return best.view(np.int64) & (FEW - 1)


def _apart(x: np.ndarray, centres: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to the centres `at` (fits x rows), without cancellation."""
    total = np.zeros(at.shape)
    for d in range(x.shape[1]):
        gap = centres[:, d][at]
        gap -= x[:, d]
        gap *= gap
        total += gap
    return total


def _chosen(points: DataFrame, n: int, seed: int, centres: np.ndarray | None, most: int) -> np.ndarray:
    """`most` rows drawn without replacement, by squared distance to `centres` (at random without).

    The rows with the least exponential time over weight are such a draw; tasks return their own least ones.
    """
    names = [f"x{d}" for d in range(n)]

    def draw(batches):
        held_times, held = np.zeros(0), np.zeros((0, n))
        for keys, x in _batches(batches, n):
            weight = np.ones(len(x)) if centres is None else _apart(x, centres, _nearest(x, centres, len(centres)))[0]
            with np.errstate(divide="ignore"):
                times = np.concatenate([held_times, -np.log(_uniform(keys, seed)) / weight])
            best = np.argsort(times, kind="stable")[:most]
            best = best[np.isfinite(times[best])]  # rows on a centre have no weight
            held_times, held = times[best], np.concatenate([held, x])[best]
        yield pa.RecordBatch.from_arrays([pa.array(held_times), *(pa.array(held[:, d]) for d in range(n))], names=["time", *names])

    schema = "time double, " + ", ".join(f"{c} double" for c in names)
    return np.array([list(r)[1:] for r in points.mapInArrow(draw, schema).orderBy("time", *names).limit(most).collect()]).reshape(-1, n)


def _added(sums: list[np.ndarray], x: np.ndarray, stacked: list[np.ndarray], sizes: Sequence[int]) -> None:
    """Adds rows, costs and sums per centre to `sums`, one array per number `sizes` of clusters, of the rows nearest to each."""
    for k, c, total in zip(sizes, stacked, sums):
        near = _nearest(x, c, k)
        near += k * np.arange(len(near))[:, None]
        place = near.ravel()
        total[:, 0] += np.bincount(place, minlength=len(c))
        total[:, 1] += np.bincount(place, _apart(x, c, near).ravel(), len(c))
        for d in range(x.shape[1]):
            total[:, 2 + d] += np.bincount(place, np.tile(x[:, d], len(near)), len(c))


def _moments(points: DataFrame, n: int, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per fit (rows per centre, sums per centre, cost) of the rows nearest to each; the first of equally near ones."""
    names = [f"x{d}" for d in range(n)]

    sizes = np.array([len(c) for c in centres])
    groups = [(k, np.flatnonzero(sizes == k)) for k in np.unique(sizes).tolist()]
    stacked = [np.concatenate([centres[s] for s in fits]) for _, fits in groups]

    def add(batches):
        sums = [np.zeros((len(c), n + 2)) for c in stacked]
        for _, x in _batches(batches, n):
            _added(sums, x, stacked, [k for k, _ in groups])
        for (k, fits), total in zip(groups, sums):
            some = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fits[some // k].astype(np.int32)), pa.array((some % k).astype(np.int32)), *(pa.array(total[some, j]) for j in range(n + 2))],
                names=["fit", "cluster", "n", "cost", *names])

    schema = "fit int, cluster int, n double, cost double, " + ", ".join(f"{c} double" for c in names)
    rows = points.mapInArrow(add, schema).groupBy("fit", "cluster").agg(
        *[F.sum(F.col(c).cast(EXACT)).cast("double").alias(c) for c in ("n", "cost", *names)]).collect()
    out = [(np.zeros(len(c)), np.zeros((len(c), n)), []) for c in centres]
    for r in rows:
        counts, totals, costs = out[r["fit"]]
        counts[r["cluster"]] = r["n"]
        totals[r["cluster"]] = list(r)[4:]
        costs.append(r["cost"])
    return [(counts, totals, float(sum(sorted(costs)))) for counts, totals, costs in out]


def _seeded(summary: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """`k` centres of distinct weighted rows: k-means++, then Lloyd's steps until they rest; fewer where rows are."""
    chosen = [int(rng.choice(len(summary), p=weights / weights.sum()))]
    nearest = _squared(summary, summary[chosen])[:, 0]
    while len(chosen) < min(k, len(summary)):
        left = weights * nearest
        tried = rng.choice(len(summary), 2 + int(np.log(k)), p=left / left.sum())
        apart = np.minimum(nearest[:, None], _squared(summary, summary[tried]))
        best = int((weights @ apart).argmin())  # of a few draws the one that leaves the least cost
        chosen.append(int(tried[best]))
        nearest = apart[:, best]
    centres = summary[chosen]
    for _ in range(ITERATIONS):
        near = _squared(summary, centres).argmin(1)
        mass = np.bincount(near, weights, len(centres))
        moved = np.stack([np.bincount(near, weights * summary[:, d], len(centres)) for d in range(summary.shape[1])], 1)
        new = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres[np.lexsort(centres.T[::-1])]


def fit_all(rows: DataFrame, features: Sequence[str], key: str, ks: Sequence[int], restarts: int, seed: int,
            iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the centres and cost of the cheapest of `restarts` fits, the first of equal ones.

    Rows drawn by squared distance, weighted by the rows nearest to them, stand for the table: every start is a k-means++ draw
    among them and rests there first. Then all fits move together over all rows until each one's centres rest (TOLERANCE). Rows
    with a null feature are left out; no rows give no centres. Rows are packed into blocks of numbers once, which all passes read.
    """
    known = rows.select(*[F.col(c).cast("double").alias(f"x{d}") for d, c in enumerate(features)]).na.drop()
    spread = known.agg(*[F.var_pop(c) for c in known.columns]).first()
    points = blocks(rows, features, key).persist()
    try:
        return _fitted(points, len(features), spread, ks, restarts, seed, iterations, tolerance)
    finally:
        points.unpersist()


def _fitted(points: DataFrame, n: int, spread: Sequence[float], ks: Sequence[int], restarts: int, seed: int,
            iterations: int, tolerance: float) -> dict[int, tuple[np.ndarray, float]]:
    rest = tolerance * float(np.mean([v or 0.0 for v in spread]))
    fits = [(k, start) for k in ks for start in range(restarts)]
    summary = _chosen(points, n, seed, None, 1)
    if not len(summary):
        return {k: (np.zeros((0, n)), 0.0) for k in ks}
    for turn in range(1, ROUNDS + 1):
        summary = np.unique(np.concatenate([summary, _chosen(points, n, seed + 7919 * turn, summary, DRAWN)]), axis=0)
    weights = _moments(points, n, [summary])[0][0]
    summary, weights = summary[weights > 0], weights[weights > 0]
    centres = [_seeded(summary, weights, k, np.random.default_rng([seed, start])) for k, start in fits]
    costs = [np.inf] * len(fits)
    first = {(k, c.tobytes()): s for s, (c, (k, _)) in reversed(list(enumerate(zip(centres, fits))))}
    moving = sorted(first.values())  # equal starts move once
    for turn in range(iterations + 1):
        still = []
        for s, (counts, totals, cost) in zip(moving, _moments(points, n, [centres[s] for s in moving])):
            costs[s] = cost  # of the centres of this pass
            new = np.where(counts[:, None] > 0, totals / np.maximum(counts, 1)[:, None], centres[s])
            if turn < iterations and ((new - centres[s]) ** 2).sum() > rest:
                centres[s] = new
                still.append(s)
        moving = still
        if not moving:
            break
    best = {}
    for s, (k, _) in enumerate(fits):
        if k not in best or costs[s] < best[k][1]:
            best[k] = (centres[s], costs[s])
    return best


def model_of(centres: np.ndarray, features_col: str = "scaled", label_col: str = "cluster") -> KMeansModel:
    """A saveable Spark model with these centres."""
    jvm = SparkContext._active_spark_context._jvm
    listed = jvm.java.util.ArrayList()
    for centre in centres:
        listed.add(jvm.org.apache.spark.mllib.linalg.Vectors.dense(float(centre[0]), _doubles(centre[1:])))
    parent = jvm.org.apache.spark.mllib.clustering.KMeansModel(listed)
    model = KMeansModel(jvm.org.apache.spark.ml.clustering.KMeansModel(f"KMeans_{abs(hash(centres.tobytes())):x}", parent))
    return model.setFeaturesCol(features_col).setPredictionCol(label_col)


def _doubles(values: Sequence[float]):
    gateway = SparkContext._active_spark_context._gateway
    array = gateway.new_array(gateway.jvm.double, len(values))
    for i, v in enumerate(values):
        array[i] = float(v)
    return array
